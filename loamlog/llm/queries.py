"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), capacity=2048, end_id=1)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_documents, held_out, score_documents

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_documents(docs, _table(spark, sf_dir, "labels"))
    return score_documents(docs, model, threshold=0.7).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_and_decode

    rows = encode_and_decode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_pages, fit_weights

    pages = _table(spark, sf_dir, "pages")
    return extract_pages(pages, fit_weights(pages))


def op6_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import vector_links

    return vector_links(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    manifest = write_token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    rows = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import index_media, store_media

    rows = index_media(store_media(_table(spark, sf_dir, "documents")))
    offsets = F.crc32(F.array_join("frame_offsets", ","))
    feature = F.format_string("mp3 samples=%d rate=%d frames=%d vbr=%d/%d offsets=%08x errors=%d skipped=%d", "samples", "sample_rate", "frames", "vbr_frames", "vbr_bytes", offsets, "checksum_errors", "skipped_bytes")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "samples",
        "sample_rate",
        "frame_offsets",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, with_revisits, write_archives

    rows = read_archives(write_archives(with_revisits(_table(spark, sf_dir, "pages"), min_bytes=1000)))
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("full_bytes"))
    digest = F.coalesce(F.sha1("payload"), F.col("digest"))
    return rows.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_warc, op3_toxicity, op4_bpe, op5_html, op6_vector_links, op7_token_files, op8_repeats, op9_near_duplicates, op10_media, pipeline)}


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
d AS (SELECT page_id, n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM d
"""


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, (SELECT min(b) FROM r WHERE r.a = v.vec_id) AS component_id, v.vec_id = (SELECT min(b) FROM r WHERE r.a = v.vec_id) AS kept
FROM v
"""

OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op6_vector_links": OP6_SQL, "op9_near_duplicates": OP9_SQL}
