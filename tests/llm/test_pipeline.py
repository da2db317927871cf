import random

import public_tokenizers
import pytest
from test_text_dedup import brute, removed
from tokenizers import Tokenizer

import corpus_pipeline
from loamlog.llm import queries, toxicity

BAD = ["grubby", "rotten", "vile", "foul", "nasty"]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8))) for _ in range(700)]
    rows, labels = [], []
    for i in range(400):
        text = [r.choice(words) for _ in range(r.randint(6, 90))]
        if i % 6 == 0:
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(BAD))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, t) for i, t in enumerate(texts)]
    where = str(tmp_path_factory.mktemp("tables"))
    full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns

    def rows(df):
        assert df.columns == columns
        return {r.doc_id: r for r in df.collect()}

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "repeats", "packing"]
    clean = rows(stages["toxicity"](spark, docs, folder))
    gone = set(first) - set(clean)
    assert {i for i in gone if i < 1000} <= {i for i in range(0, 400, 6)} and len(gone) > 55
    assert all(clean[i] == first[i] for i in clean)

    docs = spark.createDataFrame(list(clean.values()), docs.schema)
    alone = rows(stages["near_duplicates"](spark, docs, folder))
    assert set(alone) == {i for i, (_, _, kept) in brute({i: r.text for i, r in clean.items()}, 80).items() if kept}
    assert len(alone) < len(clean)

    docs = spark.createDataFrame(list(alone.values()), docs.schema)
    cut = rows(stages["repeats"](spark, docs, folder))
    want = removed([(i, r.text) for i, r in alone.items()], 200)
    assert {i: r.text for i, r in cut.items()} == {i: w[3].decode("utf-8", "ignore") for i, w in want.items()}
    assert any(w[1] for w in want.values())
    assert all(r.n_chars == len(r.text) for i, r in cut.items() if want[i][1])

    docs = spark.createDataFrame(list(cut.values()), docs.schema)
    pieces = stages["packing"](spark, docs, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in cut.items()}

    run = corpus_pipeline.run(spark, folder)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, run.collect())) == sorted(map(key, pieces))


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_is_registered():
    assert sorted(queries.queries(), key=lambda n: (n == "pipeline", len(n.split("_")[0]), n))[-1] == "pipeline"
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{n}" for n in range(1, 11)} | {"pipeline"}
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert toxicity.MAX_POSITIVE == 2000
