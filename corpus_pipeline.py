"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, repeated strings go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.llm.common import discard, stored
from loamlog.llm.minhash import near_duplicates
from loamlog.llm.packing import pack_documents
from loamlog.llm.repeats import remove_repeats
from loamlog.llm.toxicity import fit_documents, score_documents

SIMILARITY_PERCENT = 80
REPEAT_BYTES = 200
WINDOW = 2048


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents and the labels, doesn't reject.

    Null and empty texts stay, and where nothing can be learned all documents do.
    """
    model = fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).where("predicted = 0").select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of near duplicates. Documents without words, or without an id, stay; so do all rows of an id that stays."""
    found = near_duplicates(docs, percent=SIMILARITY_PERCENT)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur at another place too; characters cut in half go as a whole.

    Every document stays, with an empty text where all of it was repeated or it had none; ``n_chars`` follows the text.
    """
    changed = remove_repeats(docs, length=REPEAT_BYTES, as_text=True)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return changed.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most ``WINDOW`` ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=WINDOW, end_id=1)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicate), ("repeats", repeats), ("packing", packing)]

# Learned scores, MinHash, suffix sorting and tokenizers aren't SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two of them the rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
