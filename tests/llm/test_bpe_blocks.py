import public_tokenizers

from loamlog.llm import bpe


def test_blocks_are_written_before_they_are_dealt(documents):
    """Only the tasks of encoding and decoding can run again: the rows that name blocks are a table."""
    rows = bpe.encode_and_decode(documents({1: "one two", 2: "two three"}), public_tokenizers.path("byte_bpe_50k.json"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "parquet" in plan


def test_words_may_be_forgotten(spark, documents, texts, monkeypatch):
    """A bound on the table of words changes how often a word is encoded, not its ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(texts)
    want = sorted(map(tuple, bpe.encode_and_decode(docs, path, block_bytes=2000).collect()))
    monkeypatch.setattr(bpe, "TABLE_BYTES", 1)
    monkeypatch.setattr(bpe, "BUCKET_BYTES", 4000)
    assert bpe.bucket_count(docs) > 8
    assert sorted(map(tuple, bpe.encode_and_decode(docs, path, block_bytes=2000).collect())) == want
