import pytest
from test_text_dedup import removed

from loamlog.llm import repeats


def test_long_lengths(documents):
    texts = {1: "ab" * 300, 2: "x" + "ab" * 290, 3: "q" * 299, 4: "y" * 300, 5: "z" + "y" * 300}
    rows = repeats.remove_repeats(documents(texts), 300, 120).collect()
    assert {x.doc_id: (x["n_bytes"], x.n_removed, x.n_spans, bytes(x.kept_bytes)) for x in rows} == removed(list(texts.items()), 300)


def test_anchors_lie_within_the_length(documents):
    with pytest.raises(ValueError):
        repeats.remove_repeats(documents({1: "x" * 600}), 50, 60)


def test_one_row_many_times(spark):
    """Rows that are equal in id and text repeat each other, and their spans stay those of one."""
    text = "".join(chr(97 + k * k % 23) for k in range(2000))
    rows = repeats.remove_repeats(spark.createDataFrame([(1, text)] * 600 + [(2, text[:250])], "doc_id long, text string")).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted(map(tuple, rows)) == [(1, 2000, 2000, 1, 600), (2, 250, 250, 1, 1)]
