import random

import pytest
from test_text_dedup import removed

from loamlog.llm import repeats


@pytest.mark.parametrize(("length", "gram"), [(200, 100), (40, 7), (41, 20)])
def test_hot_anchors_are_split(spark, documents, length, gram, monkeypatch):
    """However many different contexts an anchor has, no group of them that meets in one task is larger than the limit."""
    limit = 5
    monkeypatch.setattr(repeats, "HOT", limit * (2 * length - gram), raising=False)
    most, solved = [], repeats._solved

    def seen(rows, *args):
        most.append(max((r["count"] for r in rows.groupBy("anchor").count().collect()), default=0))
        return solved(rows, *args)

    monkeypatch.setattr(repeats, "_solved", seen)
    r = random.Random(length)

    def some(n):
        return "".join(r.choice("abcdefgh") for _ in range(n))

    line, ends, starts = some(length + length // 2), [some(length // 3) for _ in range(3)], [some(length // 4) for _ in range(3)]
    # the line whole, with few different surroundings close by, and parts of it
    texts = [some(r.randint(0, length)) + r.choice(["", *starts]) + line + r.choice(["", *ends]) + some(r.randint(0, length)) for _ in range(60)]
    texts += [some(20) + line[r.randint(0, 30) : r.randint(length // 2, len(line))] + some(20) for _ in range(60)]
    own = list(enumerate([*texts, texts[0], texts[1] + texts[2], line * 3]))
    rows = repeats.remove_repeats(documents(dict(own)).repartition(3), length, gram).collect()
    assert {x.doc_id: (x["n_bytes"], x.n_removed, x.n_spans, bytes(x.kept_bytes)) for x in rows} == removed(own, length)
    assert most and max(most) <= limit
