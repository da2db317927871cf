import random

import pytest

#: Extra columns whose names clash with those that operators make.
EXTRA = "lang string, source string, n_chars long, start long, length int, score double, n_bytes string, key string, text_ string, component_id int, bands string, sequence_id long, offset long, media string"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with nulls, empty, tiny, long, equal and nearly equal texts, and extra columns with clashing names."""

    def make(texts, extra=True):
        rows = [(i, t) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if not extra:
            return df
        return df.selectExpr("*", *(f"cast(null as {kind}) as `{name}`" for name, kind in (x.split() for x in EXTRA.split(", "))))

    return make


@pytest.fixture(scope="session")
def texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(900)]
    long = " ".join(r.choice(words) for _ in range(9000))
    base = [r.choice(words) for _ in range(120)]
    near = []
    for k in range(14):
        own = list(base)
        for _ in range(k // 3):
            own[r.randrange(len(own))] = r.choice(words)
        near.append(" ".join(own))
    passage = " ".join(r.choice(words) for _ in range(60))
    around = [" ".join(r.choice(words) for _ in range(30)) + " " + passage + " " + " ".join(r.choice(words) for _ in range(20)) for _ in range(4)]
    odd = [None, "", " ", "\n\t", "x", "one two", "Ünï çødé  “quoted”   text's don't", "a" * 700, "<|endoftext|> a <|startoftext|>", "\x00\x1c nul", "日本語 テキスト。" * 40]
    return [*odd, long, *near, near[0], near[0].upper(), *around, "short", "short"]
