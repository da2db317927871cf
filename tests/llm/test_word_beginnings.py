from loamlog.llm import toxicity


def test_longer_beginnings_are_features():
    """Inflections share a feature that a clean word with the same four letters lacks."""
    one, two, clean = (set(toxicity.word_features(w)) for w in ("poisoning", "poisoned", "poise"))
    assert (one & two) - clean
