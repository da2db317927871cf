import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from loamlog.llm import common, induced, minhash, repeats


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 700)] + [(1000, 1000), (None, 3), (2000, 1999)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j]:
                common_ = len(sets[i] & sets[j])
                if 100 * common_ >= percent * len(sets[i] | sets[j]):
                    a, b = sorted((root[i], root[j]))
                    root = {k: a if v == b else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("tile", [3, 512])
def test_near_duplicates(spark, documents, texts, percent, tile, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", tile)
    own = dict(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(own), percent).collect()}
    assert got == brute(own, percent)


def test_near_duplicates_of_nothing_and_repeated_rows(spark, documents):
    assert minhash.near_duplicates(documents([]).limit(0)).count() == 0
    docs = documents({5: "a b c d e f", 2: "A b c d e f", 9: None})
    docs = docs.unionByName(docs).unionByName(docs.selectExpr("cast(null as long) as doc_id", *docs.columns[1:]))
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == {(5, 2, 2, False): 2, (2, 2, 2, True): 2, (9, 0, 9, True): 2, (None, 2, None, True): 2, (None, 0, None, True): 1}


def test_estimates_follow_similarity():
    r = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        n = 4000
        both = r.integers(0, 2**63, n).astype(np.uint64)
        k = int(n * share)
        a, b = both, np.concatenate([both[:k], r.integers(0, 2**63, n - k).astype(np.uint64)])
        exact = k / (2 * n - k)
        bits = minhash.low_bits(minhash.minima(np.concatenate([a, b]), np.array([n, n])))
        words = np.ascontiguousarray(bits).view("<u8")
        assert abs(minhash.estimated(words[:1], words[1:])[0, 0] - exact) < 0.15


def test_links_are_a_spanning_forest_of_all_links():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 100).astype(np.uint64)
    sets = []
    for _ in range(40):
        own = base.copy()
        own[r.integers(0, 100, r.integers(0, 12))] = r.integers(0, 2**63, 1)[0]
        sets.append(np.unique(own))
    bits = np.ascontiguousarray(minhash.low_bits(minhash.minima(np.concatenate(sets), np.array([len(s) for s in sets])))).view("<u8")
    everything = np.arange(len(sets))
    links = minhash.link_sets(sets, bits, everything, everything, 85)
    assert len(links) < len(sets)

    def parts(pairs):
        root = list(range(len(sets)))
        for i, j in pairs:
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
        return root

    real = [(i, j) for i in everything for j in everything if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert parts(links) == parts(real)


# --- repeats


@pytest.mark.parametrize("seed", range(40))
def test_induced_sorting(seed):
    r = np.random.default_rng(seed)
    alphabet = int(r.integers(1, 4))
    text = r.integers(1, alphabet + 1, r.integers(1, 90))
    if seed % 3 == 0:
        text[len(text) // 2 :] = text[: len(text) - len(text) // 2]
    text = np.append(text, 0).astype(np.uint16)
    order, prefixes = [], []
    for at, lcp in induced.sorted_suffixes(text, alphabet + 1, memory=5):
        order += at.tolist()
        prefixes += lcp.tolist()
    plain = sorted(range(len(text)), key=lambda i: tuple(text[i:].tolist()), reverse=True)
    assert order == plain

    def common_(i, j):
        k = 0
        while text[i + k] == text[j + k]:
            k += 1
            if max(i, j) + k >= len(text):
                break
        return k

    assert prefixes[1:] == [common_(a, b) for a, b in zip(plain, plain[1:], strict=False)]


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("memory", [2, 30])
def test_induced_sorting_by_levels(seed, memory, monkeypatch):
    """With few names in memory and few digits the recursion is several levels deep; common prefixes are exact to the depth."""
    monkeypatch.setattr(induced, "DIGIT", 5)
    r = np.random.default_rng(seed)
    text = np.append(np.concatenate([r.integers(1, 6, 40)] * 4 + [r.integers(1, 6, 60)]), 0).astype(np.uint16)
    found = list(induced.sorted_suffixes(text, 6, memory, depth=16))
    order, prefixes = (np.concatenate([x[i] for x in found]).tolist() for i in (0, 1))
    assert sorted(order) == list(range(len(text)))
    own = [tuple(text[i:].tolist()) for i in order]
    assert [x[:16] for x in own] == sorted((x[:16] for x in own), reverse=True)
    for a, b, n in zip(own, own[1:], prefixes[1:], strict=False):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) or n == 16 and a[:16] == b[:16]


def test_a_shard_of_ten_times_the_memory():
    """What is held beside the disk follows the limit, not the text."""
    r = np.random.default_rng(3)
    words = [r.integers(3, 20, n) for n in (3, 4, 5, 6, 7) for _ in range(40)]
    parts = [words[i] for i in r.integers(0, len(words), 8_000)]
    text = np.append(np.concatenate(parts), 0).astype(np.uint16)
    memory = len(text) // 10
    mapped = induced.mapped(len(text) + 264, np.uint16)
    mapped[: len(text)] = text
    tracemalloc.start()
    seen = deep = 0
    for at, lcp in induced.sorted_suffixes(mapped, 20, memory // 4, n=len(text)):
        seen += len(at)
        deep += int((lcp >= 24).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    grams = Counter(text[k : k + 24].tobytes() for k in range(len(text) - 24))
    assert seen == len(text)
    assert deep == sum(n - 1 for n in grams.values())
    assert peak < 24 * 8 * memory


def test_queues_wait_on_disk():
    queue = induced.TupleQueue(3, 100)
    parts = [np.arange(20 * k, 20 * k + 20) for k in range(30)]
    for p in parts[:15]:
        queue.push(1, p)
        queue.push(2, p)
    assert queue.file is not None and queue.held <= 100
    first = [queue.pop(1)]
    for p in parts[15:]:
        queue.push(1, p)
    while len(got := queue.pop(1)):
        first.append(got)
    assert np.concatenate(first).tolist() == np.concatenate(parts).tolist()
    assert np.concatenate(list(queue.reverse(1))).tolist() == np.concatenate(parts)[::-1].tolist()
    assert not len(queue.pop(0))


def removed(texts, length):
    data = {i: (t or "").encode() for i, t in texts}
    seen = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], mask.astype(int), [0]])) == 1).sum())
        out[i] = (len(b), int(mask.sum()), runs, np.frombuffer(b, np.uint8)[~mask].tobytes())
    return out


@pytest.mark.parametrize(("length", "gram"), [(200, 100), (40, 7), (12, 12)])
def test_remove_repeats(spark, documents, texts, length, gram, monkeypatch):
    monkeypatch.setattr(repeats, "LOT", 2000)
    own = list(enumerate([*texts, "ab" * 300, "xyz" * 100 + "ab" * 150, "q" * 199, "q" * 450]))
    rows = repeats.remove_repeats(documents(dict(own)).repartition(3), length, gram).collect()
    assert {r.doc_id: (r["n_bytes"], r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in rows} == removed(own, length)
    assert all(r.text == (own[r.doc_id][1] or "") and r.lang is None for r in rows)


def test_repeats_within_random_texts(spark, documents):
    r = random.Random(9)
    parts = ["".join(r.choice("abc") for _ in range(30)) for _ in range(12)]
    own = list(enumerate("".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(60)))
    rows = repeats.remove_repeats(documents(dict(own)), 50, 20).collect()
    assert {r.doc_id: (r["n_bytes"], r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in rows} == removed(own, 50)


def test_long_texts_are_cut_alike(spark, documents, monkeypatch):
    monkeypatch.setattr(repeats, "POSITION_BITS", 11)  # pieces of 512 windows
    monkeypatch.setattr(repeats, "SLICE", 100)
    r = random.Random(2)
    a = "".join(r.choice("abcd") for _ in range(3000))
    own = [(0, a + "x" + a[700:1900]), (1, a[100:2000])]
    rows = repeats.remove_repeats(documents(dict(own)), 60, 30).collect()
    assert {r.doc_id: (r["n_bytes"], r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in rows} == removed(own, 60)


def test_repeats_of_nothing_and_repeated_rows(spark, documents):
    assert repeats.remove_repeats(documents([]).limit(0)).count() == 0
    text = "".join(random.Random(1).choice("abcdefg") for _ in range(260))
    docs = documents({1: text, 2: None}).unionByName(documents({1: text}))
    docs = docs.unionByName(docs.selectExpr("cast(null as long) as doc_id", *docs.columns[1:]))
    assert sorted((r.doc_id or 0, r.n_removed) for r in repeats.remove_repeats(docs).collect()) == [(0, 0), (0, 260), (0, 260), (1, 260), (1, 260), (2, 0)]


def shuffled(spark):
    """Bytes that this session's tasks have written for shuffles."""
    time.sleep(0.3)  # counts are brought up to date by tasks that end a while after the last time
    spark.range(1).count()
    found = spark._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_only_texts_of_possible_links_are_moved(spark, documents):
    """Where no side of a join is small, the texts of sets without candidates stay where they are."""
    r = random.Random(8)
    own = {i: " ".join(f"{r.getrandbits(64):x}" for _ in range(400)) for i in range(400)}
    own[1000] = own[7] + " more"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = {x.doc_id: x.component_id for x in minhash.near_duplicates(documents(own)).collect()}
        moved = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {**{i: i for i in own}, 1000: 7}
    assert 0 < moved < sum(map(len, own.values())) / 4


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_the_sieve_keeps_every_text_that_is_needed(spark, documents, words, monkeypatch):
    monkeypatch.setattr(minhash, "SIEVE_WORDS", words)
    docs = documents({i: str(i) for i in range(-500, 1500)}, extra=False)
    kept = {x.doc_id for x in minhash._sieved(docs, docs.where("doc_id % 10 = 0").select("doc_id")).collect()}
    assert kept >= set(range(-500, 1500, 10))
    assert (len(kept) < 210) == (words > 1)
