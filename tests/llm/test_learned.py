import math
import random
import time
import zlib
from html import unescape

import numpy as np
import pytest

from loamlog.llm import html, queries, toxicity, vectors

BAD = ["grubby", "rotten", "vile", "foul", "nasty"]


def corpus(n, seed=0):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                text.insert(r.randrange(len(text)), r.choice(BAD))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def tables(spark, n, seed=0):
    docs, labels = corpus(n, seed)
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_held_out_accuracy(spark):
    docs, labels, truth = tables(spark, 900)
    model = toxicity.fit_documents(docs, labels)
    rows = toxicity.score_documents(docs.withColumn("held_out", toxicity.held_out()), model).collect()
    held = [r for r in rows if r.held_out]
    assert 200 < len(held) < 400
    toxic = {i for i, _, t in truth if t}
    caught = sum(r.predicted for r in held if r.doc_id in toxic) / sum(r.doc_id in toxic for r in held)
    wrong = sum(r.predicted for r in held if r.doc_id not in toxic)
    assert caught > 0.9 and wrong <= 2


def test_held_out_labels_are_not_learned(spark):
    docs, labels, _ = tables(spark, 400)
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.fit_documents(docs, labels) == toxicity.fit_documents(docs, flipped)


def test_negative_risk_is_never_rewarded():
    r = np.random.default_rng(0)
    positive = [np.unique(r.integers(0, 50, 6)).astype(np.int32) for _ in range(40)]
    unlabelled = [np.unique(r.integers(0, 500, 20)).astype(np.int32) for _ in range(200)] + positive[:20]
    model = toxicity.fit(positive, unlabelled, 0.1)
    assert all(np.isfinite(list(model.weights.values()))) and np.isfinite(model.threshold)


def test_scores_of_odd_texts(spark, documents, texts):
    docs, labels, _ = tables(spark, 300)
    model = toxicity.fit_documents(docs, labels)
    rows = toxicity.score_documents(documents(texts), model).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if not (texts[r.doc_id] or "").strip()}
    assert len(empty) == 1
    alone = toxicity.score_documents(documents({0: " ".join(BAD * 3)}), model).first()
    assert alone.predicted == 1 and alone.lang is None


def test_without_labels_or_rows(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents({1: "a", 2: None})
    assert toxicity.fit_documents(docs, labels) is None
    assert [r.score for r in toxicity.score_documents(docs, None).collect()] == [0.0, 0.0]
    nulls = spark.createDataFrame([(None, 1), (1, None), (77, 1)], "doc_id long, toxic int")
    assert toxicity.fit_documents(docs, nulls) is None
    assert toxicity.score_documents(docs.limit(0), None).count() == 0


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">home page</a></li><li><a href="/b">other page</a></li></ul></nav><div class="ad">buy this now</div>
<article><h1>Head &amp; more</h1><p>First <b>bold words
 and</b> more&nbsp;words {0}<br>next line<p>Second paragraph without an end {0}<div class="ad">an advert within</div><p>Third &lt;tag&gt; words {0}</p></article>
<section class="comments"><p>I say something about it</p></section><footer>All rights are ours</footer></body></html>"""


def learned(n=30):
    pages = [PAGE.format(f"word{i}") for i in range(n)]

    def total(count):
        sides = html.Counter(), html.Counter()
        for page in pages:
            for side, own in zip(sides, count(page), strict=True):
                side.update(own)
        return sides

    names = html.learn_names(*total(html.count_names))
    return html.learn_weights(*total(lambda page: html.count_tokens(page, html.Weights(names=names))), names)


def test_main_text():
    weights = learned()
    assert html.main_text(PAGE.format("x"), weights) == "Head & more\n\nFirst bold words and more words x next line\n\nSecond paragraph without an end x\n\nThird <tag> words x"
    assert all(w > 0 for w in weights.words.values()) and all(w < 0 for w in weights.tags.values())


def test_main_text_of_another_layout():
    page = '<body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><aside class="sidebar"><p>some words here</p></aside><main><h1>Title</h1><p>One two three four five.</p><form><label>Mail</label><input></form><p>Six seven eight.</p></main><div class="comments"><p>I agree with all of this</p></div><footer>End</footer>'
    assert html.main_text(page, learned()) == "Title\n\nOne two three four five.\n\nSix seven eight."


@pytest.mark.parametrize("page", ["<p class='share-price'>Shares rose again today.</p>", "<p class='comment-free'>Shares rose again today.</p>"])
def test_names_that_only_look_like_boilerplate(page):
    text = "One two three four five six seven."
    for weights in (html.Weights(), learned()):
        assert html.main_text(f"<body><article><p>{text}</p>{page}<p>{text}</p></article></body>", weights) == f"{text}\n\nShares rose again today.\n\n{text}"


def test_counts_outweigh_what_is_known_of_names():
    page = "<body><nav>a b</nav><article><p>One two three.</p><div class='notice'>Four five six.</div></article></body>"
    assert html.main_text(page, html.Weights()) == "One two three."
    names = html.learn_names(html.Counter({".notice": 60}), html.Counter())
    assert html.main_text(page, html.Weights(names=names)) == "One two three.\n\nFour five six."


@pytest.mark.parametrize("piece", ["<div><span>a ", "<p a='", "<b ", "</b>x", "<div class=\"x>", "<a '\">", "<li>x</ul>", "<!-- ", "<script ", "a<"])
def test_broken_pages_take_linear_time(piece):
    def seconds(n):
        began = time.process_time()
        html.main_text(piece * n, html.Weights())
        return time.process_time() - began

    small = max(0.002, min(seconds(4_000) for _ in range(3)))
    assert min(seconds(32_000) for _ in range(2)) < 30 * small


def gold(r, layout):
    """A page and its main text."""
    words = ["".join(r.choice("abcdefghijklmnoprstuw") for _ in range(r.randint(2, 9))) for _ in range(200)]

    def say(a, b):
        return " ".join(r.choice(words) for _ in range(r.randint(a, b))) + "."

    blocks = [("h1", say(3, 8))] + [r.choice([("p", say(15, 60)), ("p", say(15, 60)), ("p", say(4, 12)), ("h2", say(2, 5)), ("blockquote", say(10, 20))]) for _ in range(r.randint(4, 10))] + [("p", say(15, 60))]
    inner = [f"<{t}>{x}</{t}>" for t, x in blocks]
    inner.insert(r.randint(2, len(inner) - 1), r.choice(["", f'<div class="ad-slot advert">{say(4, 9)}</div>', f'<form><label>{say(1, 2)}</label><input><button>go</button></form>', f'<aside><p>{say(5, 15)}</p></aside>']))
    body = "".join(inner)
    menu = "<ul>" + "".join(f'<li><a href="/{k}">{say(1, 2)}</a></li>' for k in range(r.randint(4, 9))) + "</ul>"
    side = f'<div class="sidebar"><h3>{say(1, 3)}</h3>{menu}<p>{say(5, 20)}</p></div>'
    talk = "".join(f'<div class="comment"><b>{say(1, 2)}</b><p>{say(5, 40)}</p></div>' for _ in range(r.randint(0, 5)))
    notice = f'<div id="cookie-notice"><p>{say(8, 20)}</p><button>ok</button></div>'
    foot = f"<footer><p>{say(4, 12)}</p></footer>"
    page = {
        "article": f"<header><h1>{say(1, 3)}</h1></header><nav>{menu}</nav>{notice}<article>{body}</article>{side}<section class='comments'>{talk}</section>{foot}",
        "main": f"<nav>{menu}</nav><main>{body}</main>{side}<div id='comments'>{talk}</div>{foot}",
        "content": f"<div id='header'>{say(1, 4)}</div><div class='menu'>{menu}</div><div class='wrap'><div id='content'>{body}</div>{side}</div><div class='comment-list'>{talk}</div><div id='footer'>{say(4, 12)}</div>",
        "post": f"<div class='topbar'>{menu}</div>{notice}<div class='post-body entry'>{body}</div><div class='share-buttons'>{menu}</div><ol class='replies'>{talk}</ol><div class='site-footer'>{say(3, 9)}</div>",
        "table": f"<table><tr><td class='navigation'>{menu}</td><td>{body}</td></tr></table><div class='footer'>{say(3, 9)}</div>",
        "plain": f"<center>{menu}</center><div>{body}</div><div class='copyright'>{say(3, 9)}</div>",
    }[layout]
    return f"<!DOCTYPE html><html><head><title>{say(2, 5)}</title></head><body>{page}</body></html>", "\n\n".join(x for _, x in blocks)


def overlap(found, want):
    a, b = (html.Counter(x.split()) for x in (found, want))
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


@pytest.mark.parametrize(("layout", "least"), [("article", 0.99), ("main", 0.99), ("content", 0.98), ("post", 0.98), ("table", 0.9), ("plain", 0.9)])
def test_accuracy_on_gold_pages(layout, least):
    """Word F1 against known main texts, with weights from other pages that mark theirs."""
    r = random.Random(layout)
    sides, pages = (html.Counter(), html.Counter()), [gold(r, "article")[0] for _ in range(80)]
    for page in pages:
        for side, own in zip(sides, html.count_names(page), strict=True):
            side.update(own)
    names = html.learn_names(*sides)
    sides = html.Counter(), html.Counter()
    for page in pages:
        for side, own in zip(sides, html.count_tokens(page, html.Weights(names=names)), strict=True):
            side.update(own)
    weights = html.learn_weights(*sides, names)
    scores = [overlap(html.main_text(page, weights), want) for page, want in (gold(r, layout) for _ in range(60))]
    print(layout, sum(scores) / len(scores), min(scores))
    assert sum(scores) / len(scores) >= least


@pytest.mark.parametrize("page", ["", " ", "plain words only", "<", "<p", "<!--", "<script>x", "a < b", "<p>a</p" * 50, "</p></div>", "<div class='x>y'>z"])
def test_odd_pages(page):
    assert isinstance(html.main_text(page, html.Weights()), str)


def test_best_run_is_the_best():
    r = random.Random(1)
    for _ in range(200):
        scores = [r.choice([-3, -1, 0.5, 1, 2]) for _ in range(r.randint(0, 12))]
        start, end = html.best_run(scores)
        assert sum(scores[start:end]) == max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))])


def test_extract_table(spark):
    rows = [(1, "u", PAGE.format("é")), (2, None, None), (3, "u", ""), (1, "u", PAGE.format("é"))]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = html.extract_pages(pages, html.fit_weights(pages)).collect()
    want = "Head & more\n\nFirst bold words and more words é next line\n\nSecond paragraph without an end é\n\nThird <tag> words é"
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
    assert html.extract_pages(pages.limit(0), html.fit_weights(pages.limit(0))).count() == 0


def brute_text(page, weights):
    """Every run of tokens in turn; the first longest one of the best."""
    found = html.tokens(page, weights)
    scores = [weights.of(t) for t in found]
    best, run = 0.0, (0, 0)
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9 or abs(total - best) <= 1e-9 and best > 0 and j + 1 - i > run[1] - run[0]:
                best, run = max(best, total), (i, j + 1)
    blocks, now = [], ""
    for t in [*found[slice(*run)], html.Token("/div", block=True)]:
        if t.block:
            blocks.append(" ".join(unescape(now).split()))
            now = ""
        elif not t.boiler:
            now += " " if t.gap else t.text
    return "\n\n".join(b for b in blocks if b)


def test_the_page_query_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    pages = [gold(r, layout)[0] for layout in ("article", "main", "content", "post", "table", "plain") for _ in range(4)] + ["", None, "words", PAGE.format("z")]
    spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    weights = html.fit_weights(spark.read.parquet(str(tmp_path / "pages.parquet")))
    got = {x.page_id: (x.text, x.n_chars) for x in queries.op5_html(spark, str(tmp_path)).collect()}
    want = {i: brute_text(p or "", weights) for i, p in enumerate(pages)}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_the_toxicity_query_against_brute_force(spark, tmp_path):
    """Scores by each text's distinct features, one text at a time, with the model that the query fits."""
    r = random.Random(4)
    good = [f"word{k}" for k in range(60)]
    texts = {i: " ".join(r.choice(BAD if i % 4 == 0 and r.random() < 0.4 else good) for _ in range(25)) for i in range(240)} | {900: None, 901: "", 902: " ".join(BAD)}
    spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit_documents(*(spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels")))
    got = {x.doc_id: (x.held_out, x.score, x.predicted) for x in queries.op3_toxicity(spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        logit = model.bias + sum(model.weights.get(int(f), 0.0) for f in toxicity.text_features(t))
        score = 1 / (1 + math.exp(-(logit - model.threshold + math.log(0.7 / 0.3))))
        held, found, predicted = got[i]
        assert held == (zlib.crc32(str(i).encode()) % 3 == 1) and found == pytest.approx(score) and predicted == int(found >= 0.7)
    assert got[902][2] == 1 and got[901][2] == got[900][2] == 0


# --- vectors


def brute(rows, threshold):
    fit = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(fit)
    links = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b and len(fit[a]) == len(fit[b]) and fit[a] @ fit[b] / np.linalg.norm(fit[a]) / np.linalg.norm(fit[b]) >= threshold:
                links[a].add(b)
                links[b].add(a)
    root = {i: i for i, _ in rows}
    for _ in ids:
        root |= {i: min([root[i], *(root[j] for j in links[i])]) for i in ids}
    return {i: (len(links.get(i, ())), root[i], root[i] == i) for i, _ in rows if i is not None}


@pytest.mark.parametrize("block", [5, 2048])
def test_vector_links(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 24))
    rows = [(int(i), (centres[i % 12] * r.uniform(0.5, 2) + r.normal(size=24) * r.choice([0.1, 0.3, 0.45, 0.6])).astype(np.float32).tolist()) for i in r.permutation(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(4)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, [1.0, 2.0]), (2005, [2.0, 4.0]), (2006, []), (2007, [float("inf")] * 24)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vectors.vector_links(df, 0.9).collect()}
    want = brute(rows, 0.9)
    assert got == want and sum(n for n, _, _ in want.values()) > 300


def test_bounds_are_rigorous():
    r = np.random.default_rng(5)
    unit = r.normal(size=(300, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    codes, scale, norm, error = vectors.quantise(unit)
    value = vectors.exact_products(codes, codes) * scale[:, None] * scale
    bound = error[:, None] * norm + norm[:, None] * error + error[:, None] * error
    assert (np.abs(value - unit @ unit.T) <= bound + 1e-12).all()
    assert (vectors.exact_products(codes, codes) == codes.astype(np.int64) @ codes.astype(np.int64).T).all()


def test_no_vectors_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.vector_links(empty).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((x.vec_id or 0, x.n_links, x.kept) for x in vectors.vector_links(twice).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 0, True)]
