"""Main text of web pages by the maximum-scoring run of words and tags."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, byte_slices

MAX_PAGES = 400  # bound of the labelled pages that weights are learned from
MAX_KEYS = 20_000  # bound of the counts that are learned from

def _pattern(quotes: str) -> re.Pattern:
    return re.compile(
        r"<!--.*?(?:-->|$)"
        r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|canvas|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|$)"
        r"|<[!?][^>]*(?:>|$)"
        rf"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?>{quotes}[^'\">])*+)>"
        r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)(?:>|$)"
        r"|(?P<text>[^<]+|<)",
        re.S | re.I,
    )


TOKEN, LOOSE = _pattern(r"\"[^\"]*\"|'[^']*'|"), _pattern("")
MAX_BROKEN = 16  # tags whose quotes don't end, after which quotes hide no > any more; each may cost a look at the whole rest
NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PART = re.compile(r"[a-z]+")

# Elements that end a block of text; others, but for br, go on within one.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("article aside body center details dialog div fieldset figure footer form header html label li main menu nav ol section span table td th tr ul button p blockquote h1 h2 h3 h4 h5 h6 pre".split())

# What is known before any page is seen, as (pages inside, pages outside) of main text; counts of labelled pages are added and can outweigh it.
# Words of class, id and role that mostly name other content:
PRIOR_WORDS = dict.fromkeys(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer footers toolbar related recommended recommendations comment comments reply replies respond discussion disqus widget widgets copyright masthead topbar search form toc skip complementary contentinfo".split(),
    (1, 20),
)
# and those that mostly name the main text, or parts of it:
PRIOR_WORDS |= dict.fromkeys("article content main body post entry story text".split(), (4, 1))
PRIOR_TAGS = dict.fromkeys("nav aside footer form menu dialog button label fieldset".split(), (1, 60)) | {"header": (1, 8)} | dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre".split(), (6, 1))
MAIN_WORDS = frozenset("article content main post entry story".split())
MOST = 4.0  # of a name's log odds


@dataclass
class Token:
    key: str
    words: int = 0  # of text; tags have none
    text: str = ""
    block: bool = False  # a tag that ends a block
    gap: bool = False  # a tag that stands for white space
    boiler: bool = False
    inside: bool = False  # in the labelled content
    names: tuple[str, ...] = ()  # of an element that isn't within boilerplate: its tag, and the words of its class, id or role with a dot


def _hints(rest: str) -> list[str]:
    return sorted({p for m in NAMES.finditer(rest) for p in PART.findall(m[1].lower())})


@dataclass
class Weights:
    """What a word or tag adds to a run, and what an element's names say about it.

    Words are positive and tags negative. ``names`` are log odds that an element of this name belongs to the main text; where those of its tag and the mean of those of its words add up to less
    than zero, the element is boilerplate: its words add nothing. A tag's key ends with ``!`` in boilerplate and with ``^`` within an element that says it is the main one. There an
    unknown tag costs little, so an advert between two paragraphs doesn't end the run.
    """

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    names: dict[str, float] = field(default_factory=lambda: learn_names(Counter(), Counter()))

    def of(self, token: Token) -> float:
        if token.key.startswith("w:"):
            return 0.0 if token.boiler else token.words * self.words.get(token.key, 0.5)
        return self.tags.get(token.key, -0.05 if token.key.endswith("^") else -4.0 if token.boiler else -0.5)

    def odds(self, tag: str, hints: list[str]) -> float:
        """Log odds that an element is part of the main text."""
        words = [self.names.get("." + h, 0.0) for h in hints]
        return self.names.get(tag, 0.0) + (sum(words) / len(words) if words else 0.0)


def _pieces(html: str) -> Iterator[re.Match]:
    """Tags and texts in order. Linear: each is looked at once, but for ``MAX_BROKEN`` tags."""
    pattern, at, broken = TOKEN, 0, 0
    while pattern is not None:
        again = None
        for m in pattern.finditer(html, at):
            yield m
            if m["name2"] is not None and pattern is TOKEN:
                broken += 1
                if broken > MAX_BROKEN:
                    again, at = LOOSE, m.end()
                    break
        pattern = again


def tokens(html: str, weights: Weights) -> list[Token]:
    """Words and tags of a page in order; scripts, styles, comments and other raw elements give none."""
    out: list[Token] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements, whether they are boilerplate, and whether they are within a main element
    open_: Counter = Counter()
    articles = 0
    for m in _pieces(html):
        text = m["text"]
        if text is not None:
            boiler = bool(stack) and stack[-1][1]
            out.append(Token(f"w:{stack[-1][0] if stack else ''}{'!' * boiler}", len(text.split()), text, boiler=boiler, inside=articles > 0))
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, end, rest = name.lower(), m["end"] or m["end2"], m["rest"] or m["rest2"] or ""
        if end:
            boiler = False
            if open_[name]:
                while True:
                    other, boiler, _ = stack.pop()
                    open_[other] -= 1
                    if other == name:
                        break
            if name == "article":
                articles = max(0, articles - 1)
            held = bool(stack) and stack[-1][2]
            out.append(Token("/" + name + "^" * held, block=name in BLOCKS, boiler=boiler, inside=articles > 0))
            continue
        hints = _hints(rest) if "=" in rest else []
        if name in BLOCKS and stack and stack[-1][0] == "p":
            open_[stack.pop()[0]] -= 1
        within = bool(stack) and stack[-1][1]
        held = bool(stack) and stack[-1][2]
        tag = "header^" if name == "header" and held else name
        own = name not in ("html", "body", "main", "article") and weights.odds(tag, hints) < 0
        boiler = within or own
        main = not boiler and (name in ("article", "main") or not MAIN_WORDS.isdisjoint(hints))
        key = name + ("!" if boiler else "+" if not MAIN_WORDS.isdisjoint(hints) else "") + "^" * held
        out.append(Token(key, block=name in BLOCKS, gap=name == "br", boiler=boiler, inside=articles > 0, names=() if within else (tag, *("." + h for h in hints))))
        if name in HOLDERS and not rest.rstrip().endswith("/"):
            stack.append((name, boiler, held or main))
            open_[name] += 1
        if name == "article":
            articles += 1
    return out


def labelled(html: str) -> bool:
    """Whether a page marks its own main text: it has exactly one article element with an end."""
    lower = html.lower()
    return lower.count("<article") == 1 and lower.count("</article") == 1


def count_names(html: str) -> tuple[set[str], set[str]]:
    """Names of elements inside and outside of a labelled page's article."""
    inside, outside = set(), set()
    for t in tokens(html, Weights()):
        if t.names and t.names[0] != "article":
            (inside if t.inside else outside).update(t.names)
    return inside, outside


def learn_names(inside: Counter, outside: Counter) -> dict[str, float]:
    """Log odds of names from the pages that have them inside and outside, on top of what is known before (``PRIOR_WORDS``, ``PRIOR_TAGS``).

    Of tags only those with a prior count: others hold anything.
    """
    out = {}
    for name in PRIOR_TAGS.keys() | {"." + w for w in PRIOR_WORDS} | {n for n in inside.keys() | outside.keys() if n.startswith(".")}:
        a, b = PRIOR_WORDS.get(name[1:], (1, 1)) if name.startswith(".") else PRIOR_TAGS[name]
        out[name] = max(-MOST, min(MOST, math.log((inside[name] + a) / (outside[name] + b))))
    return out


def count_tokens(html: str, weights: Weights) -> tuple[Counter, Counter]:
    """How often each word context and tag occurs inside and outside of a labelled page's article."""
    inside, outside = Counter(), Counter()
    for t in tokens(html, weights):
        (inside if t.inside else outside)[t.key] += t.words if t.key.startswith("w:") else 1
    return inside, outside


def learn_weights(inside: Counter, outside: Counter, names: dict[str, float] | None = None) -> Weights:
    """Weights from log odds of being inside: a word's is at least 0.05, a tag's at most -0.05 and at least -8.

    Without counts the defaults of :class:`Weights` hold.
    """
    out = Weights() if names is None else Weights(names=names)
    for kind in (True, False):
        keys = [k for k in inside.keys() | outside.keys() if k.startswith("w:") == kind]
        n_in, n_out = sum(inside[k] for k in keys), sum(outside[k] for k in keys)
        for k in keys:
            odds = math.log((inside[k] + 0.5) / (n_in + 1)) - math.log((outside[k] + 0.5) / (n_out + 1))
            if kind:
                out.words[k] = min(1.0, max(0.05, odds))
            else:
                out.tags[k] = max(-8.0, min(-0.05, odds))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum, the longest at ties; (0, 0) if none is positive."""
    best, at, total, start = (0.0, 0, 0), 0, 0.0, 0
    for at, s in enumerate(scores, 1):
        total += s
        if total < 0:
            total, start = 0.0, at
        elif total > best[0] or total == best[0] > 0 and at - start > best[2] - best[1]:
            best = (total, start, at)
    return best[1], best[2]


def main_text(html: str, weights: Weights) -> str:
    """Blocks of the best run without boilerplate, joined by two line feeds."""
    found = tokens(html, weights)
    start, end = best_run([weights.of(t) for t in found])
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        if text := " ".join(unescape("".join(now)).split()):
            blocks.append(text)
        now.clear()

    for t in found[start:end]:
        if t.block:
            close()
        elif t.boiler:
            continue
        elif t.gap:
            now.append(" ")
        else:
            now.append(t.text)
    close()
    return "\n\n".join(blocks)


def fit_weights(pages: DataFrame, max_pages: int = MAX_PAGES, id_column: str = "page_id", html_column: str = "html") -> Weights:
    """Weights from at most about ``max_pages`` pages that mark their main text, chosen by a hash of id and content.

    Tasks count, first names and then, with what these say, words and tags; the driver gets ``MAX_KEYS`` counts at most, the most frequent ones, and no page.
    """
    html = F.col(html_column).cast("string")
    lower = F.lower(html)
    marked = bound_batches(pages).where(lower.contains("<article") & lower.contains("</article")).select(html.alias("html"), F.xxhash64(F.col(id_column), html).alias("h"))
    chosen = [r["h"] for r in marked.select("h").orderBy("h").limit(max_pages).collect()]
    sample = marked.where(F.col("h") <= chosen[-1]) if len(chosen) == max_pages else marked

    def counts(count) -> tuple[Counter, Counter]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in byte_slices(batch, "html"):
                    inside, outside = Counter(), Counter()
                    for page in part["html"].to_pylist():
                        if labelled(page):
                            a, b = count(page)
                            inside.update(a)
                            outside.update(b)
                    keys = sorted(inside.keys() | outside.keys())
                    yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "inside": pa.array([inside[k] for k in keys], pa.int64()), "outside": pa.array([outside[k] for k in keys], pa.int64())})

        found = sample.select("html").mapInArrow(run, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        rows = found.orderBy(F.desc(F.col("inside") + F.col("outside")), "key").limit(MAX_KEYS).collect() if chosen else []
        return Counter({r["key"]: r["inside"] for r in rows}), Counter({r["key"]: r["outside"] for r in rows})

    names = learn_names(*counts(count_names))
    known = Weights(names=names)
    return learn_weights(*counts(lambda page: count_tokens(page, known)), names)


def extract_pages(pages: DataFrame, weights: Weights, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row.

    Null and empty pages, and those without words, have an empty text. Repeated rows stay; other columns are not read.
    """
    rows = bound_batches(pages).select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "html"):
                texts = [main_text(h, weights) for h in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
