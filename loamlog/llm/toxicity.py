"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, byte_slices, discard, stored

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
MAX_POSITIVE, MAX_UNLABELLED = 2000, 16_000  # bound of the rows that a model is fitted on
MAX_FEATURES = 4096  # bound of the features of a model; with the rows it bounds what the driver holds
WORD = re.compile(r"\w+")
CACHE_WORDS = 150_000
Z_SCORE, MIN_DOCUMENTS = 5.0, 4


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_features(chunk: str) -> list[int]:
    """Hashed words and word beginnings of a piece of text."""
    out = []
    for word in WORD.findall(chunk.lower()):
        out.append(xxhash.xxh64_intdigest("=" + word) % BUCKETS)
        out += [xxhash.xxh64_intdigest(str(k) + word[:k]) % BUCKETS for k in PREFIXES if len(word) >= k]
    return out


def text_features(text: str | None) -> np.ndarray:
    """The distinct features of a text, ascending."""
    return np.array(sorted({f for chunk in set((text or "").split()) for f in word_features(chunk)}), np.int32)


@dataclass
class Model:
    """A linear model over the presence of selected features; ``threshold`` is the logit that scores 0.7."""

    weights: dict[int, float]
    bias: float
    threshold: float

    def score(self, logit: np.ndarray | float) -> np.ndarray | float:
        return 1 / (1 + np.exp(-np.clip(logit - self.threshold + np.log(0.7 / 0.3), -500, 500)))


def select_features(positive: np.ndarray, n_positive: int, unlabelled: np.ndarray, n_unlabelled: int) -> np.ndarray:
    """Features that are significantly more frequent in positives than in unlabelled texts; with few texts, those that are somewhat. At most ``MAX_FEATURES``, the most significant ones.

    ``positive`` and ``unlabelled`` are the numbers of texts with each feature.
    """
    p = positive / n_positive
    u = (unlabelled + 0.5) / (n_unlabelled + 1)
    z = (p - u) / np.sqrt(u * (1 - u) / n_positive)
    found = np.flatnonzero((z > Z_SCORE) & (positive >= MIN_DOCUMENTS))
    found = found if len(found) else np.flatnonzero((z > Z_SCORE / 2) & (positive >= 2))
    return np.sort(found[np.argsort(-z[found], kind="stable")[:MAX_FEATURES]])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, chosen: np.ndarray | None = None, steps: int = 1500, batch: int = 512, rate: float = 0.1, decay: float = 1e-4, seed: int = 0) -> Model | None:
    """Fit on features of confirmed positives and of unlabelled texts; ``prior`` is the share of positives among the latter.

    The risk is ``prior * R+(P) + max(0, R-(U) - prior * R-(P))`` under the logistic loss: the second part estimates
    the risk on negatives, of which no example is used. Where it gets negative on a batch, the step goes against its
    gradient instead, so the model can't profit from overfitting the difference. AdaGrad, numpy only.
    Then the threshold is put where the same risk under the 0-1 loss is least, in the middle if that is a range.
    Without positives, unlabelled texts or features there is no model. ``chosen`` are the features to use, by default those
    of :func:`select_features`.
    """
    if not positive or not unlabelled or not any(map(len, positive)):
        return None
    if chosen is None:
        counts = (np.bincount(np.concatenate(rows), minlength=BUCKETS) for rows in (positive, unlabelled))
        chosen = select_features(next(counts), len(positive), next(counts), len(unlabelled))
    if not len(chosen):
        return None
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))

    def compact(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(x := place[r])[x >= 0] for r in rows]
        sizes = np.array([len(x) for x in found])
        return np.concatenate(found), np.cumsum(sizes) - sizes, sizes

    def part(data: tuple, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, starts, sizes = data
        own = sizes[rows]
        ends = np.cumsum(own)
        picked = np.repeat(starts[rows] - (ends - own), own) + np.arange(int(ends[-1]))
        return flat[picked], np.repeat(np.arange(len(rows)), own)

    def logits(features: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, weights[features], n) + bias

    p_data, u_data = compact(positive), compact(unlabelled)
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    squares, bias_squares = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(steps):
        u_rows, p_rows = rng.integers(0, len(unlabelled), batch), rng.integers(0, len(positive), batch // 2)
        (uf, ur), (pf, pr) = part(u_data, u_rows), part(p_data, p_rows)
        zu, zp = logits(uf, ur, len(u_rows)), logits(pf, pr, len(p_rows))
        su, sp = 1 / (1 + np.exp(-zu)), 1 / (1 + np.exp(-zp))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            gu, gp = su / len(zu), (prior * (sp - 1) - prior * sp) / len(zp)
        else:
            gu, gp = -su / len(zu), prior * sp / len(zp)
        gradient = np.bincount(uf, gu[ur], len(chosen)) + np.bincount(pf, gp[pr], len(chosen)) + decay * weights
        squares += gradient**2
        weights -= rate * gradient / np.sqrt(squares)
        step = gu.sum() + gp.sum()
        bias_squares += step**2
        bias -= rate * step / np.sqrt(bias_squares)
    zp, zu = (np.sort(logits(*part(d, np.arange(len(d[2]))), len(d[2]))) for d in (p_data, u_data))
    cuts = np.unique(np.concatenate([zp, zu]))
    cuts = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    missed, caught = np.searchsorted(zp, cuts) / len(zp), 1 - np.searchsorted(zu, cuts) / len(zu)
    risk = prior * missed + np.maximum(0, caught - prior * (1 - missed))
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return Model(dict(zip(chosen.tolist(), weights.tolist(), strict=True)), bias, float((cuts[best[0]] + cuts[best[-1]]) / 2))


FIT_TASKS = 32  # that the texts to be fitted on are dealt to


def _featured(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``features`` (packed) of a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([text_features(t).tobytes() for t in part["text"].to_pylist()], pa.binary())], names=["doc_id", "features"])

    return df.select("doc_id", "text").repartition(FIT_TASKS, "doc_id").mapInArrow(run, "doc_id long, features binary")


def _counts(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and of those with each feature, counted in tasks; the driver gets at most ``BUCKETS`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(BUCKETS, np.int32), 0
        for batch in batches:
            n += len(batch)
            for packed in batch["features"].to_pylist():
                found[np.frombuffer(packed, np.int32)] += 1
        own = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1), pa.int32()), pa.array(np.append(found[own], n), pa.int64())], names=["feature", "n"])

    got = rows.select("features").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = got["feature"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    out[feature[feature >= 0]] = n[feature >= 0]
    return int(n[feature < 0].sum()), out


def _features(rows: DataFrame, chosen: np.ndarray) -> list[np.ndarray]:
    """Which of the ``chosen`` features each row has, on the driver, in order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(BUCKETS, bool)
        wanted[chosen] = True
        for batch in batches:
            found = [x[wanted[x]].tobytes() for x in (np.frombuffer(p, np.int32) for p in batch["features"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary())], names=["doc_id", "features"])

    found = rows.mapInArrow(run, "doc_id long, features binary").collect()
    return [np.frombuffer(r["features"], np.int32) for r in sorted(found, key=lambda r: (r["doc_id"], bytes(r["features"])))]


def _least(rows: DataFrame, bound: int) -> DataFrame:
    """The ``bound`` rows with the least ``h``, of which the driver sees these numbers alone; only equal rows share one, so it makes no difference which of them are left out."""
    least = [r["h"] for r in rows.select("h").orderBy("h").limit(bound).collect()]
    return rows.where(F.col("h") <= least[-1]).limit(bound) if len(least) == bound else rows


def fit_documents(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, id_column: str = "doc_id", text_column: str = "text") -> Model | None:
    """Fit on documents and ``labels`` (``doc_id``, ``toxic``) that :func:`held_out` doesn't keep away.

    At most ``max_positive`` rows labelled toxic and ``max_unlabelled`` rows of any kind, chosen by a hash of id and text, are
    fitted on, with at most ``MAX_FEATURES`` features; the class prior comes from all labels that may be learned from. A document counts as toxic if any of its
    labels says so; null labels and labels of no document count for nothing.
    """
    texts = bound_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where(~held_out() & F.col("doc_id").isNotNull())
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held_out())
    rows = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")).first()
    if not rows["toxic"]:
        return None
    prior = min(0.95, max(0.001, rows["toxic"] / rows["n"]))
    texts = texts.withColumn("h", F.xxhash64("doc_id", "text", F.lit("sample")))
    ids = _least(known.where("toxic = 1").select("doc_id", F.xxhash64("doc_id", F.lit("sample")).alias("h")), max_positive)
    positive = stored(_featured(_least(texts.join(ids.select("doc_id"), "doc_id", "left_semi"), max_positive)), "positive")
    unlabelled = stored(_featured(_least(texts, max_unlabelled)), "unlabelled")
    (n_positive, p), (n_unlabelled, u) = _counts(positive), _counts(unlabelled)
    if not n_positive or not n_unlabelled:
        return None
    chosen = select_features(p, n_positive, u, n_unlabelled)
    found = _features(positive, chosen), _features(unlabelled, chosen)
    discard(positive, unlabelled)
    return fit(*found, prior, chosen)


def score_documents(docs: DataFrame, model: Model | None, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (score at least ``threshold``) to each row, from its whole text alone.

    Columns of these names are replaced, others stay. Null and empty texts have the score of a text without any feature.
    Without a model every score is 0.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        weights = model.weights if model else {}
        for batch in batches:
            for part in byte_slices(batch, text_column):
                logit = np.zeros(len(part))
                if model:
                    split = pc.ascii_split_whitespace(pc.fill_null(part[text_column], ""))
                    coded = pc.list_flatten(split).dictionary_encode()
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    words = coded.dictionary.to_pylist()
                    for w in words:
                        if w not in known:
                            known[w] = tuple(f for f in word_features(w) if f in weights)
                    telling = np.fromiter((bool(known[w]) for w in words), bool, len(words))
                    codes = coded.indices.to_numpy(zero_copy_only=False)
                    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))])
                    at = np.flatnonzero(telling[codes])
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    seen: dict[int, set[int]] = {}
                    for d, c in set(zip(doc.tolist(), codes[at].tolist(), strict=True)):
                        seen.setdefault(d, set()).update(known[words[c]])
                    for d, features in seen.items():
                        logit[d] = sum(weights[f] for f in sorted(features))
                    score = model.score(logit + model.bias)
                else:
                    score = logit
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(score, pa.float64()), pa.array(score >= threshold).cast(pa.int32())], names=[*kept, "score", "predicted"])

    rows = bound_batches(docs).select(*kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, score double, predicted int")
