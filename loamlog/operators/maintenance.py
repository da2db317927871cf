"""Compaction, retention and segment statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TP


def sealed(log: DataFrame) -> DataFrame:
    """Messages of sealed segments: all but each partition's last ``segment_base``."""
    active = log.groupBy(*TP).agg(F.max("segment_base").alias("_active"))
    return log.join(active, TP).where(F.col("segment_base") < F.col("_active")).drop("_active")


def has_key() -> Column:
    """An empty key counts as none."""
    return F.coalesce(F.octet_length("key") > 0, F.lit(False))


def compact(log: DataFrame, tombstones: str = "keep") -> DataFrame:
    """The latest message of each key in a partition; messages without a key stay unless they are empty.

    ``tombstones='drop'`` also drops a key whose latest message is empty. A key's messages meet as partial maxima, so a
    key that many messages have is no hot spot.
    """
    if tombstones not in ("keep", "drop"):
        raise ValueError(tombstones)
    values = [c for c in log.columns if c not in (*TP, "key")]
    latest = log.where(has_key()).groupBy(*TP, "key").agg(F.max_by(F.struct(*values), "seq").alias("_m")).select(*TP, "key", *(F.col(f"_m.{c}").alias(c) for c in values)).select(*log.columns)
    if tombstones == "drop":
        latest = latest.where(F.octet_length("content") > 0)
    return latest.unionByName(log.where(~has_key() & (F.octet_length("content") > 0)))


def segments_of(log: DataFrame) -> DataFrame:
    """Segments of a log with ``segment_base``: range, creation second, bytes and whether it is sealed."""
    size = F.octet_length("content") + F.coalesce(F.octet_length("key"), F.lit(0)) + 8
    found = log.groupBy(*TP, F.col("segment_base").alias("base_seq")).agg(F.max("seq").alias("last_seq"), F.floor(F.min("ts_ms") / 1000).cast("long").alias("created_ts"), F.sum(size).cast("long").alias("size_bytes"))
    active = found.groupBy(*TP).agg(F.max("base_seq").alias("_active"))
    return found.join(active, TP).withColumn("sealed", F.col("base_seq") < F.col("_active")).drop("_active")


def retention(segments: DataFrame, max_segments: int = 0, max_bytes: int = 0, max_age_secs: int = 0, now: int = 0) -> DataFrame:
    """Sealed segments with ``dropped``: from the oldest on, while there are too many, too many bytes, or the oldest is too old.

    Windows run over a partition's segments, which are few.
    """
    w = Window.partitionBy(*TP).orderBy("base_seq")
    rest = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left, size = F.count(F.lit(1)).over(rest), F.sum("size_bytes").over(rest)
    over = F.lit(False)
    if max_segments > 0:
        over = over | (left > max_segments)
    if max_bytes > 0:
        over = over | (size > max_bytes)
    if max_age_secs > 0:
        over = over | ((F.col("created_ts") > 0) & (F.col("created_ts") + max_age_secs < now))
    judged = segments.where("sealed").withColumn("_over", over.cast("int"))
    return judged.withColumn("dropped", F.min("_over").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_over")


def first_available(segments: DataFrame, judged: DataFrame) -> DataFrame:
    """The first sequence number that is left after :func:`retention`."""
    gone = judged.where("dropped").select(*TP, "base_seq")
    return segments.join(gone, [*TP, "base_seq"], "left_anti").groupBy(*TP).agg(F.min("base_seq").alias("first_available"))


def cleanable_ratio(segments: DataFrame, cleaned_to: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Share of sealed bytes beyond the last compaction (``cleaned_to``: ``max_seq`` of each partition), and whether to compact."""
    dirty = F.sum(F.when(F.col("base_seq") > F.coalesce("max_seq", F.lit(0)), F.col("size_bytes")).otherwise(0))
    found = segments.where("sealed").join(cleaned_to, TP, "left").groupBy(*TP).agg((dirty / F.sum("size_bytes")).alias("ratio"))
    return found.withColumn("compact", F.col("ratio") >= minimum)


def index_statistics(log: DataFrame) -> DataFrame:
    """Of each segment: bundles, the largest in messages and bytes, and how many have gaps; ``log`` has ``bundle_base``."""
    size = F.octet_length("content") + F.coalesce(F.octet_length("key"), F.lit(0)) + 8
    bundles = log.groupBy(*TP, "segment_base", "bundle_base").agg(F.count(F.lit(1)).alias("msgs"), F.sum(size).alias("bytes"), (F.max("seq") - F.min("seq") + 1 != F.count(F.lit(1))).alias("sparse"))
    return bundles.groupBy(*TP, "segment_base").agg(F.count(F.lit(1)).alias("bundles"), F.max("msgs").alias("max_msgs"), F.max("bytes").cast("long").alias("max_bytes"), F.count_if("sparse").alias("sparse_bundles"))


def frame_offsets(bundles: DataFrame) -> DataFrame:
    """``offset`` of each bundle in its segment: the bytes of those before it."""
    w = Window.partitionBy(*TP, "segment_base").orderBy("bundle_base").rowsBetween(Window.unboundedPreceding, -1)
    return bundles.withColumn("offset", F.coalesce(F.sum("bytes").over(w), F.lit(0)).cast("long"))


def index_violations(index: DataFrame) -> DataFrame:
    """Segments whose index isn't strictly ascending, with the number of entries that break the order."""
    w = Window.partitionBy(*TP, "segment_base").orderBy("nth")
    broken = (F.col("rel_seq") <= F.lag("rel_seq").over(w)) | (F.col("offset") <= F.lag("offset").over(w))
    return index.withColumn("_b", broken).groupBy(*TP, "segment_base").agg(F.count_if("_b").alias("violations")).where("violations > 0")
