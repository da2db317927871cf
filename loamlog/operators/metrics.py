"""Counters, latency histograms and their text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import message_size

# Upper bounds of the latency histogram, in ms.
BOUNDS = [1, 2, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 65, 75, 85, 95, 100, 110, 120, 130, 140, 150, 200, 250, 300, 350, 400, 450, 500]


def bucket(latency_ms: Column, bounds: list[int] | None = None) -> Column:
    """The first bound that isn't less than the latency; null beyond the last, which counts in ``+Inf`` only."""
    out = F.lit(None).cast("int")
    for b in reversed(bounds or BOUNDS):
        out = F.when(latency_ms <= b, b).otherwise(out)
    return out


def topic_counters(log: DataFrame) -> DataFrame:
    """Messages and bytes of each topic."""
    return log.groupBy("topic").agg(F.count(F.lit(1)).alias("msgs_in"), F.sum(message_size(stats=True)).cast("long").alias("bytes_in"))


def latency_counts(latencies: DataFrame, bounds: list[int] | None = None) -> DataFrame:
    return latencies.groupBy("topic", bucket(F.col("latency_ms"), bounds).alias("le")).agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(latencies: DataFrame, bounds: list[int] | None = None) -> DataFrame:
    """Cumulative counts of each topic by bound, from the first that isn't zero on."""
    bounds = bounds or BOUNDS
    counts = latency_counts(latencies, bounds).where("le is not null")
    grid = latencies.select("topic").distinct().withColumn("le", F.explode(F.array(*map(F.lit, bounds))))
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("topic").orderBy("le"))  # at most one row for each bound
    return grid.join(counts, ["topic", "le"], "left").select("topic", "le", total.cast("long").alias("n")).where("n > 0")


def exposition(log: DataFrame, latencies: DataFrame, prefix: str = "loamlog") -> DataFrame:
    """Text lines of the counters (those of zero are left out) and histograms; ``line`` of each ``topic``."""
    counters = topic_counters(log).selectExpr("topic", f"stack(2, '{prefix}_msgs_in', msgs_in, '{prefix}_bytes_in', bytes_in) as (name, value)").where("value > 0")
    label = F.concat(F.lit('{topic="'), F.col("topic"), F.lit('"'))
    lines = counters.select("topic", F.concat("name", label, F.lit("} "), "value").alias("line"))
    le = latency_histogram(latencies).select("topic", F.concat(F.lit(f"{prefix}_latency_bucket"), label, F.lit(',le="'), "le", F.lit('"} '), "n").alias("line"))
    totals = latencies.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("s"))
    rest = totals.select("topic", F.explode(F.array(F.concat(F.lit(f"{prefix}_latency_bucket"), label, F.lit(',le="+Inf"} '), "n"), F.concat(F.lit(f"{prefix}_latency_sum"), label, F.lit("} "), "s"), F.concat(F.lit(f"{prefix}_latency_count"), label, F.lit("} "), "n"))).alias("line"))
    return lines.unionByName(le).unionByName(rest)
