"""Topics, partitions, topology and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TP
from .scan import watermarks


def discover_partitions(log: DataFrame, partitions: DataFrame, topic: str | None = None) -> DataFrame:
    """First and last sequence number of each registered partition, (0, 0) where it is empty."""
    if topic is not None:
        log, partitions = (d.where(F.col("topic") == topic) for d in (log, partitions))
    return watermarks(log, partitions)


def fill_partitions(found: DataFrame) -> DataFrame:
    """Add the partitions below each topic's largest that are missing, as (0, 0)."""
    ids = found.groupBy("topic").agg(F.max("partition").alias("_most")).select("topic", F.explode(F.sequence(F.lit(0), F.col("_most"))).alias("partition"))
    return ids.join(found, TP, "left").select(*TP, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("first_available", "high_water_mark")))


def discover_topics(partitions: DataFrame, topics: DataFrame) -> DataFrame:
    """Name, whether it is enabled, number of partitions and replication factor of each topic."""
    counts = partitions.groupBy(F.col("topic").alias("name")).agg(F.count_distinct("partition").alias("n"))
    return topics.join(counts, "name", "left").select("name", "enabled", F.coalesce("n", F.lit(0)).cast("long").alias("partitions"), "rf")


def unknown_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """Requests for a topic that isn't there or is disabled."""
    return requests.join(topics.where("enabled").select(F.col("name").alias("topic")), "topic", "left_anti")


def node_available() -> Column:
    """A node with a session and an endpoint."""
    return F.col("session") & F.col("endpoint").isNotNull() & (F.length("endpoint") > 0)


def node_reachable() -> Column:
    return F.col("available") & ~F.col("blocked")


def discover_topology(nodes: DataFrame, replicas: DataFrame) -> DataFrame:
    """Each node with its flags and the number of partitions it has a replica of."""
    counts = replicas.groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(counts, "id", "left").select("id", "endpoint", F.coalesce("n", F.lit(0)).cast("long").alias("partitions"), "available", "blocked")


def status(topics: DataFrame, partitions: DataFrame, nodes: DataFrame, open_partitions: DataFrame) -> DataFrame:
    """One row of counts."""
    parts = [
        topics.agg(F.count(F.lit(1)).alias("topics")),
        partitions.agg(F.count(F.lit(1)).alias("partitions")),
        nodes.agg(F.count_if("available").alias("nodes")),
        open_partitions.agg(F.count(F.lit(1)).alias("open_partitions")),
    ]
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:  # one row each
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")
