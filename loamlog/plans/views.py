"""Log and metadata views over the generated tables, and the same as SQL.

They stand in for a log's tables in the registered queries: topic = event type, partition = user modulo 4,
seq = place in the partition, key = user, content = props. The log is appended to a store once a session and read from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TP

SEGMENT, BUNDLE = 64, 16

SQL = """
log AS (
  SELECT event_type AS topic, CAST(user_id % 4 AS INT) AS "partition",
         ROW_NUMBER() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) AS seq,
         epoch_us(ts) // 1000 AS ts_ms, CAST(user_id AS VARCHAR) AS key, props AS content, event_id, user_id
  FROM events),
messy AS (
  SELECT topic, "partition", seq, CASE WHEN event_id % 29 = 0 THEN ts_ms - 90000 ELSE ts_ms END AS ts_ms,
         CASE WHEN user_id % 5 <> 0 THEN key END AS key, CASE WHEN event_id % 17 = 0 THEN '' ELSE content END AS content,
         64 * ((seq - 1) // 64) + 1 AS segment_base, 16 * ((seq - 1) // 16) + 1 AS bundle_base
  FROM log WHERE event_id % 7 <> 3),
seg0 AS (
  SELECT topic, "partition", segment_base AS base_seq, max(seq) AS last_seq, min(ts_ms) // 1000 AS created_ts,
         CAST(sum(strlen(content) + coalesce(strlen(key), 0) + 8) AS BIGINT) AS size_bytes
  FROM messy GROUP BY ALL),
segments AS (SELECT *, base_seq < max(base_seq) OVER (PARTITION BY topic, "partition") AS sealed FROM seg0),
parts AS (SELECT DISTINCT topic, "partition" FROM log UNION SELECT DISTINCT topic, 4 AS "partition" FROM log),
marks AS (
  SELECT p.topic, p."partition", coalesce(m.f, 0) AS first_available, coalesce(m.l, 0) AS high_water_mark
  FROM parts p LEFT JOIN (SELECT topic, "partition", min(seq) AS f, max(seq) AS l FROM messy GROUP BY ALL) m USING (topic, "partition")),
nodes AS (
  SELECT n_nationkey + 1 AS id, n_name AS endpoint, n_nationkey % 5 <> 0 AS session, n_nationkey % 5 <> 0 AS available, n_nationkey % 7 = 0 AS blocked,
         CAST(n_nationkey * 7 % 11 AS INT) AS replica_for, CAST(n_nationkey * 3 % 5 AS INT) AS leader_for
  FROM nation),
replicas AS (
  SELECT m.topic, m."partition", CAST(k.k AS INT) AS node_id, k.k = 1 + m."partition" % 3 AS is_leader,
         k.k <> 3 OR m."partition" <> 2 AS in_isr, greatest(m.high_water_mark - k.k * 10, 0) AS last_lsn
  FROM marks m, (VALUES (1), (2), (3)) k(k)),
leaders AS (SELECT topic, "partition", CAST(1 + "partition" % 3 AS INT) AS leader FROM parts),
topics AS (SELECT DISTINCT topic AS name, topic <> 'error' AS enabled, CAST(strlen(topic) % 3 + 1 AS INT) AS rf FROM log),
latency AS (SELECT event_type AS topic, CAST(event_id * 37 % 600 AS INT) AS latency_ms FROM events)
"""


NUMBERED = "topic string, partition int, ts_ms long, key string, content string, event_id long, user_id long, seq long"
_stores: dict[tuple, str] = {}


def sql(query: str) -> str:
    """A query over the views."""
    return f"WITH RECURSIVE {SQL.strip()}\n{query}"


class Views:
    """The views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _append(self, path: str) -> None:
        from ..operators.append import assign_sequences
        from ..schemas import PARTITIONS
        from ..sources.store import append_log

        arrived = self.table("events").select(
            F.col("event_type").alias("topic"),
            (F.col("user_id") % 4).cast("int").alias("partition"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
            F.col("user_id").cast("string").alias("key"),
            F.col("props").alias("content"),
            "event_id",
            "user_id",
        )
        append_log(assign_sequences(arrived, self.spark.createDataFrame([], PARTITIONS), "event_id"), path)

    @property
    def store(self) -> str:
        """Where the log is stored. It is written again if the events' file changes or the store was cleared."""
        from ..sources.store import path_status, scratch

        changed = path_status(self.spark, f"{self.sf_dir}/events.parquet")
        name = (self.spark.sparkContext.applicationId, self.sf_dir, changed)
        if name not in _stores or path_status(self.spark, f"{_stores[name]}/_SUCCESS") is None:
            path = scratch(self.spark, "log")
            self._append(path)
            _stores[name] = path
        return _stores[name]

    @property
    def numbered(self) -> DataFrame:
        """The stored log, with the events' own columns."""
        from ..sources.store import read_log

        return read_log(self.spark, self.store, NUMBERED).select("topic", "partition", "seq", "ts_ms", "key", "content", "event_id", "user_id")

    @property
    def log_stream(self) -> DataFrame:
        """The stored log as a stream."""
        from ..streaming.tail import stream_log

        return stream_log(self.spark, self.store, NUMBERED).select("topic", "partition", "seq", "ts_ms", "key", "content")

    @property
    def log(self) -> DataFrame:
        return self.numbered.drop("event_id", "user_id")

    @property
    def messy(self) -> DataFrame:
        """With gaps, tombstones, messages without a key and times out of order; ``segment_base`` and ``bundle_base``."""
        e = F.col("event_id")
        return self.numbered.where(e % 7 != 3).select(
            *TP,
            "seq",
            F.when(e % 29 == 0, F.col("ts_ms") - 90000).otherwise(F.col("ts_ms")).alias("ts_ms"),
            F.when(F.col("user_id") % 5 != 0, F.col("key")).alias("key"),
            F.when(e % 17 == 0, "").otherwise(F.col("content")).alias("content"),
            (SEGMENT * F.floor((F.col("seq") - 1) / SEGMENT) + 1).cast("long").alias("segment_base"),
            (BUNDLE * F.floor((F.col("seq") - 1) / BUNDLE) + 1).cast("long").alias("bundle_base"),
        )

    @property
    def segments(self) -> DataFrame:
        from ..operators.maintenance import segments_of

        return segments_of(self.messy)

    @property
    def partitions(self) -> DataFrame:
        """Those with messages, and an empty one, 4, of each topic."""
        known = self.log.select(*TP).distinct()
        return known.unionByName(known.select("topic", F.lit(4).alias("partition")).distinct())

    @property
    def marks(self) -> DataFrame:
        from ..operators.scan import watermarks

        return watermarks(self.messy, self.partitions)

    @property
    def nodes(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.table("nation").select((n + 1).cast("int").alias("id"), F.col("n_name").alias("endpoint"), (n % 5 != 0).alias("session"), (n % 5 != 0).alias("available"), (n % 7 == 0).alias("blocked"), (n * 7 % 11).cast("int").alias("replica_for"), (n * 3 % 5).cast("int").alias("leader_for"))

    @property
    def replicas(self) -> DataFrame:
        k = F.col("node_id")
        ids = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("node_id")
        rows = self.marks.select(*TP, "high_water_mark", ids)
        return rows.select(*TP, "node_id", (k == 1 + F.col("partition") % 3).alias("is_leader"), ((k != 3) | (F.col("partition") != 2)).alias("in_isr"), F.greatest(F.col("high_water_mark") - k * 10, F.lit(0)).cast("long").alias("last_lsn"))

    @property
    def leaders(self) -> DataFrame:
        return self.partitions.select(*TP, (1 + F.col("partition") % 3).cast("int").alias("leader"))

    @property
    def topics(self) -> DataFrame:
        t = F.col("topic")
        return self.log.select("topic").distinct().select(t.alias("name"), (t != "error").alias("enabled"), (F.length("topic") % 3 + 1).cast("int").alias("rf"))

    @property
    def latency(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("topic"), (F.col("event_id") * 37 % 600).cast("int").alias("latency_ms"))
