"""Registered queries of the log operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import append as W
from ..operators import cluster as C
from ..operators import maintenance as M
from ..operators import metadata as D
from ..operators import metrics as G
from ..operators import scan as S
from ..schemas import TP
from .views import Views, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

T0 = 1704067200000  # 2024-01-01T00:00:00Z
DAY = 86400000
TPQ = 'topic, "partition"'


def query(oracle: str | None = None):
    """Register a function of :class:`Views` under its name, with SQL over the views."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


def names(df: DataFrame, **renames: str) -> DataFrame:
    return df.withColumnsRenamed(renames)


MSG = 'topic, "partition", seq, ts_ms, key, content'


# --- scans


def _sources(v: Views, column: str = "start_seq") -> DataFrame:
    return v.partitions.withColumn(column, (F.col("partition") * 7 + 3).cast("long"))


SOURCES = 'src AS (SELECT topic, "partition", CAST("partition" * 7 + 3 AS BIGINT) AS start_seq FROM parts)'


def with_cte(cte: str, select: str) -> str:
    return f", {cte} {select}"


@query(with_cte(SOURCES, f'SELECT {MSG} FROM log JOIN src USING (topic, "partition") WHERE seq >= start_seq'))
def S1_consume(v: Views) -> DataFrame:
    return S.consume(v.log, _sources(v))


@query(f"SELECT {MSG} FROM log WHERE topic = 'view' AND \"partition\" = 1 AND seq >= 50")
def S2_consume_from(v: Views) -> DataFrame:
    return S.consume_from(v.log, "view", 1, 50)


@query("SELECT 'beginning' AS spec, CAST(0 AS BIGINT) AS start_seq UNION ALL SELECT 'eof', (SELECT max(seq) + 1 FROM log WHERE topic = 'view' AND \"partition\" = 0) UNION ALL SELECT '42', 42")
def S3_start_spec(v: Views) -> DataFrame:
    end = S.of_partition(v.log, "view", 0).agg((F.max("seq") + 1).alias("end"))
    specs = v.spark.createDataFrame([(t, None if (s := S.start_spec(t)) == S.EOF else s) for t in ("beginning", "eof", "42")], "spec string, at long")
    return specs.join(F.broadcast(end)).select("spec", F.coalesce("at", "end").cast("long").alias("start_seq"))  # one row


@query(
    """, r AS (SELECT topic, "partition", CAST(unnest([0, 1, 5, 60, 100000]) AS BIGINT) AS s FROM parts),
    j AS (SELECT r.*, first_available AS f, high_water_mark AS l, high_water_mark AS m FROM r LEFT JOIN marks USING (topic, "partition")),
    o AS (SELECT *, CASE WHEN s = 0 AND f = 0 THEN 'eof' WHEN s = 0 THEN 'read' WHEN s = l + 1 THEN 'eof' WHEN s > m THEN 'past_max' WHEN s > l OR s < f THEN 'boundary' ELSE 'read' END AS outcome FROM j)
    SELECT topic, "partition", s AS start_seq, outcome, CASE WHEN s = 0 AND outcome = 'read' THEN f ELSE s END AS read_from FROM o"""
)
def S4_resolve_offsets(v: Views) -> DataFrame:
    requests = v.partitions.withColumn("start_seq", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 1, 5, 60, 100000)))))
    marks = v.marks.select(*TP, "first_available", F.col("high_water_mark").alias("last_assigned"), F.col("high_water_mark").alias("max_seq"))
    return S.resolve_offsets(requests, marks)


@query(with_cte('t AS (SELECT DISTINCT topic, "partition", CAST(unnest([1, 64, 65, 90, 100000]) AS BIGINT) AS target FROM marks)', 'SELECT topic, "partition", target, min(base_seq) AS base_seq FROM t JOIN segments USING (topic, "partition") WHERE last_seq >= target GROUP BY ALL'))
def S6_segment_lookup(v: Views) -> DataFrame:
    targets = v.partitions.withColumn("target", F.explode(F.array(*(F.lit(x).cast("long") for x in (1, 64, 65, 90, 100000)))))
    return S.covering_segments(v.segments, targets)


@query(with_cte('t AS (SELECT topic, "partition", CAST(unnest([3, 17, 50, 100000]) AS BIGINT) AS target FROM parts)', 'SELECT topic, "partition", target, max(bundle_base) AS bundle_base FROM t JOIN messy USING (topic, "partition") WHERE bundle_base <= target GROUP BY ALL'))
def S7_range_start(v: Views) -> DataFrame:
    return S.covering_bundles(v.messy, v.partitions.withColumn("target", F.explode(F.array(*(F.lit(x).cast("long") for x in (3, 17, 50, 100000))))))


@query('SELECT topic, "partition", seq FROM (SELECT *, sum(strlen(content) + coalesce(strlen(key), 0) + 8) OVER (PARTITION BY topic, "partition" ORDER BY seq) - (strlen(content) + coalesce(strlen(key), 0) + 8) AS ahead FROM messy) WHERE ahead < 1000')
def S8_range_end(v: Views) -> DataFrame:
    return S.page_by_bytes(v.messy, 1000).select(*TP, "seq")


@query('SELECT topic, "partition", seq, content FROM log ORDER BY topic, "partition", seq')
def S11_foreach_message(v: Views) -> DataFrame:
    return v.log.select(*TP, "seq", "content").orderBy(*TP, "seq")


@query('SELECT topic, "partition", max(seq) AS last_seq FROM messy GROUP BY ALL')
def S15_tail_position(v: Views) -> DataFrame:
    return v.messy.groupBy(*TP).agg(F.max("seq").alias("last_seq"))


@query('SELECT topic, "partition", first_available, high_water_mark, s, CASE WHEN s < first_available THEN first_available WHEN s > high_water_mark THEN high_water_mark + 1 ELSE s END AS clamped FROM marks, (SELECT CAST(unnest([0, 15, 99999]) AS BIGINT) AS s)')
def S17_X23_clamp(v: Views) -> DataFrame:
    rows = v.marks.withColumn("s", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 15, 99999)))))
    return rows.withColumn("clamped", S.clamp_seq(F.col("s"), F.col("first_available"), F.col("high_water_mark")))


# --- predicates, limits and projections


@query(f'SELECT {MSG} FROM log JOIN marks USING (topic, "partition") WHERE seq <= high_water_mark - 10')
def F2_committed(v: Views) -> DataFrame:
    marks = v.marks.select(*TP, (F.col("high_water_mark") - 10).alias("_to"))
    return v.log.join(marks, TP).where("seq <= _to").drop("_to")


@query(f"SELECT {MSG} FROM log WHERE topic = 'view' AND \"partition\" = 2 AND seq BETWEEN 5 AND 60")
def F3_end_seq(v: Views) -> DataFrame:
    return S.consume_from(v.log, "view", 2, 5, end_seq=60)


@query(f"SELECT {MSG} FROM messy WHERE ts_ms >= {T0 + 3 * DAY} AND ts_ms < {T0 + 9 * DAY}")
def F4_time_range(v: Views) -> DataFrame:
    return v.messy.where(S.in_time_range(T0 + 3 * DAY, T0 + 9 * DAY)).select(*TP, "seq", "ts_ms", "key", "content")


@query(f"SELECT {MSG} FROM log WHERE contains(content, ': 8')")
def F5_substring(v: Views) -> DataFrame:
    return v.log.where(S.content_contains(": 8"))


@query(f'SELECT {MSG} FROM messy m WHERE NOT EXISTS (SELECT 1 FROM messy o WHERE o.topic = m.topic AND o."partition" = m."partition" AND o.seq <= m.seq AND (o.seq > 80 OR o.ts_ms >= {T0 + 20 * DAY}))')
def F6_prefix_stop(v: Views) -> DataFrame:
    return S.prefix_stop(v.messy, 80, T0 + 20 * DAY).select(*TP, "seq", "ts_ms", "key", "content")


@query(f"SELECT {MSG} FROM log WHERE topic IN (SELECT name FROM topics WHERE enabled)")
def F8_enabled(v: Views) -> DataFrame:
    return v.log.join(v.topics.where("enabled").select(F.col("name").alias("topic")), "topic", "left_semi")


@query("SELECT id, session AND endpoint IS NOT NULL AND strlen(endpoint) > 0 AS available, session AND endpoint IS NOT NULL AND strlen(endpoint) > 0 AND NOT blocked AS reachable FROM nodes")
def F9_node_flags(v: Views) -> DataFrame:
    return v.nodes.withColumn("available", D.node_available()).select("id", "available", D.node_reachable().alias("reachable"))


@query("SELECT 'conf/' || name AS key, modify_index FROM (SELECT s_name AS name, s_suppkey AS modify_index FROM supplier) WHERE strlen(name) BETWEEN 1 AND 64 AND modify_index > 5")
def F10_kv_filter(v: Views) -> DataFrame:
    kv = v.table("supplier").select(F.concat(F.lit("conf/"), "s_name").alias("key"), F.col("s_suppkey").alias("modify_index"))
    return C.kv_changes(kv.unionByName(kv.withColumn("key", F.concat(F.lit("other/"), "key"))), "conf/", 5)


@query(f"SELECT {MSG} FROM log WHERE topic = 'click' AND \"partition\" = 0 AND seq >= 10 AND contains(content, '1') ORDER BY seq LIMIT 25")
def O2_limit(v: Views) -> DataFrame:
    return S.consume_from(v.log, "click", 0, 10, contains="1", limit=25)


def _pages(size: int) -> str:
    return f'SELECT topic, "partition", count(*) AS messages, max(seq) AS last_seq FROM (SELECT *, sum(strlen(content) + coalesce(strlen(key), 0) + 8) OVER (PARTITION BY topic, "partition" ORDER BY seq) - (strlen(content) + coalesce(strlen(key), 0) + 8) AS ahead FROM log) WHERE ahead < {size} GROUP BY ALL'


@query(_pages(2000))
def O3_A3_page(v: Views) -> DataFrame:
    return S.page_by_bytes(v.log, 2000).groupBy(*TP).agg(F.count(F.lit(1)).alias("messages"), F.max("seq").alias("last_seq"))


@query("SELECT topic, \"partition\", seq, 'ts:' || strftime(make_timestamp(ts_ms * 1000), '%Y.%m.%d %H:%M:%S') || ' ts_ms:' || ts_ms || ' seq=' || seq || ': size=' || strlen(content) || ': [' || coalesce(key, '') || ']: ' || content AS line FROM messy")
def P1_P2_render(v: Views) -> DataFrame:
    return S.render(v.messy, ("content", "key", "size", "seqnum", "ts", "ts_ms"))


@query("SELECT topic, \"partition\", seq, seq || ' [' || coalesce(key, '') || '] = [' || content || ']' AS line FROM messy")
def P3_render_key_value(v: Views) -> DataFrame:
    return S.render_key_value(v.messy)


@query("SELECT topic, \"partition\", seq, '' AS line FROM log")
def P4_ignore(v: Views) -> DataFrame:
    return S.render(v.log, ("ignore",))


@query('SELECT topic, "partition", seq, CAST(strlen(content) AS BIGINT) AS size, CAST(strlen(content) + coalesce(strlen(key), 0) + 8 AS BIGINT) AS stats_size FROM messy')
def P5_size(v: Views) -> DataFrame:
    return v.messy.select(*TP, "seq", S.message_size().alias("size"), S.message_size(stats=True).alias("stats_size"))


@query()
def P6_time_since(v: Views) -> DataFrame:
    return S.render(v.log, ("time_since",))


# --- metadata and statistics


@query("SELECT count(*) AS messages, CAST(sum(strlen(content) + coalesce(strlen(key), 0) + 8) AS BIGINT) AS bytes FROM messy WHERE contains(content, '1')")
def A1_A2_stats(v: Views) -> DataFrame:
    return v.messy.where(S.content_contains("1")).agg(F.count(F.lit(1)).alias("messages"), F.sum(S.message_size(stats=True)).alias("bytes"))


@query('SELECT topic, "partition", first_available, high_water_mark FROM marks')
def A4_discover_partitions(v: Views) -> DataFrame:
    return D.discover_partitions(v.messy, v.partitions)


@query('SELECT name, enabled, (SELECT count(*) FROM parts WHERE topic = name) AS partitions, rf FROM topics')
def A5_discover_topics(v: Views) -> DataFrame:
    return D.discover_topics(v.partitions, v.topics)


@query("SELECT id, endpoint, (SELECT count(*) FROM replicas WHERE node_id = id) AS partitions, available, blocked FROM nodes")
def A6_discover_topology(v: Views) -> DataFrame:
    return D.discover_topology(v.nodes, v.replicas)


@query("SELECT (SELECT count(*) FROM topics) AS topics, (SELECT count(*) FROM parts) AS partitions, (SELECT count(*) FROM nodes WHERE available) AS nodes, (SELECT count(*) FROM marks WHERE high_water_mark > 0) AS open_partitions")
def A7_A9_status(v: Views) -> DataFrame:
    return D.status(v.topics, v.partitions, v.nodes, v.marks.where("high_water_mark > 0"))


@query('SELECT t.topic, CAST(g.g AS INT) AS "partition", coalesce(first_available, 0) AS first_available, coalesce(high_water_mark, 0) AS high_water_mark FROM (SELECT DISTINCT topic FROM parts) t, range(5) g(g) LEFT JOIN (SELECT * FROM marks WHERE "partition" <> 2) m ON m.topic = t.topic AND m."partition" = g.g')
def A8_fill_partitions(v: Views) -> DataFrame:
    return D.fill_partitions(v.marks.where("partition <> 2"))


@query("SELECT topic, count(*) AS msgs_in, CAST(sum(strlen(content)) AS BIGINT) AS bytes_in FROM messy GROUP BY ALL".replace("strlen(content)", "strlen(content) + coalesce(strlen(key), 0) + 8"))
def A10_counters(v: Views) -> DataFrame:
    return G.topic_counters(v.messy)


_BOUNDS = "1, 2, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 65, 75, 85, 95, 100, 110, 120, 130, 140, 150, 200, 250, 300, 350, 400, 450, 500"


@query(f"SELECT topic, (SELECT min(b) FROM unnest([{_BOUNDS}]) u(b) WHERE b >= latency_ms) AS le, count(*) AS n FROM latency GROUP BY ALL")
def A11_latency_buckets(v: Views) -> DataFrame:
    return G.latency_counts(v.latency)


@query(f"SELECT * FROM (SELECT topic, b AS le, (SELECT count(*) FROM latency l WHERE l.topic = t.topic AND l.latency_ms <= b) AS n FROM (SELECT DISTINCT topic FROM latency) t, unnest([{_BOUNDS}]) u(b)) WHERE n > 0")
def A12_N10_latency_histogram(v: Views) -> DataFrame:
    return G.latency_histogram(v.latency)


@query(
    f""", h AS (SELECT topic, b AS le, (SELECT count(*) FROM latency l WHERE l.topic = t.topic AND l.latency_ms <= b) AS n FROM (SELECT DISTINCT topic FROM latency) t, unnest([{_BOUNDS}]) u(b)),
    m AS (SELECT topic, count(*) AS n, sum(strlen(content) + coalesce(strlen(key), 0) + 8) AS b FROM messy GROUP BY ALL),
    t AS (SELECT topic, count(*) AS n, sum(latency_ms) AS s FROM latency GROUP BY ALL)
    SELECT topic, 'loamlog_msgs_in{{topic="' || topic || '"}} ' || n AS line FROM m UNION ALL SELECT topic, 'loamlog_bytes_in{{topic="' || topic || '"}} ' || b FROM m
    UNION ALL SELECT topic, 'loamlog_latency_bucket{{topic="' || topic || '",le="' || le || '"}} ' || n FROM h WHERE n > 0
    UNION ALL SELECT topic, 'loamlog_latency_bucket{{topic="' || topic || '",le="+Inf"}} ' || n FROM t
    UNION ALL SELECT topic, 'loamlog_latency_sum{{topic="' || topic || '"}} ' || s FROM t UNION ALL SELECT topic, 'loamlog_latency_count{{topic="' || topic || '"}} ' || n FROM t"""
)
def W13_exposition(v: Views) -> DataFrame:
    return G.exposition(v.messy, v.latency)


@query(
    f"""SELECT {MSG}, segment_base, bundle_base FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY topic, "partition", key ORDER BY seq DESC) AS rn FROM
        (SELECT m.*, max(segment_base) OVER (PARTITION BY topic, "partition") AS active FROM messy m) WHERE segment_base < active)
      WHERE CASE WHEN coalesce(key, '') = '' THEN content <> '' ELSE rn = 1 END"""
)
def A13_compact(v: Views) -> DataFrame:
    return M.compact(M.sealed(v.messy))


@query(
    f"""SELECT {MSG}, segment_base, bundle_base FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY topic, "partition", key ORDER BY seq DESC) AS rn FROM messy)
      WHERE content <> '' AND (coalesce(key, '') = '' OR rn = 1)"""
)
def A13_compact_drop(v: Views) -> DataFrame:
    return M.compact(v.messy, tombstones="drop")


_NOW = T0 // 1000 + 30 * 86400
_RETENTION = f"""
 , c AS (SELECT *, CAST((count(*) OVER w > 2) OR (sum(size_bytes) OVER w > 3000) OR (created_ts > 0 AND created_ts + 1209600 < {_NOW}) AS INT) AS c
   FROM segments WHERE sealed WINDOW w AS (PARTITION BY topic, "partition" ORDER BY base_seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 judged AS (SELECT topic, "partition", base_seq, last_seq, min(c) OVER (PARTITION BY topic, "partition" ORDER BY base_seq ROWS UNBOUNDED PRECEDING) = 1 AS dropped FROM c)"""


@query(f"{_RETENTION} SELECT * FROM judged")
def A14_N8_retention(v: Views) -> DataFrame:
    return M.retention(v.segments, 2, 3000, 1209600, _NOW).select(*TP, "base_seq", "last_seq", "dropped")


@query(f'{_RETENTION} SELECT topic, "partition", min(base_seq) AS first_available FROM segments s WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.topic = s.topic AND j."partition" = s."partition" AND j.base_seq = s.base_seq AND dropped) GROUP BY ALL')
def A14_first_available(v: Views) -> DataFrame:
    segments = v.segments
    return M.first_available(segments, M.retention(segments, 2, 3000, 1209600, _NOW))


@query('SELECT topic, "partition", sum(CASE WHEN base_seq > 65 THEN size_bytes ELSE 0 END) / sum(size_bytes) AS ratio, sum(CASE WHEN base_seq > 65 THEN size_bytes ELSE 0 END) / sum(size_bytes) >= 0.5 AS compact FROM segments WHERE sealed GROUP BY ALL')
def A15_cleanable_ratio(v: Views) -> DataFrame:
    return M.cleanable_ratio(v.segments, v.partitions.withColumn("max_seq", F.lit(65).cast("long")))


@query('SELECT topic, "partition", min(last_lsn) AS high_water_mark FROM replicas WHERE in_isr AND NOT is_leader AND last_lsn > 0 GROUP BY ALL')
def A16_commit_mark(v: Views) -> DataFrame:
    return C.commit_mark(v.replicas)


_ACKS = "SELECT CAST(a AS INT) AS asked, CAST(r AS INT) AS rf, CAST(i AS INT) AS isr FROM unnest([0, 1, 2, 201, 255]) x(a), range(1, 6) y(r), range(1, 6) z(i)"


def _acks(v: Views) -> DataFrame:
    r = v.spark.range(125).select((F.col("id") % 5 + 1).cast("int").alias("isr"), (F.floor(F.col("id") / 5) % 5 + 1).cast("int").alias("rf"), F.element_at(F.array(*map(F.lit, (0, 1, 2, 201, 255))), (F.floor(F.col("id") / 25) + 1).cast("int")).alias("asked"))
    return r.select("asked", "rf", "isr")


@query(with_cte(f"acks AS ({_ACKS})", "SELECT asked, rf, isr, CAST(CASE WHEN asked = 0 THEN least(rf, isr) - 1 WHEN asked = 255 THEN (least(rf, isr) - 1) // 2 + 1 ELSE asked END AS INT) AS needed FROM acks"))
def A17_required_acks(v: Views) -> DataFrame:
    return _acks(v).withColumn("needed", C.required_acks(F.col("asked"), F.col("rf"), F.col("isr")))


@query(
    """, g AS (SELECT topic, "partition", list_sort(list(last_lsn)) AS l FROM replicas WHERE NOT is_leader GROUP BY ALL),
    k AS (SELECT *, CAST(unnest([0, 1, 2, 3]) AS INT) AS needed FROM g), s AS (SELECT *, CAST(l[2] AS BIGINT) AS seq FROM k)
    SELECT topic, "partition", needed, seq, CASE WHEN needed > len(l) THEN true WHEN needed = 0 THEN false ELSE l[1] >= seq END AS least,
      CASE WHEN needed > len(l) THEN true WHEN needed = 0 THEN false ELSE l[len(l) - needed + 1] >= seq END AS "any" FROM s"""
)
def A18_T11_confirmed(v: Views) -> DataFrame:
    lsns = v.replicas.where("not is_leader").groupBy(*TP).agg(F.sort_array(F.collect_list("last_lsn")).alias("l"))
    rows = lsns.withColumn("needed", F.explode(F.array(*map(F.lit, (0, 1, 2, 3))))).withColumn("seq", F.element_at("l", 2))
    return rows.select(*TP, "needed", "seq", *(C.confirmed(F.col("l"), F.col("needed"), F.col("seq"), mode).alias(mode) for mode in ("least", "any")))


@query(with_cte(f"acks AS ({_ACKS})", "SELECT asked, rf, isr, asked > 200 OR asked + 1 > rf OR asked + 1 > isr AS insufficient FROM acks"))
def A19_insufficient_replicas(v: Views) -> DataFrame:
    return _acks(v).withColumn("insufficient", C.insufficient_replicas(F.col("asked"), F.col("rf"), F.col("isr")))


_BUNDLES = 'b AS (SELECT topic, "partition", segment_base, bundle_base, count(*) AS msgs, CAST(sum(strlen(content) + coalesce(strlen(key), 0) + 8) AS BIGINT) AS bytes, max(seq) - min(seq) + 1 <> count(*) AS sparse FROM messy GROUP BY ALL)'


def _bundles(v: Views) -> DataFrame:
    return v.messy.groupBy(*TP, "segment_base", "bundle_base").agg(F.sum(S.message_size(stats=True)).cast("long").alias("bytes"))


@query(with_cte(_BUNDLES, 'SELECT topic, "partition", segment_base, count(*) AS bundles, max(msgs) AS max_msgs, max(bytes) AS max_bytes, count(*) FILTER (sparse) AS sparse_bundles FROM b GROUP BY ALL'))
def A20_A21_index_statistics(v: Views) -> DataFrame:
    return M.index_statistics(v.messy)


# --- windows


@query('SELECT topic, "partition", prev AS after, seq AS "before", seq - prev - 1 AS missing FROM (SELECT *, lag(seq) OVER (PARTITION BY topic, "partition" ORDER BY seq) AS prev FROM messy) WHERE seq - prev > 1')
def N1_gaps(v: Views) -> DataFrame:
    return S.gaps(v.messy)


@query('SELECT topic, "partition", seq, seq - lag(seq) OVER w - 1 AS delta, coalesce(ts_ms = lag(ts_ms) OVER w, false) AS same_ts FROM (SELECT topic, "partition", seq, ts_ms // 60000 * 60000 AS ts_ms FROM messy) WINDOW w AS (PARTITION BY topic, "partition" ORDER BY seq)')
def N2_N3_delta(v: Views) -> DataFrame:
    return S.delta_encoded(v.messy.withColumn("ts_ms", (F.floor(F.col("ts_ms") / 60000) * 60000).cast("long")))


@query('SELECT topic, "partition", bundle_base, content, bundle_base + ROW_NUMBER() OVER (PARTITION BY topic, "partition", bundle_base ORDER BY seq) - 1 AS seq FROM messy')
def N4_implicit_seq(v: Views) -> DataFrame:
    rows = v.messy.select(*TP, "bundle_base", "content", F.col("seq").alias("place"))
    return S.implicit_seqs(rows, "bundle_base", ["place"], [*TP, "bundle_base"]).drop("place")


@query('SELECT topic, "partition", seq, (ROW_NUMBER() OVER (PARTITION BY topic, "partition" ORDER BY seq) - 1) // 5 AS batch FROM messy')
def N5_fixed_batches(v: Views) -> DataFrame:
    return W.fixed_batches(v.messy.select(*TP, "seq"), 5)


_SIZED = 'sized AS (SELECT topic, "partition", seq, CAST(strlen(content) + coalesce(strlen(key), 0) + 8 AS BIGINT) AS size, ROW_NUMBER() OVER (PARTITION BY topic, "partition" ORDER BY seq) AS rn FROM messy)'


def _walk(rows: str, keys: str, most: str, limit: str) -> str:
    """SQL of a walk over ``rows`` (``keys``, ``rn``, ``size``): ``batch`` grows before a row once the batch meets ``most`` or ``limit``."""
    on = " AND ".join(f"r.{k} = w.{k}" for k in keys.split(", "))
    names = ", ".join(f"r.{k}" for k in keys.split(", "))
    full = f"(w.n >= {most} OR w.total {limit})"
    return f"""walk AS (SELECT {keys}, rn, size, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n, CAST(size AS HUGEINT) AS total FROM {rows} WHERE rn = 1
    UNION ALL SELECT {names}, r.rn, r.size, CASE WHEN {full} THEN w.batch + 1 ELSE w.batch END, CASE WHEN {full} THEN 1 ELSE w.n + 1 END, CASE WHEN {full} THEN r.size ELSE w.total + r.size END
    FROM walk w JOIN {rows} r ON {on} AND r.rn = w.rn + 1)"""


@query(with_cte(f"{_SIZED}, {_walk('sized', TPQ, '5', '>= 60')}", f"SELECT {TPQ}, seq, size, batch FROM walk JOIN sized USING ({TPQ}, rn, size)"))
def N6_greedy_batches(v: Views) -> DataFrame:
    return W.greedy_batches(v.messy.withColumn("size", S.message_size(stats=True)), 5, 60)


@query(with_cte(_BUNDLES, 'SELECT topic, "partition", segment_base, bundle_base, bytes, CAST(coalesce(sum(bytes) OVER (PARTITION BY topic, "partition", segment_base ORDER BY bundle_base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM b'))
def N7_frame_offsets(v: Views) -> DataFrame:
    return M.frame_offsets(_bundles(v))


@query('SELECT topic, "partition", segment_base, CAST(count(*) FILTER (b) AS BIGINT) AS violations FROM (SELECT *, rel <= lag(rel) OVER w AS b FROM (SELECT topic, "partition", segment_base, seq AS nth, CASE WHEN seq % 10 = 0 THEN 0 ELSE seq END AS rel FROM messy) WINDOW w AS (PARTITION BY topic, "partition", segment_base ORDER BY nth)) GROUP BY ALL HAVING violations > 0')
def N9_index_violations(v: Views) -> DataFrame:
    rel = F.when(F.col("seq") % 10 == 0, 0).otherwise(F.col("seq"))
    return M.index_violations(v.messy.select(*TP, "segment_base", F.col("seq").alias("nth"), rel.alias("rel_seq"), F.col("seq").alias("offset")))


# --- joins


@query(with_cte("r AS (SELECT unnest(['view', 'nope', 'error', 'click']) AS topic)", "SELECT topic FROM r WHERE topic NOT IN (SELECT name FROM topics WHERE enabled)"))
def J1_unknown_topics(v: Views) -> DataFrame:
    return D.unknown_topics(v.spark.createDataFrame([(t,) for t in ("view", "nope", "error", "click")], "topic string"), v.topics)


@query('SELECT topic, "partition", coalesce(n.endpoint, (SELECT arg_min(endpoint, id) FROM nodes WHERE available AND NOT blocked)) AS endpoint FROM leaders l LEFT JOIN nodes n ON n.id = l.leader AND l.leader <> 2')
def J2_C9_routing(v: Views) -> DataFrame:
    return C.routing(v.leaders.withColumn("leader", F.when(F.col("leader") != 2, F.col("leader"))), v.nodes)


@query(
    """, i AS (SELECT topic, "partition", segment_base, bundle_base - segment_base AS rel_seq, bundle_base * 100 AS "offset" FROM messy GROUP BY ALL),
    t AS (SELECT DISTINCT topic, "partition", segment_base, CAST(unnest([0, 20, 45]) AS BIGINT) AS rel_target FROM messy)
    SELECT topic, "partition", segment_base, rel_target, max(rel_seq) AS rel_seq, arg_max("offset", rel_seq) AS "offset" FROM t JOIN i USING (topic, "partition", segment_base) WHERE rel_seq <= rel_target GROUP BY ALL"""
)
def J5_index_lookup(v: Views) -> DataFrame:
    index = v.messy.select(*TP, "segment_base", (F.col("bundle_base") - F.col("segment_base")).alias("rel_seq"), (F.col("bundle_base") * 100).alias("offset")).distinct()
    targets = v.messy.select(*TP, "segment_base").distinct().withColumn("rel_target", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 20, 45)))))
    return S.index_lookup(index, targets)


_ISR = 'isr AS (SELECT topic, "partition", CAST(node_id + CASE WHEN "partition" = 1 THEN 4 ELSE 0 END AS INT) AS node_id FROM replicas WHERE in_isr)'


def _isr(v: Views) -> DataFrame:
    return v.replicas.where("in_isr").select(*TP, (F.col("node_id") + F.when(F.col("partition") == 1, 4).otherwise(0)).cast("int").alias("node_id"))


@query(with_cte(_ISR, 'SELECT topic, "partition", node_id FROM isr WHERE (topic, "partition", node_id) IN (SELECT topic, "partition", node_id FROM replicas) AND node_id IN (SELECT id FROM nodes WHERE available)'))
def J7_valid_isr(v: Views) -> DataFrame:
    return C.valid_isr(_isr(v), v.replicas, v.nodes)


@query("SELECT id, endpoint FROM nodes WHERE id % 3 <> 0")
def J8_unavailable_nodes(v: Views) -> DataFrame:
    return C.unavailable_nodes(v.nodes.select("id", "endpoint"), v.nodes.where("id % 3 = 0"))


_WANTED = 'wanted AS (SELECT topic, "partition", node_id + 1 AS node_id FROM replicas)'


@query(with_cte(_WANTED, 'SELECT coalesce(a.topic, b.topic) AS topic, coalesce(a."partition", b."partition") AS "partition", coalesce(a.node_id, b.node_id) AS node_id, CASE WHEN a.topic IS NULL THEN \'add\' WHEN b.topic IS NULL THEN \'drop\' ELSE \'keep\' END AS action FROM replicas a FULL JOIN wanted b ON a.topic = b.topic AND a."partition" = b."partition" AND a.node_id = b.node_id'))
def J9_diff_replicas(v: Views) -> DataFrame:
    return C.diff_replicas(v.replicas, v.replicas.withColumn("node_id", F.col("node_id") + 1))


@query(
    """, k AS (SELECT topic AS name, count(*) AS partitions FROM parts GROUP BY ALL),
    w AS (SELECT name || CASE WHEN name = 'view' THEN '2' ELSE '' END AS name, partitions + CASE WHEN name = 'click' THEN 2 WHEN name = 'error' THEN -1 ELSE 0 END AS partitions FROM k WHERE name <> 'signup')
    SELECT coalesce(k.name, w.name) AS name, CASE WHEN k.name IS NULL THEN 'create' WHEN w.name IS NULL THEN 'disable' WHEN w.partitions > k.partitions THEN 'grow' WHEN w.partitions < k.partitions THEN 'shrink' ELSE 'same' END AS action, coalesce(w.partitions, k.partitions) AS partitions FROM k FULL JOIN w ON k.name = w.name"""
)
def J9b_C8_diff_topology(v: Views) -> DataFrame:
    known = v.partitions.groupBy(F.col("topic").alias("name")).agg(F.count(F.lit(1)).alias("partitions"))
    n = F.col("name")
    wanted = known.where("name <> 'signup'").select(F.when(n == "view", "view2").otherwise(n).alias("name"), (F.col("partitions") + F.when(n == "click", 2).when(n == "error", -1).otherwise(0)).alias("partitions"))
    return C.diff_topology(known, wanted)


@query('SELECT topic, "partition", list_contains(list(node_id), 3) AS has FROM replicas WHERE in_isr GROUP BY ALL')
def J10_has_replica(v: Views) -> DataFrame:
    return v.replicas.where("in_isr").groupBy(*TP).agg(F.array_contains(F.collect_list("node_id"), 3).alias("has"))


# --- ordering and election


@query('SELECT topic, "partition", node_id FROM (SELECT topic, "partition", (SELECT rf FROM topics WHERE name = topic) AS rf FROM parts), (SELECT id AS node_id, ROW_NUMBER() OVER (ORDER BY replica_for, leader_for, id) AS rank FROM nodes WHERE available) WHERE rank <= rf')
def O7_C5_choose_replicas(v: Views) -> DataFrame:
    return C.choose_replicas(v.nodes, v.partitions.join(v.topics.select(F.col("name").alias("topic"), "rf"), "topic"))


@query('SELECT topic, "partition", node_id, is_leader FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY topic, "partition" ORDER BY is_leader DESC, node_id) AS n FROM replicas) WHERE n <= 2')
def C5_shrink_replicas(v: Views) -> DataFrame:
    return C.shrink_replicas(v.replicas, 2).select(*TP, "node_id", "is_leader")


@query(
    """, l AS (SELECT topic, "partition", CASE WHEN "partition" = 3 THEN 9 ELSE leader END AS leader FROM leaders),
    k AS (SELECT DISTINCT l.topic, l."partition" FROM l JOIN replicas r ON r.topic = l.topic AND r."partition" = l."partition" AND r.node_id = l.leader)
    SELECT topic, "partition", arg_min(node_id, leader_for * 10000 + replica_for * 100 + node_id) AS leader FROM replicas JOIN nodes ON id = node_id
    WHERE available AND (in_isr OR (topic, "partition") NOT IN (SELECT topic, "partition" FROM k)) GROUP BY ALL"""
)
def O8_elect_leaders(v: Views) -> DataFrame:
    leaders = v.leaders.withColumn("leader", F.when(F.col("partition") == 3, 9).otherwise(F.col("leader")))
    return C.elect_leaders(v.replicas, v.nodes, leaders)


@query(with_cte(SOURCES, f'SELECT {MSG} FROM log JOIN src USING (topic, "partition") WHERE seq >= start_seq ORDER BY topic, "partition", seq'))
def O1_consume_in_order(v: Views) -> DataFrame:
    """Messages of each source in order of seq; a range sort, so no partition's order is one task's."""
    return S.consume(v.log, _sources(v)).orderBy(*TP, "seq")


@query('SELECT topic, "partition", base_seq, last_seq FROM segments ORDER BY topic, "partition", base_seq')
def O5_O6_ordered_segments(v: Views) -> DataFrame:
    return v.segments.select(*TP, "base_seq", "last_seq").orderBy(*TP, "base_seq")


@query(f'SELECT topic, "partition", seq FROM messy WHERE seq <= 64 UNION ALL SELECT topic, "partition", seq FROM messy WHERE seq > 128')
def set_union_segments(v: Views) -> DataFrame:
    rows = v.messy.select(*TP, "seq")
    return rows.where("seq <= 64").unionByName(rows.where("seq > 128"))


@query('SELECT topic, "partition", seq, content FROM messy WHERE segment_base <> 1 UNION ALL SELECT topic, "partition", seq, content FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY topic, "partition", key ORDER BY seq DESC) AS rn FROM messy WHERE segment_base = 1) WHERE CASE WHEN coalesce(key, \'\') = \'\' THEN content <> \'\' ELSE rn = 1 END')
def set_replace_segments(v: Views) -> DataFrame:
    first = v.messy.where("segment_base = 1")
    done = first.select(*TP, "segment_base").distinct()
    rest = v.messy.join(done, [*TP, "segment_base"], "left_anti")
    return rest.select(*TP, "seq", "content").unionByName(M.compact(first).select(*TP, "seq", "content"))


@query('SELECT topic, "partition", node_id FROM replicas WHERE in_isr INTERSECT SELECT topic, "partition", node_id FROM replicas WHERE last_lsn > 0')
def set_intersect_isr(v: Views) -> DataFrame:
    return v.replicas.where("in_isr").select(*TP, "node_id").intersect(v.replicas.where("last_lsn > 0").select(*TP, "node_id"))


@query('SELECT topic, "partition", node_id FROM replicas EXCEPT SELECT topic, "partition", node_id FROM replicas WHERE in_isr')
def set_except_isr(v: Views) -> DataFrame:
    return v.replicas.select(*TP, "node_id").exceptAll(v.replicas.where("in_isr").select(*TP, "node_id"))


# --- writing


@query('SELECT e.event_type AS topic, CAST(e.user_id % 4 AS INT) AS "partition", e.event_id AS arrival, e.props AS content, coalesce(high_water_mark, 0) + ROW_NUMBER() OVER (PARTITION BY e.event_type, e.user_id % 4 ORDER BY e.event_id) AS seq FROM events e LEFT JOIN marks m ON m.topic = e.event_type AND m."partition" = e.user_id % 4')
def W3_assign_sequences(v: Views) -> DataFrame:
    rows = v.numbered.select(*TP, F.col("event_id").alias("arrival"), "content")
    return W.assign_sequences(rows, v.marks, "arrival")


@query(
    """, r AS (SELECT unnest([{'t': 'view', 'p': 0, 'f': NULL, 'l': NULL}, {'t': 'view', 'p': 0, 'f': 1, 'l': 5}, {'t': 'view', 'p': 1, 'f': 90000, 'l': 90005}, {'t': 'view', 'p': 1, 'f': 90005, 'l': 90000}, {'t': 'view', 'p': 9, 'f': NULL, 'l': NULL}, {'t': 'nope', 'p': 0, 'f': NULL, 'l': NULL}]) AS x),
    q AS (SELECT CAST(x.t AS VARCHAR) AS topic, CAST(x.p AS INT) AS "partition", CAST(x.f AS BIGINT) AS first_seq, CAST(x.l AS BIGINT) AS last_seq FROM r)
    SELECT q.*, CASE WHEN q.topic NOT IN (SELECT topic FROM parts) THEN 'UnknownTopic' WHEN m.topic IS NULL THEN 'UnknownPartition' WHEN first_seq <= high_water_mark OR last_seq < first_seq THEN 'InvalidSeqNums' END AS fault FROM q LEFT JOIN marks m USING (topic, "partition")"""
)
def W3b_validate_produce(v: Views) -> DataFrame:
    rows = [("view", 0, None, None), ("view", 0, 1, 5), ("view", 1, 90000, 90005), ("view", 1, 90005, 90000), ("view", 9, None, None), ("nope", 0, None, None)]
    return W.validate_produce(v.spark.createDataFrame(rows, "topic string, partition int, first_seq long, last_seq long"), v.partitions, v.marks)


@query(with_cte(_BUNDLES, "SELECT topic, \"partition\", bundle_base, CASE WHEN msgs > 512 OR bytes > 1024 THEN 'snappy' ELSE 'none' END AS codec FROM b"))
def W1_bundle_codec(v: Views) -> DataFrame:
    found = v.messy.groupBy(*TP, "bundle_base").agg(F.count(F.lit(1)).alias("n"), F.sum(S.message_size(stats=True)).alias("b"))
    return found.select(*TP, "bundle_base", W.bundle_codec(F.col("n"), F.col("b")).alias("codec"))


@query(f"SELECT {MSG} FROM log")
def W1_produce(v: Views) -> DataFrame:
    from ..sources.store import append_log, read_log, scratch

    path = scratch(v.spark, "produce")
    append_log(v.log, path)
    return read_log(v.spark, path)


@query('SELECT topic, "partition", arrival, seq FROM (SELECT *, lag(seq) OVER (PARTITION BY topic, "partition" ORDER BY arrival) AS prev FROM (SELECT topic, "partition", event_id AS arrival, CASE WHEN event_id % 50 = 0 THEN 1 ELSE seq END AS seq FROM log)) WHERE seq <= prev')
def W2_validate_explicit(v: Views) -> DataFrame:
    seq = F.when(F.col("event_id") % 50 == 0, 1).otherwise(F.col("seq")).cast("long")
    return W.validate_explicit(v.numbered.select(*TP, F.col("event_id").alias("arrival"), seq.alias("seq")))


@query('SELECT \'made\' AS topic, CAST(p AS INT) AS "partition", CAST(0 AS BIGINT) AS first_available, CAST(0 AS BIGINT) AS high_water_mark FROM range(3) r(p)')
def W14_create_topic(v: Views) -> DataFrame:
    from ..sources.store import create_topic, scratch

    path = scratch(v.spark, "topics")
    create_topic(v.spark, path, "made", 3, 2)
    return v.spark.read.parquet(f"{path}/partitions")


@query("SELECT topic, \"partition\", base_seq, sealed FROM segments")
def S12_list_segments(v: Views) -> DataFrame:
    from ..sources.segments import list_segments, write_segments
    from ..sources.store import scratch

    path = scratch(v.spark, "listed")
    write_segments(v.messy, path)
    return v.spark.createDataFrame([(s.topic, s.partition, s.base, s.sealed) for s in list_segments(path)], "topic string, partition int, base_seq long, sealed boolean")


_RN = 'ROW_NUMBER() OVER (PARTITION BY topic, "partition" ORDER BY bundle_base) AS rn'


@query(with_cte(f"{_BUNDLES}, rolls AS (SELECT *, bytes AS size, {_RN} FROM b), {_walk('rolls', TPQ, '1000000000', '> 900')}", f"SELECT {TPQ}, bundle_base, bytes, batch AS segment FROM walk JOIN rolls USING ({TPQ}, rn, size)"))
def W4_roll(v: Views) -> DataFrame:
    return W.roll_segments(_bundles(v), 900)


@query(
    with_cte(
        f"{_BUNDLES}, ends AS (SELECT {TPQ}, bundle_base, max(seq) AS last_seq, max(ts_ms) AS ts_ms FROM messy GROUP BY ALL), rolls AS (SELECT *, bytes AS size, {_RN} FROM b JOIN ends USING ({TPQ}, bundle_base)), {_walk('rolls', TPQ, '1000000000', '> 900')}",
        f"""SELECT {TPQ}, base_seq, last_seq, size_bytes, CASE WHEN sealed THEN frozen END AS frozen_ts, sealed FROM (SELECT *, batch < max(batch) OVER (PARTITION BY {TPQ}) AS sealed FROM
        (SELECT {TPQ}, batch, min(bundle_base) AS base_seq, max(last_seq) AS last_seq, CAST(sum(bytes) AS BIGINT) AS size_bytes, CAST(max(ts_ms) // 1000 AS BIGINT) AS frozen FROM walk JOIN rolls USING ({TPQ}, rn, size) GROUP BY ALL))""",
    )
)
def W5_seal(v: Views) -> DataFrame:
    ends = v.messy.groupBy(*TP, "bundle_base").agg(F.max("seq").alias("last_seq"), F.max("ts_ms").alias("ts_ms"))
    return W.seal_segments(_bundles(v).join(ends, [*TP, "bundle_base"]), 900)


@query(
    f"""SELECT topic, "partition", base_seq, size_bytes > 0 AND (size_bytes > 3000 OR base_seq % 7 * 8 > 40 OR ({T0 // 1000 + 10 * 86400} - created_ts > 604800)) AS due,
    size_bytes > 0 AND (size_bytes > 3000 OR base_seq % 7 * 8 > 40 OR ({T0 // 1000 + 10 * 86400} - created_ts > 604800) OR ({T0 // 1000 + 10 * 86400} - created_ts > 86400)) AS due_by_age FROM segments"""
)
def W4_roll_due(v: Views) -> DataFrame:
    state = (F.col("size_bytes"), F.col("base_seq") % 7 * 8, F.col("created_ts"), T0 // 1000 + 10 * 86400, 3000, 40, W.roll_jitter(0, F.col("base_seq")))
    return v.segments.select(*TP, "base_seq", W.roll_due(*state).alias("due"), W.roll_due(*state, max_age_secs=86400).alias("due_by_age"))


@query(f"SELECT {MSG} FROM log UNION ALL SELECT 'view', 1, (SELECT max(seq) + 1 FROM log WHERE topic = 'view' AND \"partition\" = 1), {T0}, 'k', 'one more'")
def W8_append_message(v: Views) -> DataFrame:
    from ..sources.store import append_log, append_message, read_log, scratch

    path = scratch(v.spark, "appended")
    append_log(v.log, path)
    append_message(v.spark, path, "view", 1, T0, "k", "one more")
    return read_log(v.spark, path)


_CONFIGS = [("view", None, "log.retention.secs=1d2h\nlog.segment.bytes=512m"), ("view", 1, "log.segment.bytes=1k # small\nretention.segments.count=5"), ("click", None, "log.segment.bytes=1"), ("error", 2, "log.cleaner.min.cleanable.ratio=0.25")]
_SETTINGS = 'CAST(CASE WHEN topic = \'view\' THEN 93600 ELSE 0 END AS BIGINT) AS retention_secs, CAST(CASE WHEN topic = \'view\' AND "partition" = 1 THEN {small} WHEN topic = \'view\' THEN 536870912 ELSE 1073741824 END AS BIGINT) AS segment_bytes, CAST(CASE WHEN topic = \'view\' AND "partition" = 1 THEN 5 ELSE 0 END AS BIGINT) AS retention_segments, CASE WHEN topic = \'error\' AND "partition" = 2 THEN 0.25 ELSE 0.5 END::DOUBLE AS min_cleanable_ratio, CASE WHEN topic = \'click\' THEN \'1 is less than 64\' END AS fault'


def _configs(v: Views, changed: str | None = None) -> DataFrame:
    rows = [(t, p, changed if changed and p == 1 else text) for t, p, text in _CONFIGS]
    return v.spark.createDataFrame(rows, "topic string, partition int, text string")


@query(f'SELECT topic, "partition", {_SETTINGS.format(small=1024)} FROM parts')
def effective_configs(v: Views) -> DataFrame:
    from ..operators.config import effective_configs as settings

    return settings(v.partitions, _configs(v)).select(*TP, "retention_secs", "segment_bytes", "retention_segments", "min_cleanable_ratio", "fault")


@query(f'SELECT topic, "partition", {_SETTINGS.format(small=2048)} FROM parts')
def W15_reload_config(v: Views) -> DataFrame:
    from ..operators.config import effective_configs as settings
    from ..operators.config import reload_config

    changed = _configs(v, "log.segment.bytes=2k\nretention.segments.count=5")
    return reload_config(settings(v.partitions, _configs(v)), changed, "view", 1).select(*TP, "retention_secs", "segment_bytes", "retention_segments", "min_cleanable_ratio", "fault")


@query(f"SELECT {MSG} FROM log WHERE NOT (topic = 'view' AND \"partition\" = 2)")
def W16_reset_partition(v: Views) -> DataFrame:
    from ..sources.store import append_log, read_log, reset_partition, scratch

    path = scratch(v.spark, "reset")
    append_log(v.log, path)
    reset_partition(v.spark, path, "view", 2)
    return read_log(v.spark, path)


@query(with_cte(f"{_BUNDLES}, idx AS (SELECT *, bytes AS size, ROW_NUMBER() OVER (PARTITION BY {TPQ}, segment_base ORDER BY bundle_base) AS rn, CAST(sum(bytes) OVER (PARTITION BY {TPQ}, segment_base ORDER BY bundle_base) - bytes AS BIGINT) AS \"offset\" FROM b), {_walk('idx', TPQ + ', segment_base', '1000000000', '> 300')}", f'SELECT {TPQ}, segment_base, bundle_base - segment_base AS rel_seq, "offset" FROM idx JOIN (SELECT {TPQ}, segment_base, batch, min(rn) AS rn FROM walk GROUP BY ALL) USING ({TPQ}, segment_base, rn)'))
def W6_sparse_index(v: Views) -> DataFrame:
    return W.sparse_index(_bundles(v), 300)


@query("SELECT value, CASE WHEN position('=' IN value) > 1 THEN substr(value, 1, position('=' IN value) - 1) END AS key, CASE WHEN position('=' IN value) > 0 THEN substr(value, position('=' IN value) + 1) ELSE value END AS content FROM (SELECT CASE event_id % 4 WHEN 0 THEN key || '=' || content WHEN 1 THEN content WHEN 2 THEN '=' || content ELSE key || '=' END AS value FROM log)")
def W9_key_value_lines(v: Views) -> DataFrame:
    e = F.col("event_id") % 4
    lines = v.numbered.select(F.when(e == 0, F.concat("key", F.lit("="), "content")).when(e == 1, F.col("content")).when(e == 2, F.concat(F.lit("="), "content")).otherwise(F.concat("key", F.lit("="))).alias("value"))
    return W.key_value_lines(lines)


@query(f'SELECT topic, "partition", content, 100 + 3 * (rn - 1) AS seq, {T0} + 1000 * (rn - 1) AS ts_ms FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY topic, "partition" ORDER BY event_id) AS rn FROM log)')
def W9_explicit_steps(v: Views) -> DataFrame:
    return W.explicit_steps(v.numbered.select(*TP, "content", "event_id"), "event_id", 100, 3, T0, 1000).drop("event_id")


_DEST = 'dest AS (SELECT m.* FROM messy m JOIN marks USING (topic, "partition") WHERE seq <= 0.6 * high_water_mark)'


def _destination(v: Views) -> DataFrame:
    return v.messy.join(v.marks, TP).where("seq <= 0.6 * high_water_mark").drop("first_available", "high_water_mark")


@query(with_cte(_DEST, f'SELECT {MSG}, segment_base, bundle_base FROM messy LEFT JOIN (SELECT topic, "partition", max(seq) AS h FROM dest GROUP BY ALL) USING (topic, "partition") WHERE seq > coalesce(h, 0)'))
def W10_J4_mirror_delta(v: Views) -> DataFrame:
    return W.mirror_delta(v.messy, _destination(v))


@query(with_cte('d AS (SELECT * FROM parts WHERE topic <> \'view\' OR "partition" < 2)', 'SELECT topic, a.n AS source_partitions, coalesce(b.n, 0) AS destination_partitions FROM (SELECT topic, count(DISTINCT "partition") AS n FROM parts GROUP BY ALL) a LEFT JOIN (SELECT topic, count(DISTINCT "partition") AS n FROM d GROUP BY ALL) b USING (topic) WHERE a.n <> coalesce(b.n, 0)'))
def W10_partition_mismatches(v: Views) -> DataFrame:
    return W.partition_mismatches(v.partitions, v.partitions.where("topic <> 'view' or partition < 2"))


_MIRROR = 'sized AS (SELECT topic, "partition", seq, seq <> lag(seq, 1, h) OVER (PARTITION BY topic, "partition" ORDER BY seq) + 1 AS gap, CAST(strlen(content) + coalesce(strlen(key), 0) AS BIGINT) AS size, ROW_NUMBER() OVER (PARTITION BY topic, "partition" ORDER BY seq) AS rn FROM messy JOIN (SELECT topic, "partition", max(seq) AS h FROM dest GROUP BY ALL) USING (topic, "partition") WHERE seq > h)'


@query(with_cte(f"{_DEST}, {_MIRROR}, {_walk('sized', TPQ, '20', '>= 400')}", f"SELECT {TPQ}, batch, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS messages, CAST(sum(size) AS BIGINT) AS bytes, bool_or(gap) AS sparse FROM walk JOIN sized USING ({TPQ}, rn, size) GROUP BY ALL"))
def W10_mirror_bundles(v: Views) -> DataFrame:
    there = _destination(v)
    marks = S.watermarks(there)
    return W.mirror_bundles(W.mirror_delta(v.messy, there).join(marks, TP, "left_semi"), marks, 20, 400)


@query('SELECT topic, "partition", batch, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS messages, coalesce(max(CAST(seq <> prev + 1 AS INT)), 0) = 1 AS sparse FROM (SELECT *, (ROW_NUMBER() OVER w - 1) // 128 AS batch, lag(seq) OVER w AS prev FROM messy WINDOW w AS (PARTITION BY topic, "partition" ORDER BY seq)) GROUP BY topic, "partition", batch')
def W11_replicate(v: Views) -> DataFrame:
    return W.replicate(v.messy)


@query("SELECT topic, \"partition\", seq, content AS line FROM log WHERE topic = 'view'")
def W12_stdout_lines(v: Views) -> DataFrame:
    return S.render(v.log.where("topic = 'view'"))


# --- streaming in the form of a batch


@query(with_cte(SOURCES, 'SELECT topic, "partition", coalesce(greatest(start_seq, max_seq + 1), start_seq) AS next_seq, max_seq IS NULL OR max_seq = high_water_mark AS drained FROM src LEFT JOIN (SELECT topic, "partition", max(seq) AS max_seq FROM messy JOIN src USING (topic, "partition") JOIN marks USING (topic, "partition") WHERE seq >= start_seq AND ("partition" % 2 = 0 OR 10 * seq <= 7 * high_water_mark) GROUP BY ALL) USING (topic, "partition") LEFT JOIN marks USING (topic, "partition")'))
def T6_T8_cursor(v: Views) -> DataFrame:
    """Even partitions are read to their end, odd ones to seven tenths."""
    sources = _sources(v)
    read = v.messy.join(v.marks, TP).where("partition % 2 = 0 or 10 * seq <= 7 * high_water_mark").drop("first_available", "high_water_mark")
    return S.next_cursor(S.consume(read, sources), sources, v.marks)


_POLLS = '''polls AS (SELECT event_id AS id, event_type AS topic, CAST(user_id % 4 AS INT) AS "partition", event_id % 90 + 1 AS from_seq, epoch_us(ts) // 1000 AS at_ms, CAST(event_id % 5 * 86400000 AS BIGINT) AS max_wait_ms,
    CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 4000 AS BIGINT) END AS min_bytes, CASE WHEN event_id % 3 = 0 THEN event_id % 120 END AS above_mark FROM events WHERE event_id % 20 = 0),
 r AS (SELECT topic, "partition", seq, ts_ms, segment_base, sum(strlen(content) + coalesce(strlen(key), 0) + 8) OVER (PARTITION BY topic, "partition" ORDER BY seq) AS ends, strlen(content) + coalesce(strlen(key), 0) + 8 AS size FROM messy),
 f AS (SELECT p.*, arg_min(r.segment_base, r.seq) AS seg, arg_min(r.ends - r.size, r.seq) AS base FROM polls p LEFT JOIN r ON r.topic = p.topic AND r."partition" = p."partition" AND r.seq >= p.from_seq GROUP BY ALL),
 a AS (SELECT f.id, min(r.seq) FILTER (min_bytes IS NOT NULL AND r.seq >= from_seq AND r.ends - base >= greatest(min_bytes, 1)) AS b, min(r.seq) FILTER (min_bytes IS NOT NULL AND r.seq >= from_seq AND r.segment_base > seg) AS s, min(r.seq) FILTER (r.seq > above_mark) AS m
   FROM f LEFT JOIN r ON r.topic = f.topic AND r."partition" = f."partition" GROUP BY ALL),
 c AS (SELECT polls.*, CASE WHEN above_mark IS NOT NULL THEN m WHEN s IS NOT NULL AND (b IS NULL OR s < b) THEN s ELSE b END AS w, CASE WHEN above_mark IS NOT NULL THEN 'mark' WHEN s IS NOT NULL AND (b IS NULL OR s < b) THEN 'segment' ELSE 'bytes' END AS why FROM polls JOIN a USING (id)),
 d AS (SELECT c.*, r.ts_ms IS NULL OR greatest(at_ms, r.ts_ms) > at_ms + max_wait_ms AS late, greatest(at_ms, r.ts_ms) AS t FROM c LEFT JOIN r ON r.topic = c.topic AND r."partition" = c."partition" AND r.seq = w)'''


@query(with_cte(_POLLS, "SELECT id, CASE WHEN NOT late THEN w END AS woken_seq, CASE WHEN late THEN at_ms + max_wait_ms ELSE t END AS woken_ms, CASE WHEN late THEN 'timeout' ELSE why END AS reason FROM d"))
def T2_T3_T4_T5_polls(v: Views) -> DataFrame:
    """A request for every twentieth event, of a consumer or a replica, against the whole log."""
    from ..operators.wait import answer_polls

    e = F.col("event_id")
    requests = v.table("events").where(e % 20 == 0).select(
        e.alias("id"),
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        (e % 90 + 1).alias("from_seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        (e % 5 * 86_400_000).cast("long").alias("max_wait_ms"),
        F.when(e % 3 != 0, (e % 4000).cast("long")).alias("min_bytes"),
        F.when(e % 3 == 0, e % 120).alias("above_mark"),
    )
    return answer_polls(requests, v.messy)


@query(f"SELECT topic, \"partition\", coalesce(min(CASE WHEN ts_ms >= {T0 + 10 * DAY} THEN seq END), max(seq) + 1) AS seq FROM messy GROUP BY ALL")
def seek_by_time(v: Views) -> DataFrame:
    return S.seek_by_time(v.messy, T0 + 10 * DAY)


@query(f"SELECT {MSG} FROM log WHERE topic = 'view' AND seq >= 20")
def T1_T7_T9_drain(v: Views) -> DataFrame:
    from ..streaming.tail import drain_stream

    return drain_stream(v.log_stream, v.spark.createDataFrame([("view", p, 20) for p in range(4)], "topic string, partition int, start_seq long"))


@query(f"SELECT {MSG} FROM log")
def T10_replication_loop(v: Views) -> DataFrame:
    from ..streaming.tail import replicate_available

    return replicate_available(v.log_stream)


# --- cluster metadata


@query(with_cte(_ISR, 'SELECT topic, "partition", node_id FROM isr UNION SELECT topic, "partition", 7 AS node_id FROM marks WHERE "partition" % 2 = 0'))
def C1_join_isr(v: Views) -> DataFrame:
    requests = v.marks.select(*TP, F.lit(7).alias("node_id"), (F.col("high_water_mark") + F.when(F.col("partition") % 2 == 0, 1).otherwise(0)).alias("seq"))
    return C.join_isr(_isr(v), requests, v.marks)


@query(with_cte(_ISR, 'SELECT topic, "partition", node_id FROM isr WHERE node_id NOT IN (1, 5)'))
def C2_leave_isr(v: Views) -> DataFrame:
    return C.leave_isr(_isr(v), v.spark.createDataFrame([(1,), (5,)], "node_id int"))


@query(
    """, l AS (SELECT topic, "partition", CASE WHEN "partition" = 3 THEN 9 ELSE leader END AS leader FROM leaders),
    s AS (SELECT topic, "partition", list(node_id) FILTER (node_id <> 2) AS rs, list(node_id) FILTER (in_isr) AS isr FROM replicas GROUP BY ALL),
    c AS (SELECT l.topic, l."partition", unnest([CASE WHEN len(list_filter(isr, lambda x: NOT list_contains(rs, x))) > 0 THEN 'isr_not_in_rs' END, CASE WHEN len(isr) > len(rs) THEN 'isr_larger_than_rs' END,
      CASE WHEN NOT list_contains(rs, leader) THEN 'leader_not_in_rs' END, CASE WHEN NOT list_contains(isr, leader) THEN 'leader_not_in_isr' END]) AS violation FROM l JOIN s USING (topic, "partition"))
    SELECT * FROM c WHERE violation IS NOT NULL"""
)
def C4_invariants(v: Views) -> DataFrame:
    leaders = v.leaders.withColumn("leader", F.when(F.col("partition") == 3, 9).otherwise(F.col("leader")))
    return C.invariant_violations(leaders, v.replicas.withColumn("is_replica", F.col("node_id") != 2))


@query('SELECT topic, "partition", CASE WHEN "partition" = 1 THEN \'replicas\' WHEN "partition" < 3 THEN \'leader\' ELSE \'none\' END AS kind FROM parts')
def C6_update_kind(v: Views) -> DataFrame:
    p = F.col("partition")
    return v.partitions.select(*TP, C.update_kind(p == 1, p < 3).alias("kind"))


@query(
    """SELECT topic, "partition", CASE "partition" WHEN 0 THEN [1, 3] WHEN 1 THEN [3, 4, 5, 6, 9] WHEN 2 THEN [6, 7, 8, 9, 10, 11, 12, 65535] WHEN 3 THEN CAST([] AS INT[]) ELSE [2] END AS replicas, "partition" + 1 AS rf FROM parts"""
)
def C7_C12_decode_topology(v: Views) -> DataFrame:
    """Lists in base64 with empty entries, entries that are no id, repeats and more ids than the cap, and a text that isn't base64."""
    p = F.col("partition")
    ids = F.when(p == 0, "3,1,,3,0").when(p == 1, "9,9,9,3,4,5,6,9,1,2").when(p == 2, "12,11,10,9,8,7,6,65535,1,2,3,70000").otherwise("2x,2,-1, 4")
    packed = F.when(p == 3, "?no base64?").otherwise(F.base64(ids.cast("binary")))
    kv = v.partitions.select(F.concat_ws("/", F.lit("cluster"), "topic", p.cast("string")).alias("key"), F.to_json(F.struct(packed.alias("replicas"), (p + 1).alias("rf"))).alias("value"))
    return C.decode_topology(kv)


@query('SELECT topic, "partition", CASE WHEN "partition" = 0 THEN [2, 2, 3, 4, 5, 6, 7, 8] ELSE list_sort(["partition", 9, 1]) END AS ids FROM parts')
def C13_isr_list(v: Views) -> DataFrame:
    p = F.col("partition")
    ids = F.when(p == 0, F.array(*map(F.lit, (8, 7, 6, 5, 4, 3, 2, 2, 1, 9)))).otherwise(F.array(p, F.lit(9), F.lit(1)))
    return v.partitions.select(*TP, C.isr_list(ids).alias("ids"))


@query('SELECT topic, "partition", CASE WHEN leader < 3 THEN leader END AS leader FROM leaders')
def C14_valid_leader(v: Views) -> DataFrame:
    return v.leaders.select(*TP, C.valid_leader(F.array(F.lit(1), F.lit(2)), F.col("leader")).alias("leader"))


@query(with_cte(_ISR, 'SELECT topic, "partition", node_id FROM (SELECT topic, "partition", node_id FROM isr WHERE (topic, "partition", node_id) IN (SELECT topic, "partition", node_id FROM replicas) AND node_id IN (SELECT id FROM nodes WHERE available) UNION SELECT topic, "partition", 2 FROM leaders WHERE leader = 2) WHERE "partition" <> 0'))
def C15_repair_isr(v: Views) -> DataFrame:
    return C.repair_isr(_isr(v), v.replicas, v.nodes, v.leaders, v.partitions.withColumn("enabled", F.col("partition") != 0), 2)


@query('SELECT topic, "partition", CASE WHEN "partition" <> 0 AND leader <> 2 AND leader <> 1 THEN leader END AS source FROM leaders')
def C16_replication_source(v: Views) -> DataFrame:
    leader = F.col("leader")
    return v.leaders.select(*TP, C.replication_source(F.col("partition") != 0, leader, leader != 1, F.array(*map(F.lit, (1, 2, 3))), F.lit(2)).alias("source"))


@query(with_cte(_ISR, 'SELECT DISTINCT topic, "partition" FROM isr JOIN leaders USING (topic, "partition") WHERE node_id IN (3, 6) AND leader = 2'))
def C17_dirty_partitions(v: Views) -> DataFrame:
    return C.dirty_partitions(_isr(v), v.leaders, v.spark.createDataFrame([(3,), (6,)], "node_id int"), 2)


@query('SELECT topic, count(*) FILTER (n = "partition") AS partitions FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY topic ORDER BY "partition") - 1 AS n FROM parts WHERE NOT (topic = \'view\' AND "partition" = 2)) GROUP BY ALL')
def C11_topology_prefix(v: Views) -> DataFrame:
    return C.topology_prefix(v.partitions.where("not (topic = 'view' and partition = 2)"))


# --- scalar functions


@query("SELECT event_id, epoch(date_trunc('day', ts))::BIGINT AS first_second, (epoch(date_trunc('day', ts)) + 86399)::BIGINT AS last_second, strftime(ts, '%Y.%m.%d %H:%M:%S') AS repr, CAST(ts AS DATE) - 3 AS three_days_ago, CAST(day(last_day(ts)) AS INT) AS month_days, year(ts) % 4 = 0 AS leap FROM events")
def X5_X8_dates(v: Views) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return v.table("events").select("event_id", X.day_first_second(ts).alias("first_second"), X.day_last_second(ts).alias("last_second"), X.ts_repr(ts).alias("repr"), X.days_ago(F.to_date(ts), 3).alias("three_days_ago"), X.days_of_month(F.to_date(ts)).alias("month_days"), X.is_leap_year(F.year(ts)).alias("leap"))


@query("SELECT t, CASE WHEN strlen(t) = 8 THEN CAST(try_strptime(t, '%Y%m%d') AS DATE) END AS day FROM (SELECT unnest(['20240229', '20230229', '20241301', '2024010', '20200101']) AS t)")
def X6_from_yyyymmdd(v: Views) -> DataFrame:
    rows = v.spark.createDataFrame([(t,) for t in ("20240229", "20230229", "20241301", "2024010", "20200101")], "t string")
    return rows.select("t", X.from_yyyymmdd(F.col("t")).alias("day"))


_SIZE_SQL = "CASE WHEN n >= 1099511627776 THEN regexp_replace(printf('%.2f', n / 1099511627776.0), '\\.?0+$', '') || 'tb' WHEN n >= 1073741824 THEN regexp_replace(printf('%.2f', n / 1073741824.0), '\\.?0+$', '') || 'gb' WHEN n >= 1048576 THEN regexp_replace(printf('%.2f', n / 1048576.0), '\\.?0+$', '') || 'mb' WHEN n >= 1024 THEN regexp_replace(printf('%.2f', n / 1024.0), '\\.?0+$', '') || 'kb' ELSE n || 'b' END"


@query(f"SELECT n, {_SIZE_SQL} AS repr FROM (SELECT CAST(o_orderkey * o_orderkey * 37 AS BIGINT) AS n FROM orders)")
def X9_size_repr(v: Views) -> DataFrame:
    return v.table("orders").select((F.col("o_orderkey") * F.col("o_orderkey") * 37).alias("n")).select("n", X.size_repr(F.col("n")).alias("repr"))


@query("SELECT n, format('{:,}', n) AS dotted FROM (SELECT CAST(o_orderkey * 977 AS BIGINT) AS n FROM orders)")
def X10_dotnotation(v: Views) -> DataFrame:
    return v.table("orders").select((F.col("o_orderkey") * 977).alias("n")).select("n", X.dotnotation_repr(F.col("n")).alias("dotted"))


_TRIMMED = "regexp_replace(regexp_replace(printf('%d.%03d', (us + 500) // 1000000, (us + 500) // 1000 % 1000), '0+$', ''), '\\.$', '') || 's'"  # half a millisecond rounds up


@query(
    f"""SELECT us, CASE WHEN us < 1000 THEN us || 'us' WHEN us < 60000000 THEN {_TRIMMED} WHEN us < 3600000000 THEN (us // 60000000) || 'm' || CASE WHEN us // 1000000 % 60 > 0 THEN (us // 1000000 % 60) || 's' ELSE '' END
    ELSE (us // 3600000000) || 'h' || CASE WHEN us // 60000000 % 60 > 0 THEN (us // 60000000 % 60) || 'm' ELSE '' END END AS repr
    FROM (SELECT o_orderkey * o_orderkey * 1001 AS us FROM orders UNION ALL SELECT unnest([0, 999, 1500, 59999000, 60000000, 125000000, 130000000, 5400000000, 3600000000]))"""
)
def X11_duration_repr(v: Views) -> DataFrame:
    known = v.spark.createDataFrame([(x,) for x in (0, 999, 1500, 59999000, 60000000, 125000000, 130000000, 5400000000, 3600000000)], "us long")
    rows = v.table("orders").select((F.col("o_orderkey") * F.col("o_orderkey") * 1001).alias("us")).unionByName(known)
    return rows.select("us", X.duration_repr(F.col("us")).alias("repr"))


@query("SELECT event_id, CAST((hour(ts) + 24 - 7) % 24 AS INT) AS ago, CAST((hour(ts) + 5) % 24 AS INT) AS later FROM events")
def X7_hours(v: Views) -> DataFrame:
    hour = F.hour(F.col("ts").cast("timestamp"))
    return v.table("events").select("event_id", X.hours_ago(hour, 7).alias("ago"), X.hours_later(hour, 5).alias("later"))


@query("SELECT t, CASE WHEN regexp_full_match(t, '[-+]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][-+]?[0-9]+)?') THEN TRY_CAST(t AS DOUBLE) END AS d FROM (SELECT unnest(['1', '-2.5', '1e3', '.5', '7.', 'x', '', '1e', '1.2.3', ' 1', 'nan', '+4']) AS t UNION ALL SELECT CAST(o_totalprice AS VARCHAR) FROM orders)")
def X15_parse_double(v: Views) -> DataFrame:
    rows = v.spark.createDataFrame([(t,) for t in ("1", "-2.5", "1e3", ".5", "7.", "x", "", "1e", "1.2.3", " 1", "nan", "+4")], "t string")
    rows = rows.unionByName(v.table("orders").select(F.col("o_totalprice").cast("string").alias("t")))
    return rows.select("t", X.parse_double(F.col("t")).alias("d"))


@query("SELECT p_partkey, contains(p_name, 'a') AS has, CAST(instr(p_type, ' ') AS INT) AS at, starts_with(p_name, 'P') AS starts, p_type LIKE '%L' AS ends, lower(p_brand) = lower('BRAND#12') AS same, trim('  ' || p_name || ' ') AS trimmed, regexp_full_match(p_name, '[0-9]+') AS digits, split_part(p_brand, '#', 1) AS before, CASE WHEN contains(p_brand, '#') THEN substr(p_brand, instr(p_brand, '#') + 1) ELSE '' END AS after FROM part")
def X12_X14_strings(v: Views) -> DataFrame:
    before, after = X.divided(F.col("p_brand"), "#")
    name, kind = F.col("p_name"), F.col("p_type")
    return v.table("part").select("p_partkey", F.contains(name, F.lit("a")).alias("has"), F.locate(" ", kind).alias("at"), F.startswith(name, F.lit("P")).alias("starts"), F.endswith(kind, F.lit("L")).alias("ends"), (F.lower("p_brand") == "brand#12").alias("same"), F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), X.all_digits(name).alias("digits"), before.alias("before"), after.alias("after"))


@query("SELECT t, CASE WHEN regexp_full_match(t, '-?[0-9]+') THEN TRY_CAST(t AS BIGINT) END AS i FROM (SELECT unnest(['12', '-7', 'x1', '', '99999999999999999999', '1.5']) AS t)")
def X15_parse_integer(v: Views) -> DataFrame:
    rows = v.spark.createDataFrame([(t,) for t in ("12", "-7", "x1", "", "99999999999999999999", "1.5")], "t string")
    return rows.select("t", X.parse_integer(F.col("t")).alias("i"))


@query("SELECT n, lower(to_base(n, 36)) AS b36, lower(to_base(n, 2)) AS b2, n AS back FROM (SELECT o_orderkey * 31 AS n FROM orders)")
def X16_radix(v: Views) -> DataFrame:
    n = F.col("n")
    rows = v.table("orders").select((F.col("o_orderkey") * 31).alias("n"))
    return rows.select("n", X.to_base(n, 36).alias("b36"), X.to_base(n, 2).alias("b2"), X.from_base(X.to_base(n, 36), 36).alias("back"))


@query("SELECT event_id, to_base64(encode(props)) AS b, props AS back FROM events")
def X17_base64(v: Views) -> DataFrame:
    b = F.base64(F.col("props").cast("binary"))
    return v.table("events").select("event_id", b.alias("b"), F.unbase64(b).cast("string").alias("back"))


_BYTES = "list_transform(range(strlen(props)), lambda i: CAST(ord(props[i + 1]) AS {kind}))"  # props are ASCII
_CRC = "list_reduce({bytes}, lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), CAST(4294967295 AS BIGINT))"


@query(f"SELECT event_id, xor({_CRC.format(bytes=_BYTES.format(kind='BIGINT'))}, 4294967295) AS crc FROM events")
def X18_crc32(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.crc32(F.col("props").cast("binary")).alias("crc"))


@query()
def X19_hashes(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.xxhash64("props").alias("xxhash64"))


@query("SELECT t, strlen(t) BETWEEN 1 AND 64 AND regexp_full_match(t, '[A-Za-z0-9]([A-Za-z0-9_-]*[A-Za-z0-9])?') AS valid FROM (SELECT unnest(['events', 'a-b_c', '', '-a', 'a_', 'a.b', 'x', repeat('a', 64), repeat('a', 65)]) AS t)")
def X20_topic_name(v: Views) -> DataFrame:
    rows = v.spark.createDataFrame([(t,) for t in ("events", "a-b_c", "", "-a", "a_", "a.b", "x", "a" * 64, "a" * 65)], "t string")
    return rows.select("t", X.is_valid_topic_name(F.col("t")).alias("valid"))


@query("SELECT n, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(320, (least(n, 3600000) + 63) // 64 * 64) END AS BIGINT) AS wait, CAST((n + 127) // 128 * 128 AS BIGINT) AS wake, greatest(n - 1000, 0) AS delta FROM (SELECT event_id * 613 AS n FROM events)")
def X24_X26_waits(v: Views) -> DataFrame:
    n = F.col("n")
    return v.table("events").select((F.col("event_id") * 613).alias("n")).select("n", X.normalized_max_wait(n).alias("wait"), X.normalize_wakeup_time(n).alias("wake"), X.seconds_delta(n, F.lit(1000)).alias("delta"))


@query("SELECT i AS attempt, CAST(pow(2, i) * 144 AS BIGINT) AS ms FROM range(10) r(i)")
def X27_backoff(v: Views) -> DataFrame:
    return v.spark.range(10).select(F.col("id").alias("attempt"), X.reconnect_backoff(F.col("id")).alias("ms"))


@query("SELECT conv_id, turn, json_extract_string(j, '$.role') AS role, CAST(json_extract(j, '$.turn') AS BIGINT) AS t FROM (SELECT conv_id, turn, json_object('role', role, 'turn', turn) AS j FROM conversations)")
def X31_json(v: Views) -> DataFrame:
    rows = v.table("conversations").select("conv_id", "turn", F.to_json(F.struct("role", "turn")).alias("j"))
    parsed = F.from_json("j", "role STRING, turn LONG")
    return rows.select("conv_id", "turn", parsed["role"].alias("role"), parsed["turn"].alias("t"))


@query("SELECT event_id, user_id AS value, user_id AS back FROM events")
def X21_varint(v: Views) -> DataFrame:
    """Numbers through the varint form of the segment files, a batch of rows at a time."""
    import pyarrow as pa

    from ..sources.encoding import read_varint, varint

    def run(batches):
        for b in batches:
            coded = [varint(x) for x in b["value"].to_pylist()]
            back = [read_varint(c, 0, len(c))[0] for c in coded]
            yield pa.RecordBatch.from_arrays([b["event_id"], b["value"], pa.array(back, pa.int64())], names=["event_id", "value", "back"])

    return v.table("events").select("event_id", F.col("user_id").alias("value")).mapInArrow(run, "event_id long, value long, back long")


@query("SELECT event_id, props AS back FROM events")
def X22_snappy(v: Views) -> DataFrame:
    """Content through raw Snappy blocks, as compressed bundles have it."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            plain = [x.encode() for x in b["props"].to_pylist()]
            back = [pa.decompress(pa.compress(x, codec="snappy", asbytes=True), decompressed_size=len(x), codec="snappy", asbytes=True).decode() for x in plain]
            yield pa.RecordBatch.from_arrays([b["event_id"], pa.array(back)], names=["event_id", "back"])

    return v.table("events").select("event_id", "props").mapInArrow(run, "event_id long, back string")


@query("SELECT spec, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM (VALUES ('2024.01.02@3:04', 1704164640, 4294967295), ('2024.01.02+90', 1704153600, 1704153690), ('2024.02.30', 0, 0), ('2024.01.02@24', 0, 0)) x(spec, lo, hi)")
def X1_time_window(v: Views) -> DataFrame:
    from ..functions.parsers import parse_time_window

    specs = ("2024.01.02@3:04", "2024.01.02+90", "2024.02.30", "2024.01.02@24")
    return v.spark.createDataFrame([(s, *parse_time_window(s, T0 // 1000)) for s in specs], "spec string, lo long, hi long")


@query("SELECT spec, CAST(n AS BIGINT) AS n FROM (VALUES ('1d+2h', 93600), ('1w,1d', 691200), ('1d2h', 93600), ('2weeks3days', 1468800), ('1g', 1073741824), ('1m+1k', 1049600), ('1g512m', 1610612736), ('2megabytes', 2097152), ('3gbs', 3221225472)) x(spec, n)")
def X3_X4_durations_and_sizes(v: Views) -> DataFrame:
    from ..functions.parsers import parse_duration, parse_size

    return v.spark.createDataFrame([*((s, parse_duration(s)) for s in ("1d+2h", "1w,1d", "1d2h", "2weeks3days")), *((s, parse_size(s)) for s in ("1g", "1m+1k", "1g512m", "2megabytes", "3gbs"))], "spec string, n long")


# --- the binary format


@query(f'SELECT {MSG} FROM messy')
def S9_S13_segment_files(v: Views) -> DataFrame:
    from ..sources.segments import read_segments, write_segments
    from ..sources.store import scratch

    path = scratch(v.spark, "segments")
    write_segments(v.messy, path)
    rows = read_segments(v.spark, path)
    return rows.select(*TP, "seq", "ts_ms", F.col("key").cast("string").alias("key"), F.col("content").cast("string").alias("content"))


@query(f"SELECT {MSG} FROM messy WHERE topic = 'view' AND \"partition\" = 1 AND seq BETWEEN 50 AND 70")
def S5_F7_segment_range(v: Views) -> DataFrame:
    """A range of one partition from its segment files: folders and files are chosen by name, bundles by their headers."""
    from ..sources.segments import read_segments, write_segments
    from ..sources.store import scratch

    path = scratch(v.spark, "ranged")
    write_segments(v.messy.where("topic = 'view'"), path)
    rows = S.consume_from(read_segments(v.spark, path), "view", 1, 50, end_seq=70)
    return rows.select(*TP, "seq", "ts_ms", F.col("key").cast("string").alias("key"), F.col("content").cast("string").alias("content"))


@query(with_cte("s AS (SELECT topic, \"partition\", segment_base, count(*) AS messages, max(seq) AS last_seq FROM messy GROUP BY ALL)", 'SELECT topic, "partition", segment_base AS base_seq, last_seq, messages FROM s'))
def A20_verify_files(v: Views) -> DataFrame:
    from ..sources.segments import verify_segments, write_segments
    from ..sources.store import scratch

    path = scratch(v.spark, "verify")
    write_segments(v.messy, path)
    return verify_segments(v.spark, path).select(*TP, "base_seq", "last_seq", "messages")


_FNV = "list_reduce({bytes}, lambda h, b: xor((h * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT), b), CAST(14695981039346656037 AS HUGEINT))"


@query(f"SELECT event_id, CAST(CASE WHEN h >= CAST(9223372036854775808 AS HUGEINT) THEN h - CAST(18446744073709551616 AS HUGEINT) ELSE h END AS BIGINT) AS fnv FROM (SELECT event_id, {_FNV.format(bytes=_BYTES.format(kind='HUGEINT'))} AS h FROM events)")
def X19_fnv1(v: Views) -> DataFrame:
    return v.table("events").select("event_id", X.fnv1_64(F.col("props").cast("binary")).alias("fnv"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of partition 0 from a position on, in a time window, with a substring, limited: one scan with pushed filters."""
    rows = S.consume_from(Views(spark, sf_dir).log, "purchase", 0, 10, time_range=(T0, T0 + 20 * DAY), contains="k", limit=100)
    return rows.select("seq", "ts_ms", "key", "content")


QUERIES["consume"] = flagship
ORACLES["consume"] = sql(f"SELECT seq, ts_ms, key, content FROM log WHERE topic = 'purchase' AND \"partition\" = 0 AND seq >= 10 AND ts_ms >= {T0} AND ts_ms < {T0 + 20 * DAY} AND contains(content, 'k') ORDER BY seq LIMIT 100")
