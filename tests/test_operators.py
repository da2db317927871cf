import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamlog.functions import text as functions
from loamlog.operators import append, cluster, maintenance, metrics, scan
from loamlog.schemas import InvalidRequest

LOG = "topic string, partition int, seq long, ts_ms long, key string, content string"


def log(spark, rows):
    return spark.createDataFrame([("t", 0, *r) for r in rows], LOG)


def test_compaction_example(spark):
    rows = [(1, 0, "a", "1"), (2, 0, None, "x"), (3, 0, "b", "2"), (4, 0, "a", "3"), (5, 0, None, ""), (6, 0, "b", ""), (7, 0, "", "y")]
    df = log(spark, rows)
    assert sorted(r.seq for r in maintenance.compact(df).collect()) == [2, 4, 6, 7]
    assert sorted(r.seq for r in maintenance.compact(df, tombstones="drop").collect()) == [2, 4, 7]
    once = maintenance.compact(df)
    assert sorted(maintenance.compact(once).collect()) == sorted(once.collect())
    with pytest.raises(ValueError):
        maintenance.compact(df, tombstones="?")


@pytest.mark.parametrize(("n", "b", "a", "now", "dropped"), [(2, 0, 0, 0, 2), (0, 250, 0, 0, 2), (0, 0, 15, 40, 2), (0, 0, 0, 0, 0)])
def test_retention_example(spark, n, b, a, now, dropped):
    rows = [("t", 0, i * 10 + 1, i * 10 + 10, (i + 1) * 10, 100, True) for i in range(4)]
    df = spark.createDataFrame(rows, "topic string, partition int, base_seq long, last_seq long, created_ts long, size_bytes long, sealed boolean")
    found = maintenance.retention(df, n, b, a, now).orderBy("base_seq").collect()
    assert [r.dropped for r in found] == [True] * dropped + [False] * (4 - dropped)


def test_retention_equals_the_loop(spark):
    r = random.Random(1)
    cases = []
    for p in range(60):
        cases += [("t", p, 100 * i + 1, 100 * i + 100, r.randint(1, 50), r.randint(1, 90), True) for i in range(r.randint(1, 7))]
    df = spark.createDataFrame(cases, "topic string, partition int, base_seq long, last_seq long, created_ts long, size_bytes long, sealed boolean")
    got = {(x.partition, x.base_seq) for x in maintenance.retention(df, 3, 120, 20, 60).where("dropped").collect()}
    want = set()
    for p in range(60):
        own = [c for c in cases if c[1] == p]
        while own and (len(own) > 3 or sum(c[5] for c in own) > 120 or own[0][4] + 20 < 60):
            want.add((p, own.pop(0)[2]))
    assert got == want


def test_prefix_stop_and_limit(spark):
    df = log(spark, [(i, 100 * i if i != 5 else 9000, str(i), f"c{i}") for i in range(1, 10)])
    strict = scan.consume_from(df, "t", 0, 2, time_range=(0, 800), strict=True)
    assert sorted(r.seq for r in strict.collect()) == [2, 3, 4]
    assert sorted(r.seq for r in scan.consume_from(df, "t", 0, 2, time_range=(0, 800)).collect()) == [2, 3, 4, 6, 7]
    assert [r.seq for r in scan.consume_from(df, "t", 0, 0, contains="c", limit=3).collect()] == [1, 2, 3]
    assert scan.consume_from(df, "t", 0, "end").count() == 0
    assert scan.consume_from(df, "t", 0, 3, end_seq=4, committed_to=3).count() == 1


def test_pushdown(spark, tmp_path):
    log(spark, [(i, i, "k", "c") for i in range(50)]).write.parquet(str(tmp_path / "log"))
    df = scan.consume_from(spark.read.parquet(str(tmp_path / "log")), "t", 0, 10, time_range=(0, 40)).select("seq")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(seq,10)" in plan and "LessThan(ts_ms,40)" in plan
    assert "content" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize(("spec", "want"), [("beginning", 0), ("BEGINNING", 0), ("first", 0), ("End", "end"), ("eof", "end"), ("17", 17)])
def test_start_spec(spec, want):
    assert scan.start_spec(spec) == want


@pytest.mark.parametrize("spec", ["First", "", "-1", "x", str(2**63)])
def test_bad_start_spec(spec):
    with pytest.raises(InvalidRequest):
        scan.start_spec(spec)


def test_clamp(spark):
    rows = spark.createDataFrame([(s,) for s in (5, 15, 20, 21, 99)], "s long")
    assert [r[0] for r in rows.select(scan.clamp_seq(F.col("s"), F.lit(10), F.lit(20))).collect()] == [10, 15, 20, 21, 21]


def greedy(sizes, most, limit, reached):
    out, batch, n, total = [], 0, 0, 0
    for s in sizes:
        if n and (n >= most or total > limit or reached and total == limit):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + s
        out.append(batch)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 6), st.integers(1, 90), st.booleans())
def test_greedy_batches(spark, sizes, most, limit, reached):
    df = spark.createDataFrame([("t", 0, i, s) for i, s in enumerate(sizes)], "topic string, partition int, seq long, size long")
    assert [r.batch for r in append.greedy_batches(df, most, limit, reached=reached).orderBy("seq").collect()] == greedy(sizes, most, limit, reached)


def test_a_batch_ends_where_its_bytes_reach_the_limit(spark):
    df = spark.createDataFrame([("t", 0, i, 10) for i in range(6)], "topic string, partition int, seq long, size long")
    assert [r.batch for r in append.greedy_batches(df, 128, 20).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert [r.batch for r in append.greedy_batches(df, 3, 1000).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_gap_makes_a_mirrored_bundle_sparse(spark):
    df = log(spark, [(s, 0, "k", "xyz") for s in (4, 5, 6, 8, 9, 10, 11)])
    marks = spark.createDataFrame([("t", 0, 3)], "topic string, partition int, high_water_mark long")
    rows = append.mirror_bundles(df, marks, 3, 1 << 20).orderBy("batch").collect()
    assert [(r.first_seq, r.last_seq, r.messages, r.bytes, r.sparse) for r in rows] == [(4, 6, 3, 12, False), (8, 10, 3, 12, True), (11, 11, 1, 4, False)]
    assert append.mirror_bundles(df, None, 3, 1 << 20).orderBy("batch").first().sparse


@pytest.mark.parametrize("bound", [1, 2, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 65, 75, 85, 95, 100, 110, 120, 130, 140, 150, 200, 250, 300, 350, 400, 450, 500])
def test_each_bound(spark, bound):
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(metrics.bucket(F.lit(bound)), metrics.bucket(F.lit(bound - 0.5))))).collect()] == [bound, bound]
    assert len(metrics.BOUNDS) == 30


def test_rolls_are_due(spark):
    rows = spark.createDataFrame([(0, 99, 0), (10, 0, 0), (101, 0, 0), (10, 51, 0), (10, 0, 900)], "size long, index long, created long")
    due = append.roll_due(F.col("size"), F.col("index"), F.col("created"), 1000, 100, 50, F.lit(999))
    assert [r[0] for r in rows.select(due).collect()] == [False, True, True, True, False]
    assert [r[0] for r in rows.select(append.roll_due(F.col("size"), F.col("index"), F.col("created"), 1000, 100, 50, F.lit(0), max_age_secs=99)).collect()] == [False, True, True, True, True]
    found = {r[0] for r in spark.range(200).select(append.roll_jitter(10_000, F.col("id"))).collect()}
    assert min(found) == 3600 and max(found) < 10_000 and spark.range(1).select(append.roll_jitter(0, F.col("id"))).first()[0] == 604_800


@pytest.mark.parametrize("text", ["a\n", "12\n"])
def test_a_final_line_feed_counts(spark, text):
    row = spark.range(1).select(functions.is_valid_topic_name(F.lit(text)).alias("a"), functions.all_digits(F.lit(text)).alias("b"), functions.parse_integer(F.lit(text)).alias("c"), functions.parse_double(F.lit(text)).alias("d")).first()
    assert tuple(row) == (False, False, None, None)


@pytest.mark.parametrize(("us", "want"), [(999, "999us"), (1500, "0.002s"), (1_500_000, "1.5s"), (125_000_000, "2m5s"), (120_000_000, "2m"), (5_400_000_000, "1h30m"), (3_600_000_000, "1h")])
def test_durations(spark, us, want):
    assert spark.range(1).select(functions.duration_repr(F.lit(us))).first()[0] == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_the_stored_log_is_pruned_and_filtered(spark):
    from loamlog.plans.views import Views

    plan = scan.consume_from(Views(spark, "/root/testdata/sf0.001").log, "view", 1, 50)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(seq,50)" in plan and "(partition" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "Window" not in plan and "Exchange" not in plan


def test_roll_keeps_the_crossing_bundle(spark):
    df = spark.createDataFrame([("t", 0, i, b) for i, b in enumerate((60, 60, 60, 10))], "topic string, partition int, bundle_base long, bytes long")
    assert [r.segment for r in append.roll_segments(df, 100).orderBy("bundle_base").collect()] == [0, 0, 1, 1]


def test_sparse_index(spark):
    df = spark.createDataFrame([("t", 0, 1, 1 + i, 30) for i in range(6)], "topic string, partition int, segment_base long, bundle_base long, bytes long")
    assert [(r.rel_seq, r.offset) for r in append.sparse_index(df, 50).orderBy("offset").collect()] == [(0, 0), (2, 60), (4, 120)]


def test_validate_explicit(spark):
    df = spark.createDataFrame([("t", 0, 1, 5), ("t", 0, 2, 7), ("t", 0, 3, 7), ("t", 0, 4, 6)], "topic string, partition int, arrival long, seq long")
    assert sorted(r.arrival for r in append.validate_explicit(df).collect()) == [3, 4]


def test_previous_across_blocks(spark):
    seqs = [1, 65_535, 65_536, 200_000, 200_001]
    df = spark.createDataFrame([("t", 0, s) for s in seqs], "topic string, partition int, seq long")
    assert [r.prev_seq for r in scan.with_previous(df, ["seq"]).orderBy("seq").collect()] == [None, *seqs[:-1]]


def test_pages_across_blocks(spark):
    df = log(spark, [(s, 0, None, "x" * 12) for s in (1, 2, 70_000, 70_001, 140_000)])
    assert sorted(r.seq for r in scan.page_by_bytes(df, 45).collect()) == [1, 2, 70_000]


@pytest.mark.parametrize(("latency", "want"), [(0, 1), (1, 1), (3, 5), (500, 500), (501, None)])
def test_bucket(spark, latency, want):
    assert spark.range(1).select(metrics.bucket(F.lit(latency))).first()[0] == want


@pytest.mark.parametrize(("asked", "rf", "isr", "want"), [(0, 3, 3, 2), (255, 3, 3, 2), (1, 3, 3, 1), (255, 5, 5, 3)])
def test_required_acks(spark, asked, rf, isr, want):
    assert spark.range(1).select(cluster.required_acks(F.lit(asked), F.lit(rf), F.lit(isr))).first()[0] == want


def test_empty_log(spark):
    df = log(spark, []).withColumn("segment_base", F.lit(1).cast("long"))
    assert maintenance.compact(maintenance.sealed(df)).count() == 0
    assert scan.gaps(df).count() == 0
    assert maintenance.segments_of(df).count() == 0
