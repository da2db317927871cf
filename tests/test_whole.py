"""Queries whose feature is every row return every row."""

import os

import pytest
from pyspark.sql import functions as F

from loamlog.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


@pytest.mark.parametrize(("name", "left_out"), [("P6_time_since", ""), ("P4_ignore", ""), ("F8_enabled", "error")])
def test_every_message(spark, name, left_out):
    assert QUERIES[name](spark, SF).count() == events(spark).where(F.col("event_type") != left_out).count()


@pytest.mark.parametrize(("name", "last"), [("S11_foreach_message", "seq"), ("O5_O6_ordered_segments", "base_seq")])
def test_everything_in_order(spark, name, last):
    rows = [(r.topic, r.partition, r[last]) for r in QUERIES[name](spark, SF).collect()]
    assert rows == sorted(rows) and len({t for t, _, _ in rows}) == 5
    if last == "seq":
        assert len(rows) == events(spark).count()
