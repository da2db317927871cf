import pytest
from pyspark.sql import functions as F

from loamlog.functions import parsers, text
from loamlog.schemas import InvalidRequest

NOW = 1_537_000_000  # 2018-09-15 08:26:40 UTC
DAY = 1_536_969_600


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ("T-1h+2m", (NOW - 3600, NOW - 3600 + 120)),
        ("T", (NOW, parsers.OPEN_END)),
        ("2018.09.15@20:30", (DAY + 20 * 3600 + 1800, parsers.OPEN_END)),
        ("today", (DAY, parsers.OPEN_END)),
        ("YESTERDAY@7", (DAY - 86400 + 7 * 3600, parsers.OPEN_END)),
        ("today+90", (DAY, DAY + 90)),
        ("2018.09.15@1:2:3-2d", (DAY + 3723 - 172800, parsers.OPEN_END)),
    ],
)
def test_time_window(spec, want):
    assert parsers.parse_time_window(spec, NOW) == want


@pytest.mark.parametrize("spec", ["20180915", "2018.02.30", "T-", "T-1w", "T+5x", "2018.09.15@24", "T@3", "", "x", "2018.09.15@20:30-2018.09.20@10:30", "1899.01.01", "2201.01.01", "today@1:60"])
def test_bad_time_window(spec):
    assert parsers.parse_time_window(spec, NOW) == (0, 0)


def test_dates_without_dots_and_zones():
    assert parsers.parse_time_window("20180915", NOW, accept_yyyymmdd=True)[0] == DAY
    assert parsers.parse_time_window("2018.09.15", NOW, zone="Europe/Athens")[0] == DAY - 3 * 3600


@pytest.mark.parametrize(("spec", "want"), [("1d+2h", 93600), ("90", 90), ("1w,1d", 691200), ("1month", 2592000), ("1d2h", 93600), ("1d,", 86400), ("2weeks3days", 1468800)])
def test_duration(spec, want):
    assert parsers.parse_duration(spec) == want


@pytest.mark.parametrize(("spec", "want"), [("1g", 1 << 30), ("512k", 512 << 10), ("1m+1k", 1049600), ("1g512m", 1610612736), ("2megabytes", 2 << 20), ("3gbs", 3 << 30)])
def test_size(spec, want):
    assert parsers.parse_size(spec) == want


@pytest.mark.parametrize("spec", ["5m", "", "1d,,", "1d-", ",1d", "1d 2x", "x"])
def test_bad_duration(spec):
    with pytest.raises(InvalidRequest):
        parsers.parse_duration(spec)


def test_config():
    base = parsers.parse_config("retention.segments.count = 4\n# comment\nLOG.CLEANUP.POLICY=cleanup  # too\nnope=1")
    assert (base.retention_segments, base.cleanup_policy, base.warnings) == (4, "cleanup", ("unknown key nope",))
    assert parsers.parse_config("log.segment.bytes=1m", base).retention_segments == 4
    for bad in ("retention.segments.count=1", "log.retention.bytes=127", "log.segment.bytes=1", "log.cleaner.min.cleanable.ratio=2", "log.cleanup.policy=x", "log.roll.secs="):
        with pytest.raises(InvalidRequest):
            parsers.parse_config(bad)


@pytest.mark.parametrize(("size", "want"), [(0, "0b"), (1023, "1023b"), (1024, "1kb"), (1536, "1.5kb"), (1 << 20, "1mb"), (5 << 40, "5tb")])
def test_size_repr(spark, size, want):
    assert spark.range(1).select(text.size_repr(F.lit(size).cast("long"))).first()[0] == want


@pytest.mark.parametrize(("ms", "want"), [(0, 0), (1, 320), (320, 320), (321, 384), (1000, 1024), (10**9, 3_600_000)])
def test_max_wait(spark, ms, want):
    assert spark.range(1).select(text.normalized_max_wait(F.lit(ms))).first()[0] == want
