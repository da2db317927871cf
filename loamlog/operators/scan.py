"""Reading a log: start positions, ranges, predicates, pages and projections.

A log is any DataFrame with ``topic``, ``partition``, ``seq``, ``ts_ms``, ``key`` and ``content``. Filters are plain
column predicates, so they reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MAX_SEQ, TP, InvalidRequest

FETCH_LIMIT = 64 << 20
EOF = "end"


def start_spec(text: str) -> int | str:
    """``beginning`` or ``first`` as 0, ``end`` or ``eof`` as :data:`EOF`, digits as a sequence number."""
    lowered = text.lower()
    if lowered == "beginning" or text == "first":
        return 0
    if lowered in ("end", "eof"):
        return EOF
    if text.isascii() and text.isdigit() and int(text) <= MAX_SEQ:
        return int(text)
    raise InvalidRequest(f"not a start position: {text!r}")


def of_partition(log: DataFrame, topic: str, partition: int) -> DataFrame:
    return log.where((F.col("topic") == topic) & (F.col("partition") == partition))


def watermarks(log: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """``first_available`` and ``high_water_mark`` of each partition; (0, 0) for one of ``partitions`` without rows."""
    found = log.groupBy(*TP).agg(F.min("seq").alias("first_available"), F.max("seq").alias("high_water_mark"))
    if partitions is None:
        return found
    marks = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("first_available", "high_water_mark")]
    return partitions.select(*TP).distinct().join(found, TP, "left").select(*TP, *marks)


def consume_from(log: DataFrame, topic: str, partition: int, start: int | str = 0, *, end_seq: int | None = None, time_range: tuple[int, int] | None = None, contains: str | bytes | None = None, limit: int | None = None, committed_to: int | None = None, strict: bool = False) -> DataFrame:
    """Messages of one partition from ``start`` on.

    ``end_seq`` is inclusive, ``time_range`` half-open in ms, ``contains`` a plain substring of content (empty: none), ``limit`` counts rows that pass. ``strict``
    ends the output at the first row beyond ``end_seq`` or the time range's end, even if later rows would pass again.
    """
    rows = of_partition(log, topic, partition)
    if start == EOF:
        last = rows.agg(F.max("seq")).first()[0]
        start = (last or 0) + 1
    rows = rows.where(F.col("seq") >= start)
    if committed_to is not None:
        rows = rows.where(F.col("seq") <= committed_to)
    if strict:
        rows = prefix_stop(rows, end_seq, None if time_range is None else time_range[1])
    if end_seq is not None:
        rows = rows.where(F.col("seq") <= end_seq)
    if time_range is not None:
        rows = rows.where(in_time_range(*time_range))
    if contains:
        rows = rows.where(content_contains(contains))
    return rows.orderBy("seq").limit(limit) if limit is not None else rows


def in_time_range(start_ms: int, end_ms: int) -> Column:
    return (F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms)


def content_contains(part: str | bytes) -> Column:
    needle = part.encode() if isinstance(part, str) else part
    return F.contains(F.col("content").cast("binary"), F.lit(needle)) if needle else F.lit(True)


def prefix_stop(rows: DataFrame, end_seq: int | None, end_ms: int | None) -> DataFrame:
    """Rows before the first, in order of seq within each partition, that lies beyond ``end_seq`` or ``end_ms``."""
    beyond = F.lit(False)
    if end_seq is not None:
        beyond = beyond | (F.col("seq") > end_seq)
    if end_ms is not None:
        beyond = beyond | (F.col("ts_ms") >= end_ms)
    stops = rows.groupBy(*TP).agg(F.min(F.when(beyond, F.col("seq"))).alias("_stop"))
    return rows.join(stops, TP).where(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))).drop("_stop")


def consume(log: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages from each source's ``start_seq`` on; ``sources`` has one row for a (topic, partition).

    Sources are as many as there are partitions; Spark broadcasts them if they are small enough by its own threshold.
    """
    return log.join(sources.select(*TP, "start_seq"), TP).where(F.col("seq") >= F.col("start_seq")).drop("start_seq")


def resolve_offsets(requests: DataFrame, marks: DataFrame) -> DataFrame:
    """Outcome of each request ``start_seq``: ``read``, ``eof``, ``past_max`` or ``boundary``, and where to read from.

    ``marks`` has ``first_available``, ``last_assigned`` and ``max_seq``. A start of 0 is the first available message.
    """
    s, first, last, most = (F.col(c) for c in ("start_seq", "first_available", "last_assigned", "max_seq"))
    outcome = F.when((s == 0) & (first == 0), "eof").when(s == 0, "read").when(s == last + 1, "eof").when(s > most, "past_max").when((s > last) | (s < first), "boundary").otherwise("read")
    at = F.when((s == 0) & (outcome == "read"), first).otherwise(s)
    return requests.join(marks, TP, "left").select(*TP, "start_seq", outcome.alias("outcome"), at.cast("long").alias("read_from"))


def clamp_seq(seq: Column, first: Column, high: Column) -> Column:
    """A sequence number moved into ``[first, high + 1]``."""
    return F.when(seq < first, first).when(seq > high, high + 1).otherwise(seq).cast("long")


def seek_by_time(log: DataFrame, at_ms: int) -> DataFrame:
    """For each partition the first message with ``ts_ms >= at_ms``, or the one after the last; order of ts isn't assumed."""
    found = F.coalesce(F.min(F.when(F.col("ts_ms") >= at_ms, F.col("seq"))), F.max("seq") + 1)
    return log.groupBy(*TP).agg(found.cast("long").alias("seq"))


def covering_bundles(log: DataFrame, targets: DataFrame) -> DataFrame:
    """The bundle that holds each ``target`` or the last one before it; ``log`` has ``bundle_base``."""
    bundles = log.groupBy(*TP, "bundle_base").agg(F.lit(1).alias("_one")).drop("_one")
    joined = targets.join(bundles, TP, "left").where(F.col("bundle_base") <= F.col("target"))
    return joined.groupBy(*TP, "target").agg(F.max("bundle_base").alias("bundle_base"))


def covering_segments(segments: DataFrame, targets: DataFrame) -> DataFrame:
    """The segment that holds each ``target``, or where it falls in a gap the next one; beyond the last none."""
    joined = targets.join(segments, TP, "left").where(F.col("last_seq") >= F.col("target"))
    return joined.groupBy(*TP, "target").agg(F.min("base_seq").alias("base_seq"))


def index_lookup(index: DataFrame, targets: DataFrame) -> DataFrame:
    """As-of: the index entry with the greatest ``rel_seq`` up to each ``rel_target`` of a segment."""
    joined = targets.join(index, [*TP, "segment_base"]).where(F.col("rel_seq") <= F.col("rel_target"))
    best = F.max_by(F.struct("rel_seq", "offset"), "rel_seq").alias("b")
    return joined.groupBy(*TP, "segment_base", "rel_target").agg(best).select(*TP, "segment_base", "rel_target", "b.rel_seq", "b.offset")


def message_size(stats: bool = False) -> Column:
    """Bytes of the content; ``stats`` adds the key and 8 for the time."""
    content = F.coalesce(F.octet_length("content"), F.lit(0))
    return (content + F.coalesce(F.octet_length("key"), F.lit(0)) + 8 if stats else content).cast("long")


def page_by_bytes(rows: DataFrame, fetch_size: int) -> DataFrame:
    """Rows of each partition that start below ``fetch_size`` bytes; the one that crosses it is included.

    Sizes are summed in two steps, blocks of 2**16 sequence numbers first, so a large partition isn't one task's.
    """
    size = message_size(stats=True)
    sized = rows.withColumns({"_size": size, "_block": F.shiftright("seq", 16)})
    blocks = sized.groupBy(*TP, "_block").agg(F.sum("_size").alias("_sum"))
    ahead = blocks.select(*TP, "_block", (F.sum("_sum").over(Window.partitionBy(*TP).orderBy("_block")) - F.col("_sum")).alias("_ahead"))
    within = F.sum("_size").over(Window.partitionBy(*TP, "_block").orderBy("seq")) - F.col("_size")
    return sized.withColumn("_within", within).join(ahead, [*TP, "_block"]).where(F.col("_ahead") + F.col("_within") < min(fetch_size, FETCH_LIMIT)).drop("_size", "_block", "_within", "_ahead")


FIELDS = ("ts", "ts_ms", "seqnum", "size", "key", "content", "time_since")


def render(rows: DataFrame, fields: Sequence[str] = ("content",)) -> DataFrame:
    """``line`` of each message; tokens stand in a fixed order whatever the order of ``fields``. ``ignore`` gives no rows' text."""
    unknown = set(fields) - set(FIELDS) - {"ignore"}
    if unknown:
        raise InvalidRequest(f"unknown fields: {sorted(unknown)}")
    text = {
        "ts": F.concat(F.lit("ts:"), F.date_format(F.timestamp_millis("ts_ms"), "yyyy.MM.dd HH:mm:ss")),
        "ts_ms": F.concat(F.lit("ts_ms:"), F.col("ts_ms")),
        "seqnum": F.concat(F.lit("seq="), F.col("seq"), F.lit(":")),
        "size": F.concat(F.lit("size="), message_size(), F.lit(":")),
        "key": F.concat(F.lit("["), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("]:")),
        "content": F.col("content").cast("string"),
        "time_since": (F.unix_millis(F.current_timestamp()) - F.col("ts_ms")).cast("string"),
    }
    chosen = [text[f] for f in FIELDS if f in fields]
    return rows.select(*TP, "seq", (F.concat_ws(" ", *chosen) if chosen else F.lit("")).alias("line"))


def render_key_value(rows: DataFrame) -> DataFrame:
    return rows.select(*TP, "seq", F.format_string("%d [%s] = [%s]", "seq", F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("content").cast("string")).alias("line"))


def next_cursor(rows: DataFrame, sources: DataFrame, marks: DataFrame) -> DataFrame:
    """Where each source goes on: after its last message, or where it stands; ``drained`` if nothing came or the end is reached.

    A ``start_seq`` of -1 is the end of the log.
    """
    last = rows.groupBy(*TP).agg(F.max("seq").alias("_last"))
    s, high = F.col("start_seq"), F.coalesce("high_water_mark", F.lit(0))
    going = F.when(F.col("_last").isNotNull(), F.greatest(s, F.col("_last") + 1)).when(s == -1, high + 1).otherwise(s)
    drained = F.col("_last").isNull() | (F.col("_last") == high)
    return sources.join(last, TP, "left").join(marks, TP, "left").select(*TP, going.cast("long").alias("next_seq"), drained.alias("drained"))


def gaps(log: DataFrame) -> DataFrame:
    """Missing sequence numbers: ``after``, ``before`` and how many are ``missing`` between two neighbours.

    A neighbour is looked up within blocks of 2**16 sequence numbers; only a block's first and last meet those of other blocks.
    """
    return with_previous(log.select(*TP, "seq"), ["seq"]).where("seq - prev_seq > 1").select(*TP, F.col("prev_seq").alias("after"), F.col("seq").alias("before"), (F.col("seq") - F.col("prev_seq") - 1).alias("missing"))


def with_number(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Add each row's place in its partition by ``order`` (a whole number), from 1 on.

    Rows are numbered within blocks of 2**16 values of ``order`` and the blocks' counts are added up, so a partition with a third of all rows isn't one task's.
    """
    blocked = rows.withColumn("_block", F.shiftright(F.col(order).cast("long"), 16))
    counts = blocked.groupBy(*TP, "_block").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.select(*TP, "_block", (F.sum("_n").over(Window.partitionBy(*TP).orderBy("_block")) - F.col("_n")).alias("_ahead"))
    nth = F.row_number().over(Window.partitionBy(*TP, "_block").orderBy(order))
    joined = blocked.withColumn("_nth", nth).join(ahead, [*TP, "_block"])
    return joined.select(*rows.columns, (F.col("_ahead") + F.col("_nth")).cast("long").alias(name))


def with_previous(log: DataFrame, columns: Sequence[str], order: str = "seq") -> DataFrame:
    """Add ``prev_<column>`` of the message before in the partition, null for the first.

    One window over blocks of 2**16 values of ``order``, and one over a row for each block, replace a window over whole partitions.
    """
    blocked = log.withColumn("_block", F.shiftright(F.col(order).cast("long"), 16))
    lasts = blocked.groupBy(*TP, "_block").agg(F.max_by(F.struct(*columns), order).alias("_last"))
    before = lasts.select(*TP, "_block", F.lag("_last").over(Window.partitionBy(*TP).orderBy("_block")).alias("_before"))
    near = F.lag(F.struct(*columns)).over(Window.partitionBy(*TP, "_block").orderBy(order))
    joined = blocked.withColumn("_near", near).join(before, [*TP, "_block"], "left")
    prev = F.coalesce("_near", "_before")
    return joined.select(*log.columns, *(prev[c].alias(f"prev_{c}") for c in columns))


def delta_encoded(log: DataFrame) -> DataFrame:
    """What a sparse bundle stores of each message: ``delta`` = seq - previous - 1, and whether its time repeats."""
    rows = with_previous(log, ["seq", "ts_ms"])
    return rows.select(*TP, "seq", (F.col("seq") - F.col("prev_seq") - 1).alias("delta"), F.coalesce(F.col("ts_ms") == F.col("prev_ts_ms"), F.lit(False)).alias("same_ts"))


def implicit_seqs(rows: DataFrame, base: Column | str, order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Sequence numbers of dense bundles: the base and each message's place in its bundle."""
    base = F.col(base) if isinstance(base, str) else base
    return rows.withColumn("seq", (base + F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1).cast("long"))
