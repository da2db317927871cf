"""Long polls over a log as data: which message answers each waiting request, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TP
from .scan import message_size, with_previous

BUCKET = 16  # bits of positions (bytes or sequence numbers) that meet in one group of the joins


def _running(log: DataFrame) -> DataFrame:
    """``ends``: bytes of a partition up to and with each message, added up by blocks."""
    sized = log.withColumn("_size", message_size(stats=True).cast("long")).withColumn("_block", F.shiftright("seq", 16))
    blocks = sized.groupBy(*TP, "_block").agg(F.sum("_size").alias("_sum"))
    ahead = blocks.select(*TP, "_block", (F.sum("_sum").over(Window.partitionBy(*TP).orderBy("_block")) - F.col("_sum")).alias("_ahead"))
    within = F.sum("_size").over(Window.partitionBy(*TP, "_block").orderBy("seq"))
    return sized.withColumn("_within", within).join(ahead, [*TP, "_block"]).withColumn("ends", F.col("_ahead") + F.col("_within")).withColumn("starts", F.col("ends") - F.col("_size")).drop("_block", "_within", "_ahead", "_size")


def _buckets(first, last):
    return F.explode(F.sequence(F.shiftright(first, BUCKET), F.shiftright(F.greatest(first, last), BUCKET)))


def answer_polls(requests: DataFrame, log: DataFrame) -> DataFrame:
    """The answer of each request ``id``, ``topic``, ``partition``, ``from_seq``, ``at_ms``, ``max_wait_ms`` and ``min_bytes`` or ``above_mark`` (the other null).

    A consumer's request (``min_bytes``) is answered by the first message from ``from_seq`` on with which so many bytes have come, or that goes to another segment than the
    first one of them; a replica's (``above_mark``) by the first message above that mark. The answer comes when that message does, at once if it is there already.
    Requests that none answers within ``max_wait_ms`` time out. Rows: ``id``, ``woken_seq``, ``woken_ms``, ``reason`` (``bytes``, ``segment``, ``mark`` or ``timeout``).
    Messages are appended in order of ``seq``, and no partition's messages meet in one task: requests meet them by buckets of positions.
    """
    spans = with_previous(_running(log), ["seq"]).withColumn("_low", F.coalesce("prev_seq", F.lit(0)) + 1)
    # the message that each request starts with: the first from from_seq on
    by_seq = spans.withColumn("_bucket", _buckets(F.col("_low"), F.col("seq"))).select(*TP, "_bucket", "_low", F.col("seq").alias("_seq"), F.col("starts").alias("_from"), F.col("segment_base").alias("_segment"))
    asked = requests.withColumn("_seek", F.greatest(F.col("from_seq"), F.lit(1))).withColumn("_bucket", F.shiftright("_seek", BUCKET))
    begun = asked.join(by_seq, [*TP, "_bucket"]).where("_seek between _low and _seq").select(*requests.columns, "_from", "_segment", F.col("_seq").alias("_first"))
    # the first message with enough bytes
    by_bytes = spans.withColumn("_bucket", _buckets(F.col("starts"), F.col("ends") - 1)).select(*TP, "_bucket", "starts", "ends", F.col("seq").alias("_by_bytes"))
    wanted = begun.withColumn("_need", F.col("_from") + F.greatest("min_bytes", F.lit(1)) - 1).withColumn("_bucket", F.shiftright("_need", BUCKET))
    enough = wanted.join(by_bytes, [*TP, "_bucket"]).where("_need >= starts and _need < ends").select("id", "_by_bytes")
    # the first message of the next segment
    firsts = log.groupBy(*TP, "segment_base").agg(F.min("seq").alias("_by_segment"))
    following = firsts.select(*TP, F.col("segment_base").alias("_segment"), F.lead("_by_segment").over(Window.partitionBy(*TP).orderBy("segment_base")).alias("_by_segment"))  # a row a segment
    # the first message above a mark
    above = requests.where("above_mark is not null").withColumn("_seek", F.col("above_mark") + 1).withColumn("_bucket", F.shiftright("_seek", BUCKET))
    marked = above.join(by_seq, [*TP, "_bucket"]).where("_seek between _low and _seq").select("id", F.col("_seq").alias("_by_mark"))
    found = requests.join(begun.select("id", "_segment"), "id", "left").join(enough, "id", "left").join(following, [*TP, "_segment"], "left").join(marked, "id", "left")
    consumer = F.col("min_bytes").isNotNull()
    by_segment = consumer & F.col("_by_segment").isNotNull() & (F.col("_by_bytes").isNull() | (F.col("_by_segment") < F.col("_by_bytes")))
    seq = F.when(by_segment, F.col("_by_segment")).when(consumer, F.col("_by_bytes")).otherwise(F.col("_by_mark"))
    why = F.when(by_segment, "segment").when(consumer, "bytes").otherwise("mark")
    picked = found.select(*requests.columns, seq.alias("_seq"), why.alias("_why"))
    timed = picked.join(log.select(*TP, F.col("seq").alias("_seq"), "ts_ms"), [*TP, "_seq"], "left")
    at, latest = F.greatest("at_ms", "ts_ms"), F.col("at_ms") + F.col("max_wait_ms")
    late = F.col("ts_ms").isNull() | (at > latest)
    return timed.select("id", F.when(~late, F.col("_seq")).alias("woken_seq"), F.when(late, latest).otherwise(at).alias("woken_ms"), F.when(late, "timeout").otherwise(F.col("_why")).alias("reason"))


