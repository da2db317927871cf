"""Tailing, draining, replication and long polls with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.scan import consume
from ..schemas import TP
from ..sources.store import scratch


FOLD = 64  # epochs after which the marks of a replication become one set


def stream_log(spark: SparkSession, path: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    """A log's folder as a stream: what is there and what is appended."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def tail(stream: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages of a stream from each source's ``start_seq`` on; with the position after the high-water mark these are the new ones only."""
    return consume(stream, sources)


def drain_stream(stream: DataFrame, sources: DataFrame) -> DataFrame:
    """All that a stream has from the sources on, then stop: one run with ``availableNow`` and exactly-once file output."""
    spark = stream.sparkSession
    out = scratch(spark, "drained")
    tail(stream, sources).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain(log: DataFrame, sources: DataFrame) -> DataFrame:
    """:func:`drain_stream` of rows that aren't stored yet; a stored log is streamed from its folder."""
    at = scratch(log.sparkSession, "drain")
    log.write.parquet(at)
    return drain_stream(stream_log(log.sparkSession, at, log.schema), sources)


def replicate(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Copy a stream to a destination log, without what the destination has already; a batch that is run again writes nothing twice.

    Only messages beyond each partition's high-water mark are appended, so the copy is idempotent by its sequence numbers.
    """

    def marked(spark: SparkSession, epoch: int) -> DataFrame | None:
        """Marks before an epoch: the newest fold and the epochs after it."""
        try:
            found = spark.read.schema("topic string, partition int, high long, epoch long").parquet(marks).where(F.col("epoch") < epoch)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return found.groupBy(*TP).agg(F.max("high").alias("_high"))

    def copy(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = marked(spark, epoch)
        rows = batch if known is None else batch.join(known, TP, "left").where(F.col("seq") > F.coalesce("_high", F.lit(0))).drop("_high")
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        own = spark.read.schema(batch.schema).parquet(f"{path}/epoch={epoch}").groupBy(*TP).agg(F.max("seq").alias("high"))
        if known is not None and epoch % FOLD == 0:  # one file set then has all marks, and those of older epochs go
            own = own.unionByName(known.withColumnRenamed("_high", "high")).groupBy(*TP).agg(F.max("high").alias("high"))
        own.write.mode("overwrite").parquet(f"{marks}/epoch={epoch}")
        if known is not None and epoch % FOLD == 0:
            folder = spark._jvm.org.apache.hadoop.fs.Path(marks)
            fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            for old in fs.listStatus(folder):
                name = old.getPath().getName()
                if name.startswith("epoch=") and int(name[6:]) < epoch - 1:  # the last one may run again
                    fs.delete(old.getPath(), True)

    marks = f"{checkpoint}-marks"
    return stream.writeStream.foreachBatch(copy).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def replicate_available(stream: DataFrame) -> DataFrame:
    """Replicate all that a stream has once."""
    spark = stream.sparkSession
    out = scratch(spark, "replica")
    replicate(stream, out, f"{out}-offsets", availableNow=True).awaitTermination()
    return spark.read.parquet(out).select(*stream.columns)


class LongPoll(StatefulProcessor):
    """Answers waiting requests: at once when ``min_bytes`` have come, messages go on in another segment or the mark is passed, else when ``max_wait_ms`` are over.

    Rows have ``kind``: a ``request`` of a consumer (``min_bytes``, ``max_wait_ms``) or of a replica (``min_bytes`` null, ``above_mark``), a ``message`` (``size``, ``seq``, ``segment_base``) or a ``mark`` (``seq``, the new
    high-water mark). Output: ``captured`` bytes, ``high`` (the last sequence number or mark seen) and ``reason`` (``bytes``, ``segment``, ``mark`` or ``timeout``).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "min_bytes long, captured long, high long, above_mark long, segment long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.waiting.get()) if self.waiting.exists() else None
        reason = None
        for frame in rows:
            for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                if row["kind"] == "request":
                    least = -1 if row.get("min_bytes") is None else int(row["min_bytes"])
                    state = [least, 0, state[2] if state else 0, -1 if row.get("above_mark") is None else int(row["above_mark"]), -1]
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, int(row["max_wait_ms"])))
                elif state is not None and reason is None:
                    state[2] = max(state[2], int(row["seq"]))
                    if row["kind"] == "mark":
                        reason = "mark" if state[0] < 0 and int(row["seq"]) > state[3] else None
                    elif state[0] >= 0:
                        segment = -1 if row.get("segment_base") is None else int(row["segment_base"])
                        if state[4] not in (-1, segment):
                            reason = "segment"
                        state[4] = segment
                        state[1] += int(row["size"])
        if state is not None and reason is None and 0 <= state[0] <= state[1]:
            reason = "bytes"
        if reason is not None:
            self.waiting.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            yield self._answer(key, state, reason)
        elif state is not None:
            self.waiting.update(tuple(state))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            state = self.waiting.get()
            self.waiting.clear()
            yield self._answer(key, state, "timeout")

    @staticmethod
    def _answer(key, state, reason: str) -> pd.DataFrame:
        return pd.DataFrame({"topic": [key[0]], "partition": [key[1]], "captured": [state[1]], "high": [state[2]], "timed_out": [reason == "timeout"], "reason": [reason]})

    def close(self) -> None:
        pass


def long_poll(rows: DataFrame) -> DataFrame:
    """Run :class:`LongPoll` for each partition of a stream; needs the RocksDB state store."""
    return rows.groupBy(*TP).transformWithStateInPandas(LongPoll(), "topic string, partition int, captured long, high long, timed_out boolean, reason string", "Append", "processingTime")
