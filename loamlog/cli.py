"""Command line over a log store: ``python -m loamlog.cli STORE COMMAND ...``.

A store is a folder with ``log`` (Parquet by topic and partition), ``topics`` and ``partitions``.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.parsers import parse_time_window
from .operators import append, maintenance, metadata, scan
from .schemas import TP, BoundaryCheck, Fault, InvalidRequest, InvalidSeqNums, UnknownPartition, UnknownTopic
from .sources import segments, store


class Store:
    """The tables of a store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def log(self) -> DataFrame:
        try:
            return store.read_log(self.spark, f"{self.path}/log")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "topic string, partition int, seq long, ts_ms long, key binary, content binary")

    def check(self, topic: str, partition: int) -> None:
        found = {r.partition for r in self.table("partitions").where(F.col("topic") == topic).select("partition").collect()}
        if not found:
            raise UnknownTopic(topic)
        if partition not in found:
            raise UnknownPartition(f"{topic}/{partition}")

    def marks(self, topic: str | None = None) -> DataFrame:
        return metadata.discover_partitions(self.log(), self.table("partitions"), topic)


def consume(at: Store, args: argparse.Namespace) -> DataFrame:
    """Lines of the messages that pass, or with ``--stats`` their number and bytes."""
    at.check(args.topic, args.partition)
    start, window = scan.start_spec(args.start), None
    if args.time:
        first, last = parse_time_window(args.time, int(time.time()))
        if (first, last) == (0, 0):
            raise InvalidRequest(f"not a time window: {args.time!r}")
        window = (first * 1000, (last + 1) * 1000)
    if start not in (0, scan.EOF) and not args.clamp:
        mark = at.marks(args.topic).where(F.col("partition") == args.partition).first()
        if not mark.first_available <= start <= mark.high_water_mark + 1:
            raise BoundaryCheck(mark.first_available, mark.high_water_mark)
    end = None if args.stats else args.end
    rows = scan.consume_from(at.log(), args.topic, args.partition, start, end_seq=end, time_range=window, contains=args.filter, limit=args.limit, strict=args.strict)
    if args.stats:
        return rows.agg(F.concat(F.count(F.lit(1)), F.lit(" messages, "), F.coalesce(F.sum(scan.message_size(stats=True)), F.lit(0)), F.lit(" bytes")).alias("line"))
    lines = scan.render_key_value(rows) if args.key_value else scan.render(rows, args.fields.split(","))
    return lines.orderBy("seq").select("line")


def produce(at: Store, args: argparse.Namespace) -> DataFrame:
    """Append arguments, lines of a file, or a whole file; explicit numbers must lie beyond the last one."""
    at.check(args.topic, args.partition)
    spark = at.spark
    if args.lines:
        rows = spark.read.text(args.lines)
        rows = rows.select("value", F.monotonically_increasing_id().alias("arrival"))
    elif args.file:
        rows = spark.read.text(args.file, wholetext=True).select("value", F.lit(0).cast("long").alias("arrival"))
    else:
        rows = spark.createDataFrame([(v, i) for i, v in enumerate(args.messages)], "value string, arrival long")
    rows = append.key_value_lines(rows) if args.key_value else rows.withColumns({"key": F.lit(None).cast("string"), "content": F.col("value")})
    rows = rows.select(F.lit(args.topic).alias("topic"), F.lit(args.partition).alias("partition"), F.lit(int(time.time() * 1000)).cast("long").alias("ts_ms"), F.col("key").cast("binary").alias("key"), F.col("content").cast("binary").alias("content"), "arrival")
    marks = at.marks(args.topic)
    if args.base is None:
        rows = append.assign_sequences(rows, marks, "arrival")
    else:
        if args.base <= marks.where(F.col("partition") == args.partition).first().high_water_mark:
            raise InvalidSeqNums(str(args.base))
        rows = append.explicit_steps(rows, "arrival", args.base, args.step, int(time.time() * 1000), args.ts_step)
    store.append_log(rows.select(*TP, "seq", "ts_ms", "key", "content"), f"{at.path}/log")
    return at.marks(args.topic).where(F.col("partition") == args.partition).select(F.concat(F.lit("last "), "high_water_mark").alias("line"))


def mirror(at: Store, args: argparse.Namespace) -> DataFrame:
    """Copy what another store lacks; topics must have as many partitions there."""
    other = Store(at.spark, args.destination)
    wrong = append.partition_mismatches(at.table("partitions"), other.table("partitions")).collect()
    if wrong:
        raise InvalidRequest(f"partitions differ: {', '.join(r.topic for r in wrong)}")
    delta = append.mirror_delta(at.log(), other.log())
    store.append_log(delta, f"{args.destination}/log")
    return other.log().groupBy("topic").agg(F.max("seq").alias("seq")).select(F.concat_ws(" ", "topic", "seq").alias("line"))


def run(spark: SparkSession, arguments: list[str]) -> DataFrame:
    """The result of a command: rows with ``line``."""
    p = argparse.ArgumentParser(prog="loamlog")
    p.add_argument("store")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n, type=int if n in ("partition", "partitions") else str)
        return c

    c = command("consume", "topic", "partition", "start")
    c.add_argument("-F", "--fields", default="content")
    c.add_argument("-T", "--time")
    c.add_argument("-E", "--end", type=int)
    c.add_argument("-f", "--filter")
    c.add_argument("-l", "--limit", type=int)
    c.add_argument("-K", "--key-value", action="store_true")
    c.add_argument("-S", "--stats", action="store_true")
    c.add_argument("--strict", action="store_true")
    c.add_argument("--clamp", action="store_true")
    c = command("produce", "topic", "partition")
    c.add_argument("messages", nargs="*")
    c.add_argument("-f", "--lines")
    c.add_argument("-F", "--file")
    c.add_argument("-K", "--key-value", action="store_true")
    c.add_argument("-S", "--base", type=int)
    c.add_argument("-a", "--step", type=int, default=1)
    c.add_argument("-t", "--ts-step", type=int, default=0)
    command("discover_partitions", "topic")
    command("discover_topics")
    command("create_topic", "topic", "partitions")
    command("mirror", "destination")
    command("compact", "destination").add_argument("--tombstones", default="keep")
    command("verify", "segments")
    command("export", "segments").add_argument("--messages", type=int, default=100_000)
    args = p.parse_args(arguments)
    at = Store(spark, args.store)
    if args.command in ("consume", "produce", "mirror"):
        return {"consume": consume, "produce": produce, "mirror": mirror}[args.command](at, args)
    if args.command == "create_topic":
        store.create_topic(spark, args.store, args.topic, args.partitions)
        return spark.createDataFrame([(f"created {args.topic}",)], "line string")
    if args.command == "discover_partitions":
        at.check(args.topic, 0)
        return at.marks(args.topic).orderBy("partition").select(F.concat_ws(" ", "partition", "first_available", "high_water_mark").alias("line"))
    if args.command == "discover_topics":
        found = metadata.discover_topics(at.table("partitions"), at.table("topics").drop("partitions"))
        return found.orderBy("name").select(F.concat_ws(" ", "name", F.when(F.col("enabled"), "enabled").otherwise("disabled"), "partitions", "rf").alias("line"))
    if args.command == "compact":
        store.append_log(maintenance.compact(at.log(), args.tombstones), f"{args.destination}/log")
        return store.read_log(spark, f"{args.destination}/log").agg(F.concat(F.count(F.lit(1)), F.lit(" messages")).alias("line"))
    if args.command == "export":
        based = at.log().withColumn("segment_base", (F.floor((F.col("seq") - 1) / args.messages) * args.messages + 1).cast("long"))
        segments.write_segments(based, args.segments)
    found = segments.verify_segments(spark, args.segments)
    return found.select(F.concat_ws(" ", *TP, "base_seq", "messages", F.coalesce("error", F.lit("ok"))).alias("line"))


def main() -> int:
    spark = SparkSession.builder.appName("loamlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        for row in run(spark, sys.argv[1:]).toLocalIterator():
            print(row.line)
    except Fault as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
