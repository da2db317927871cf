"""The at-rest form of a log: Parquet partitioned by topic and partition, and topic tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_valid_topic_name
from ..schemas import PARTITIONS, TOPICS, TP, InvalidRequest


def shared_folder(spark: SparkSession) -> str:
    """URI of ``spark.checkpoint.dir``, which all machines share. Where it is unset, a session on one machine gets a folder of its own and one on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not at.isDefined():
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise InvalidRequest("spark.checkpoint.dir names no folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loamlog-"))
            at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get()
    return found if "://" in found or found.startswith("file:") else f"file://{os.path.abspath(found)}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append_log(rows: DataFrame, path: str) -> None:
    """Append messages. Rows are dealt by partition and ranges of seq, so a large partition has many writers and files are sorted by seq for pruning."""
    rows.repartitionByRange(*TP, "seq").sortWithinPartitions(*TP, "seq").write.mode("append").partitionBy(*TP).parquet(path)


def path_status(spark: SparkSession, path: str) -> int | None:
    """When a file was changed, in ms; null where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(at).getModificationTime() if fs.exists(at) else None


def append_message(spark: SparkSession, path: str, topic: str, partition: int, ts_ms: int, key: str | None, content: str) -> int:
    """Append one message to a stored log; returns its sequence number, the next one of its partition."""
    log = read_log(spark, path)
    high = log.where((F.col("topic") == topic) & (F.col("partition") == partition)).agg(F.max("seq")).first()[0]
    row = spark.createDataFrame([((high or 0) + 1, ts_ms, key, content, topic, partition)], "seq long, ts_ms long, key string, content string, topic string, partition int")
    append_log(row, path)
    return (high or 0) + 1


def reset_partition(spark: SparkSession, path: str, topic: str, partition: int) -> bool:
    """Delete the files of one partition; false if it has none. The partition itself stays known."""
    jvm = spark._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(topic)
    at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/topic={name}/partition={partition}")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stored log. With its ``schema`` known, as DDL, no file is read for it and topics that look like numbers stay texts."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if schema:
        return rows
    return rows.select(F.col("topic").cast("string").alias("topic"), F.col("partition").cast("int").alias("partition"), *(c for c in rows.columns if c not in TP))


def create_topic(spark: SparkSession, path: str, name: str, partitions: int, rf: int = 1) -> None:
    """Register a topic and its empty partitions below ``path``."""
    valid = spark.range(1).select(is_valid_topic_name(F.lit(name))).first()[0]
    if partitions < 1 or not valid or not 1 <= rf <= 64:
        raise InvalidRequest(f"can't create {name!r} with {partitions} partitions")
    try:
        known = spark.read.parquet(f"{path}/topics").where(F.col("name") == name).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = 0
    if known:
        raise InvalidRequest(f"{name!r} exists")
    spark.createDataFrame([(name, p, 0, 0) for p in range(partitions)], PARTITIONS).write.mode("append").parquet(f"{path}/partitions")
    spark.createDataFrame([(name, partitions, True, rf)], TOPICS).write.mode("append").parquet(f"{path}/topics")
