"""Settings of partitions as data: what configuration texts say, applied to the tables of a log."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsers import TopicConfig, parse_config
from ..schemas import TP, Fault

SETTINGS = T.StructType([T.StructField(k, {int: T.LongType(), float: T.DoubleType(), str: T.StringType()}[type(v)]) for k, v in asdict(TopicConfig()).items() if k != "warnings"])


def effective_configs(partitions: DataFrame, configs: DataFrame) -> DataFrame:
    """Each partition with its settings: the defaults, over them its topic's text, over that its own.

    ``configs`` has ``topic``, ``partition`` (null: of the topic) and ``text``. A text that can't be read leaves the settings before it as they are and is named in ``fault``.
    """
    own = configs.where("partition is not null").select(*TP, F.col("text").alias("_own"))
    topics = configs.where("partition is null").select("topic", F.col("text").alias("_topic"))
    rows = partitions.select(*TP).join(topics, "topic", "left").join(own, TP, "left")
    names = SETTINGS.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, faults = [], []
            for texts in zip(b["_topic"].to_pylist(), b["_own"].to_pylist(), strict=True):
                config, fault = TopicConfig(), None
                for text in texts:
                    try:
                        config = parse_config(text or "", config)
                    except (Fault, ValueError) as e:
                        fault = str(e)
                found.append(asdict(config))
                faults.append(fault)
            kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.string() for f in SETTINGS]
            columns = [pa.array([c[n] for c in found], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b["topic"], b["partition"], *columns, pa.array(faults, pa.string())], names=[*TP, *names, "fault"])

    schema = T.StructType([T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), *SETTINGS, T.StructField("fault", T.StringType())])
    return rows.mapInArrow(run, schema)


def reload_config(current: DataFrame, configs: DataFrame, topic: str, partition: int) -> DataFrame:
    """``current`` settings with those of one partition read anew; a text that can't be read changes nothing but ``fault``."""
    chosen = (F.col("topic") == topic) & (F.col("partition") == partition)
    old = current.where(chosen)
    new = effective_configs(old, configs)
    good = new.where("fault is null")
    bad = old.drop("fault").join(new.where("fault is not null").select(*TP, "fault"), TP).select(*current.columns)
    return current.where(~chosen).unionByName(good).unionByName(bad)
