"""What the training-data operators share: the shared folder, Arrow slices, ragged arrays, components."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 3 << 20
pa.set_memory_pool(pa.system_memory_pool())  # gives large buffers back at once
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset, a session on one machine, as in tests, gets a
    folder of its own, and one on a cluster an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isDefined():
            found = at.get()
        elif not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        else:
            found = tempfile.mkdtemp(prefix="loamlog-")
            spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{os.path.abspath(found)}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to Parquet in the shared folder and read back, which cuts lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing will read any more: what was made of them is a table itself."""
    for table in tables:
        if path := getattr(table, "_stored_at", None):
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """As :func:`stored`, dealt by a hash of a column: joins and groups by that column then move only what meets this table.

    Its name in the session's catalog is made up; its files lie in the shared folder.
    """
    spark = df.sparkSession
    n, table = shuffle_partitions(spark), f"loamlog_{name}_{uuid.uuid4().hex}"
    df.repartition(n, column).write.bucketBy(n, column).option("path", shared_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def checkpointed(df: DataFrame) -> DataFrame:
    """As :func:`stored`, for steps of an iteration.

    ``DataFrame.checkpoint`` keeps the plan's size estimates, which each join of a loop multiplies until their digits
    fill the driver; a table that is read again has the size of its files.
    """
    return stored(df, "step")


def open_fs(uri: str):
    """File system and path of a URI, on the driver or an executor."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def bound_batches(df: DataFrame) -> DataFrame:
    """The rows, with Arrow batches of their session bound by bytes and not by rows alone, unless the session has set that itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(SLICE_BYTES))
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """Give what the allocators hold back to the machine; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_kept: dict = {}
_stage: int | None = None


def kept_in_worker(key, make):
    """A value that this process makes once and keeps for further tasks of the same stage; another stage's task starts without."""
    global _stage
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _stage:
        _kept.clear()
        _stage = stage
        release_memory()
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the column's values of a slice have about ``limit`` bytes; a larger value is alone."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    ends = np.cumsum(sizes.astype(np.int64))
    at, n = 0, len(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    release_memory()


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[s:s+n]`` for each start and length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return flat[at]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column whose value i is ``data[offsets[i]:offsets[i+1]]``; offsets count items of data."""
    off = (np.asarray(offsets, dtype=np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of undirected links by contraction.

    ``edges`` has long columns ``a`` and ``b``. Each round lets a node point at the least of
    itself and its neighbours, follows the pointers to their roots by pointer jumping and
    replaces nodes by roots, so at least half of the nodes that still have links go in each
    round. Only minima per node are gathered, never a node's neighbours.

    Returns ``node`` and ``component`` (the least node reachable) for every node in a link;
    null ends and self links add nothing. No links: no rows.
    """
    edges = checkpointed(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    done: list[DataFrame] = []
    left, steps = edges, [edges]
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        # a < b, so the higher end's least neighbour is a; a lower end points at itself unless it is a higher end elsewhere
        ends = left.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(left.select(F.col("a").alias("node"), F.col("a").alias("to")))
        up = point = checkpointed(ends.groupBy("node").agg(F.min("to").alias("to")))
        while True:
            hop = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            steps.append(point)
            jumped = checkpointed(point.join(hop, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            point = jumped
            if jumped.where("moved").isEmpty():
                break
        point = point.select("node", "to")
        done.append(point)
        # links that pointers follow are settled; without them a node that is the least neighbour of many has few left. Tables between the joins let Spark split what is still skewed
        pb = point.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        open_ = checkpointed(left.join(up.select(F.col("node").alias("b"), "to"), "b").where("a <> to").select("a", "b"))
        steps.append(open_)
        if open_.isEmpty():
            break
        ends = checkpointed(open_.join(pb, "b").select("a", "rb"))
        pa_ = point.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        steps.append(ends)
        left = checkpointed(ends.join(pa_, "a").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        steps.append(left)
    else:
        raise RuntimeError("components did not converge")
    if not done:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    discard(*steps)
    out = done[0]
    for point in done[1:]:
        then = point.select(F.col("node").alias("to"), F.col("to").alias("root"))
        out = out.join(then, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    return out.select("node", F.col("to").alias("component"))
