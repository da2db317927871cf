"""Near-duplicate vectors by int8 tile products with rigorous error bounds."""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, components, open_fs, shared_path, stored

BLOCK = 2048
PIVOTS = 64
STRIP = 256
SLACK = 1e-9  # over the rounding errors of the bounds themselves, which are in double precision


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, their scales, the norms of what the codes stand for and of what they miss."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    stands = codes * scale[:, None]
    return codes, scale, np.linalg.norm(stands, axis=1), np.linalg.norm(unit - stands, axis=1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 rows, exact: single-precision sums of up to 1000 of them stay below 2**24."""
    out = np.zeros((len(a), len(b)), np.float32 if a.shape[1] <= 1000 else np.float64)
    for k in range(0, a.shape[1], 1000):
        out += a[:, k : k + 1000].astype(np.float32) @ b[:, k : k + 1000].astype(np.float32).T
    return out


class Block:
    """Vectors of one block: ids, number of copies, and int8 codes with their bounds; unit vectors of single rows where they are asked for.

    It is two files: ``.codes`` has all but the unit vectors, an eighth of their size, and ``.rows`` these in double precision, one after another.
    """

    def __init__(self, ids: np.ndarray, copies: np.ndarray, codes: np.ndarray, scale: np.ndarray, norm: np.ndarray, error: np.ndarray, rows: np.ndarray | str):
        self.ids, self.copies, self.codes, self.scale, self.norm, self.error, self.rows = ids, copies, codes, scale, norm, error, rows

    @classmethod
    def of(cls, ids: np.ndarray, copies: np.ndarray, unit: np.ndarray) -> Block:
        return cls(ids, copies, *quantise(unit), unit)

    def write(self, path: str) -> None:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, copies=self.copies, codes=self.codes, scale=self.scale, norm=self.norm, error=self.error)
        for kind, data in (("codes", out.getvalue()), ("rows", self.rows.astype("<f8").tobytes())):
            fs, at = open_fs(f"{path}.{kind}")
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(at) as file:
                file.write(data)

    @classmethod
    def read(cls, path: str) -> Block:
        fs, at = open_fs(f"{path}.codes")
        with fs.open_input_file(at) as file:
            found = np.load(io.BytesIO(file.read()))
        return cls(*(found[k] for k in ("ids", "copies", "codes", "scale", "norm", "error")), path)

    def unit(self, wanted: np.ndarray) -> np.ndarray:
        """Unit vectors of the rows ``wanted``; only these are read, or all if they are many."""
        if isinstance(self.rows, str):
            own, place = np.unique(wanted, return_inverse=True)
            size = 8 * self.codes.shape[1]
            fs, at = open_fs(f"{self.rows}.rows")
            with fs.open_input_file(at) as file:
                if 4 * len(own) > len(self.ids):
                    self.rows = np.frombuffer(file.read(), "<f8").reshape(-1, self.codes.shape[1])
                else:
                    data = b"".join(file.read_at(size, int(i) * size) for i in own)
                    return np.frombuffer(data, "<f8").reshape(-1, self.codes.shape[1])[place]
        return self.rows[wanted]


def linked_pairs(a: Block, b: Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``a`` and ``b`` with cosine of at least ``threshold``, a strip of rows at a time.

    With ``same`` (``a`` is ``b``) each pair comes once. The product of two vectors differs from that of their codes by at most
    ``|e||y| + |x||f| + |e||f|`` (x, y: what the codes stand for; e, f: what they miss). Pairs beyond the
    threshold by more than that are decided; only those within it are computed in double precision.
    """
    reach = a.error.max() * b.norm.max() + a.norm.max() * b.error.max() + a.error.max() * b.error.max()
    least = (threshold - reach - SLACK) / (a.scale.max() * b.scale.max())
    if threshold - reach - SLACK <= 0:
        least = -math.inf
    for at in range(0, len(a.ids), STRIP):
        rows = slice(at, at + STRIP)
        products = exact_products(a.codes[rows], b.codes)
        i, j = np.nonzero(products >= least)
        if same:
            keep = i + at < j
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        value = products[i, j].astype(np.float64)
        i += at
        value *= a.scale[i] * b.scale[j]
        bound = a.error[i] * b.norm[j] + a.norm[i] * b.error[j] + a.error[i] * b.error[j] + SLACK
        linked = value - bound >= threshold
        open_ = np.flatnonzero(~linked & (value + bound >= threshold))
        for k in range(0, len(open_), 1 << 16):
            own = open_[k : k + (1 << 16)]
            linked[own] = np.einsum("ij,ij->i", a.unit(i[own]), b.unit(j[own])) >= threshold
        yield i[linked], j[linked]


def tile(a: Block, b: Block, threshold: float, same: bool) -> dict[str, np.ndarray]:
    """Of each vector with a link in this tile: its id, its linked vectors (copies counted), and the least id that links within the tile reach."""
    shift = 0 if same else len(a.ids)
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    copies = a.copies if same else np.concatenate([a.copies, b.copies])
    links = np.zeros(len(ids), np.int64)
    label = ids.copy()
    strips = []
    for i, j in linked_pairs(a, b, threshold, same):
        j = j + shift
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        strips.append((i, j))
    changed = bool(strips)
    while changed:
        before = label.copy()
        for i, j in strips:
            np.minimum.at(label, i, label[j])
            np.minimum.at(label, j, label[i])
        changed = not np.array_equal(before, label)
    own = np.flatnonzero(links)
    return {"vec_id": ids[own], "links": links[own], "to": label[own]}


def vector_links(vectors: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    All vectors of one dimension are compared. Equal vectors become one with a number of copies; the rest is dealt by the nearest of ``PIVOTS`` vectors
    and the angle to it into blocks of at most ``BLOCK``, written to the shared folder. A pair of blocks is a tile; tiles whose pivots or
    centres lie further apart than both radii and the threshold's angle are left out, which can't lose a link. A tile reads int8 codes, and full rows of open pairs only, and returns
    at most one row for each of its vectors. Vectors that are null, zero or have null or non-finite components link with
    nothing, as do those of different dimensions with each other; a row without an id also links with nothing. Repeated rows stay and count as other vectors. An empty table gives
    no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = bound_batches(vectors).select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    fit = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0) and vec_id is not null")
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    sound = rows.where("fit")
    classes = stored(sound.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "vectors")
    # a bounded set of pivots, the same for the same table; they only steer which vectors share a block
    pivots = [np.array(r["v"]) for r in classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("v").collect()]
    by_dimension = {d: np.array([p / np.linalg.norm(p) for p in pivots if len(p) == d]) for d in {len(p) for p in pivots}}

    def unit_of(v: pa.Array, dimension: int) -> np.ndarray:
        found = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
        found = found / np.abs(found).max(axis=1)[:, None]
        return found / np.linalg.norm(found, axis=1)[:, None]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch["v"]])
            for d in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                pivot, angle = np.zeros(len(part), np.int64), np.zeros(len(part))
                if d in by_dimension:
                    cosine = unit_of(part["v"], d) @ by_dimension[d].T
                    pivot = cosine.argmax(axis=1)
                    angle = np.arccos(np.clip(cosine.max(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([int(d)] * len(part), pa.int32()), pa.array(pivot), pa.array(angle)], names=[*part.schema.names, "dimension", "pivot", "angle"])

    base = shared_path(spark, "vector-blocks")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        dimension = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            while len(table) >= BLOCK or last and len(table):
                own, table = table.slice(0, BLOCK), table.slice(BLOCK)
                unit = unit_of(own["v"].combine_chunks(), dimension)
                path = f"{base}/{uuid.uuid4().hex}"
                Block.of(own["vec_id"].to_numpy(), own["copies"].to_numpy(), unit).write(path)
                centre = unit.sum(axis=0)
                norm = np.linalg.norm(centre)
                centre = centre / norm if norm > 1e-6 else unit[0]
                radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) + 1e-6
                pivot = own["pivot"][0].as_py()
                # how far the block reaches from the pivot of its first vector
                away = float(np.arccos(np.clip(unit @ by_dimension[dimension][pivot], -1, 1)).max()) + 1e-6 if dimension in by_dimension else math.pi
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([dimension], pa.int32()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius]), pa.array([pivot]), pa.array([away])], names=["path", "dimension", "centre", "radius", "pivot", "away"])
            held = table.to_batches()

        for batch in batches:
            sizes = batch["dimension"].to_numpy()
            for d in np.unique(sizes):
                if d != dimension and held:
                    yield from flush(True)
                dimension = int(d)
                held.append(batch.filter(pa.array(sizes == d)))
                if sum(map(len, held)) >= BLOCK:
                    yield from flush(False)
        if held:
            yield from flush(True)

    count = classes.count()
    placed = classes.mapInArrow(near, "v array<double>, vec_id long, copies long, dimension int, pivot long, angle double")
    parts = max(1, count // (4 * BLOCK))  # each gives full blocks but for its last
    dealt = placed.repartitionByRange(parts, "dimension", "pivot", "angle", "vec_id").sortWithinPartitions("dimension", "pivot", "angle", "vec_id").coalesce(parts)
    blocks = checkpointed(dealt.mapInArrow(build, "path string, dimension int, centre array<double>, radius double, pivot long, away double"))
    numbered = checkpointed(blocks.selectExpr("row_number() over (partition by dimension order by path) - 1 as n", "*"))
    # pairs of pivots whose blocks can hold a link: a row for two of them, so block pairs are made within these only
    reach = {(r["dimension"], r["pivot"]): r["away"] for r in numbered.groupBy("dimension", "pivot").agg(F.max("away").alias("away")).collect()}  # at most PIVOTS, and one for each dimension without
    widest = math.acos(threshold) + 1e-6
    pairs = [(d, p, q) for d, p in reach for e, q in reach if d == e and (d not in by_dimension or math.acos(max(-1.0, min(1.0, float(by_dimension[d][p] @ by_dimension[d][q])))) - reach[d, p] - reach[d, q] <= widest)]
    near_pivots = spark.createDataFrame(pairs, "dimension int, pivot long, beside long")
    left = numbered.join(F.broadcast(near_pivots), ["dimension", "pivot"])  # at most PIVOTS squared
    right = numbered.select("dimension", F.col("n").alias("m"), F.col("path").alias("other"), F.col("centre").alias("c"), F.col("radius").alias("r"), F.col("pivot").alias("beside"))
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.expr("aggregate(zip_with(centre, c, (x, y) -> x * y), double(0), (s, x) -> s + x)"))))
    tiles = checkpointed(left.join(right, ["dimension", "beside"]).where("n <= m").where((F.col("n") == F.col("m")) | (apart - F.col("radius") - F.col("r") <= widest)).select("path", "other"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, a = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, a = row["path"], Block.read(row["path"])
                same = row["other"] == path
                found = tile(a, a if same else Block.read(row["other"]), threshold, same)
                yield pa.RecordBatch.from_pydict({k: pa.array(x, pa.int64()) for k, x in found.items()})

    found = stored(tiles.repartition(max(1, tiles.count() // 4)).mapInArrow(solve, "vec_id long, links long, to long"), "vector-links")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("to").alias("b")))
    known = classes.join(links, "vec_id", "left").join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = sound.join(known, "v").select("vec_id", "n_links", "component_id")
    lone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
