"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated onto the principal axes of a bounded sample and split
into blocks. Vectors with a cosine of at least ``threshold`` have a squared
distance of at most ``2 - 2 threshold``; each block gets a share of that budget
in proportion to its variance, and at least one block of a linked pair stays
within its share. So each block is a range join: vectors are dealt into slabs
of the block's leading axis and packed into chunks, chunks that come within the
block's radius meet, and pairs within it are candidates. Each candidate is
verified exactly, in double precision, and counted in the first block that
finds it, so no pair is written or counted twice.

Chunks meet by replication: a task reads the two it compares from where they are
stored, so no vector is copied into a shuffle, and disk holds the distinct
vectors and the chunks of one round of blocks, whatever the number of tiles.
Equal vectors are one class; a class's copies count as its links. A chunk has a
bounded number of vectors. Two chunks are verified and counted in parts of
bounded size; they return the number of links per vector and one edge per vector
to its group, never pairs.

Vectors that are null, zero, of another length than most, or that hold null or
non-finite components link with nothing; so do rows with a null id, whose
component is null. Different vectors under one id share their links and their
component. An empty table gives an empty result. Only the id and vector columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm.bytetext import mixed
from issuelens.llm.components import components
from issuelens.llm.deploy import deployed
from issuelens.llm.minhash_dedup import Groups
from issuelens.session import discard, scratch_path, settings, staged, staged_at

THRESHOLD = 0.9
BLOCKS = 8
#: Rows whose covariance gives the rotation, and rows of a side of a tile.
SAMPLE, TILE = 4096, 8192
#: Chunks that a block has at least, as long as each has so many rows.
CHUNKS, FEW = 32, 2048
#: Bytes of the chunks stored at once, if one block has fewer, and of those that a task holds.
ROUND_BYTES, TASK_BYTES = 256 << 20, 16 << 20
STRIP = 512
#: Cells of a strip looked through at once, and candidates verified at once.
CELLS, PART = 1 << 20, 16_384
SLACK = 1e-9


def usable(vector: str, dimensions: Column | int) -> Column:
    """Whether the array is of that length, all finite, and not zero."""
    big = F.lit(float("inf"))
    return F.coalesce(
        (F.size(vector) == dimensions)
        & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (x < big) & (x > -big), F.lit(False)))
        & F.exists(vector, lambda x: x != 0), F.lit(False))


def most_common_length(vectors: DataFrame, column: str) -> int:
    counted = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count()
    top = counted.orderBy(F.desc("count"), "n").limit(1).collect()
    return top[0]["n"] if top else 0


class Subspaces:
    """Rotation, block bounds and budgets."""

    def __init__(self, sample: np.ndarray, dimensions: int, threshold: float, blocks: int):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        variance, axes = np.linalg.eigh(unit.T @ unit / max(1, len(unit)))
        self.rotation = axes[:, ::-1].copy()
        variance = np.maximum(variance[::-1], 0) + 1e-6
        self.bounds = np.linspace(0, dimensions, min(blocks, dimensions) + 1).astype(int)
        share = np.add.reduceat(variance, self.bounds[:-1])
        share = np.maximum(share / share.sum(), 0.1 / len(share))
        self.budgets = (2 - 2 * threshold) * share / share.sum() + SLACK
        self.radii = np.sqrt(self.budgets)
        self.threshold = threshold

    def rotated(self, vectors: np.ndarray, axes: Sequence[int] | slice = slice(None)) -> np.ndarray:
        """Unit vectors on the wanted axes; a vector's digits do not depend on the others beside it."""
        vectors = np.ascontiguousarray(vectors, float)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        rotation = self.rotation[:, axes]
        out = np.zeros((len(unit), rotation.shape[1]))
        for k in range(len(rotation)):
            out += unit[:, k, None] * rotation[k]
        return out

    def links(self, x: np.ndarray, y: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked (i, j) that ``block`` is the first to find, in parts of at most ``PART``.

        Both sides are looked through along the one of the block's first two axes on which x spreads wider.
        """
        low, high = self.bounds[block], self.bounds[block + 1]
        if not len(x) or not len(y):
            return
        budget = self.budgets[block]
        axis = max(range(low, min(low + 2, high)), key=lambda a: np.ptp(x[:, a]))
        # what lies between the sides on the other axes is spent
        apart = np.maximum(0, np.maximum(y.min(0) - x.max(0), x.min(0) - y.max(0)))[low:high]
        apart[axis - low] = 0
        radius = np.sqrt(max(0.0, budget - (apart * apart).sum())) + SLACK
        if (apart * apart).sum() > budget:
            return
        x_order, y_order = np.argsort(x[:, axis], kind="stable"), np.argsort(y[:, axis], kind="stable")
        x_at, y_at = x[x_order, axis], y[y_order, axis]
        left, right = x[x_order].astype(np.float32), y[y_order].astype(np.float32)
        near_x, near_y = left[:, low:high], right[:, low:high]
        # one product gives the squared distance in the block less its budget
        own = (near_x * near_x).sum(1, keepdims=True) - np.float32(budget + 1e-5)
        other = (near_y * near_y).sum(1, keepdims=True)
        near_x = np.hstack([-2 * near_x, own, np.ones_like(own)])
        near_y = np.hstack([near_y, np.ones_like(other), other])
        width = max(1, CELLS // STRIP)
        for at in range(0, len(x), STRIP):
            end = min(at + STRIP, len(x))
            first = np.searchsorted(y_at, x_at[at] - radius, side="left")
            last = np.searchsorted(y_at, x_at[end - 1] + radius, side="right")
            for begin in range(first, last, width):
                close = (near_x[at:end] @ near_y[begin:min(begin + width, last)].T) <= 0
                candidates = np.flatnonzero(close)
                for part in range(0, len(candidates), PART):
                    i, j = np.divmod(candidates[part:part + PART], close.shape[1])
                    i, j = i + at, j + begin
                    likely = np.einsum("ij,ij->i", left[i], right[j]) >= self.threshold - 1e-4
                    i, j = x_order[i[likely]], y_order[j[likely]]
                    a, b = x[i], y[j]
                    apart = np.add.reduceat((a - b) ** 2, self.bounds[:-1], axis=1) <= self.budgets
                    mine = apart[:, block] & ~apart[:, :block].any(1)
                    linked = mine & ((a * b).sum(1) >= self.threshold)
                    if linked.any():
                        yield i[linked], j[linked]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    packed = column.combine_chunks()
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2], np.float64, (ends[-1] - ends[0]) // 8, ends[0])
    return data.reshape(len(packed), -1)


def _tile(table: pa.Table, spaces: Subspaces) -> pa.Table:
    """Links of a tile: (id, links) with edge null, and (id, edge)."""
    block = table.column("block")[0].as_py()
    home = table.column("home").to_numpy(zero_copy_only=False)
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    vectors = _matrix(table.column("vector"))
    sides = [(ids[own], n[own], vectors[own]) for own in (home, ~home)]
    return _counted(spaces, block, *sides)


def _counted(spaces: Subspaces, block: int, home: tuple, other: tuple) -> pa.Table:
    """Links between two sides, (ids, copies, rotated vectors) each, as ``_tile`` returns them."""
    axis = int(spaces.bounds[block])
    ids, n = (np.concatenate([home[k], other[k]]) for k in range(2))
    names, place = np.unique(ids, return_inverse=True)
    counts = np.zeros(len(names), np.int64)
    groups, labels, joined = None, np.arange(len(names)), 0
    mine, theirs = home[2], other[2]
    for i, j in spaces.links(mine, theirs, block):
        here, there = mine[i, axis], theirs[j, axis]
        a, b = i, j + len(mine)
        # of a pair at one place on the axis the lesser id is home
        first = (here < there) | ((here == there) & (ids[a] < ids[b]))
        a, b = a[first], b[first]
        np.add.at(counts, place[a], n[b])
        np.add.at(counts, place[b], n[a])
        groups = groups or Groups(len(names))
        # labels may lag behind the groups, but what they have in common is joined
        p, q = labels[place[a]], labels[place[b]]
        pairs = np.unique(p[p != q] * len(names) + q[p != q])
        for pair in pairs.tolist():
            groups.join(*divmod(pair, len(names)))
        joined += len(pairs)
        if joined >= len(names):
            labels, joined = groups.labels(), 0
    linked = np.flatnonzero(counts)
    named, counts = names[linked], counts[linked]
    leads = names[groups.labels()[linked]] if groups else named
    hung = named != leads
    return pa.table([
        pa.array(np.concatenate([named, named[hung]])),
        pa.array(np.concatenate([counts, np.zeros(hung.sum(), np.int64)])),
        pa.concat_arrays([pa.nulls(len(named), pa.int64()), pa.array(leads[hung], pa.int64())])],
        names=["id", "links", "edge"])


class Slabs:
    """Slabs of a block's leading axis that hold about as many vectors each, by the sample.

    One that many vectors share a place in is dealt into parts by id.
    """

    def __init__(self, places: np.ndarray, wanted: int):
        cuts = np.quantile(places, np.arange(1, wanted) / wanted) if len(places) else np.zeros(0)
        self.cuts = np.unique(cuts)
        held = np.bincount(np.searchsorted(self.cuts, places, side="right"), minlength=len(self.cuts) + 1)
        self.parts = np.maximum(1, np.round(held * wanted / max(1, len(places))).astype(np.int64))

    def of(self, places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slab = np.searchsorted(self.cuts, places, side="right")
        return slab, (mixed(ids.view(np.uint64)) % self.parts[slab].astype(np.uint64)).astype(np.int64)


CHUNK = "block int, slab int, low double, high double, ids binary, copies binary, vectors binary"


def _chunks(table: pa.Table, spaces: Subspaces, kind: str, size: int) -> pa.Table:
    """The vectors of a slab, rotated and packed in the order of the axis, at most ``size`` in a row."""
    block, slab = table.column("block")[0].as_py(), table.column("slab")[0].as_py()
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    raw = np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(len(ids), -1)
    turned = spaces.rotated(raw)
    axis = int(spaces.bounds[block])
    order = np.lexsort((ids, turned[:, axis]))
    out = []
    for own in np.array_split(order, -(-len(order) // size)):
        out.append((block, slab, turned[own[0], axis], turned[own[-1], axis], ids[own].tobytes(), n[own].tobytes(),
                    turned[own].tobytes()))
    names = [field.split()[0] for field in CHUNK.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(values, kind) for values, kind in zip(zip(*out), kinds)], names=names)


def _found(classes: DataFrame, spaces: Subspaces, blocks: Sequence[int], slabs: dict[int, Slabs], size: int,
           tasks: int) -> DataFrame:
    """(id, links, edge) of what these blocks find first; their chunks are stored meanwhile."""
    spark = classes.sparkSession
    kind = "<f4" if isinstance(classes.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    axes = [int(spaces.bounds[b]) for b in blocks]

    def deal(batches):
        for batch in filter(len, batches):
            rows = np.ascontiguousarray(batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1), kind)
            ids, width = batch.column(1).to_numpy(), rows.shape[1] * rows.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [
                None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])
            for block, places in zip(blocks, spaces.rotated(rows, axes).T):
                slab, part = slabs[block].of(places, ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), block, np.int32)), pa.array(slab.astype(np.int32)),
                    pa.array(part.astype(np.int32)), batch.column(1), batch.column(2), packed],
                    names=["block", "slab", "part", "id", "n", "vector"])

    def side(batch: pa.RecordBatch, name: str) -> tuple:
        held = [batch.column(f"{name}_{c}")[0].as_buffer() for c in ("ids", "copies", "vectors")]
        ids, n = (np.frombuffer(h, "<i8") for h in held[:2])
        return ids, n, np.frombuffer(held[2], "<f8").reshape(len(ids), -1)

    def meet(batches):
        for batch in batches:
            for row in range(len(batch)):
                own = batch.slice(row, 1)
                found = _counted(spaces, own.column("home_block")[0].as_py(), side(own, "home"), side(own, "other"))
                yield from found.to_batches()

    dealt = classes.select("v", "id", "n").mapInArrow(
        deal, "block int, slab int, part int, id long, n long, vector binary")
    path = scratch_path(spark, "chunks")
    chunks = staged_at(dealt.groupBy("block", "slab", "part").applyInArrow(
        lambda t: _chunks(t, spaces, kind, size), CHUNK), path)
    # rows are chunks of megabytes
    with settings(spark, {"spark.sql.parquet.columnarReaderBatchSize": "4",
                          "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):
        radius = F.element_at(F.array(*[F.lit(float(r) * (1 + 1e-6)) for r in spaces.radii]), F.col("home_block") + 1)
        home, other = (chunks.coalesce(tasks).select([F.col(c).alias(f"{name}_{c}") for c in chunks.columns])
                       for name in ("home", "other"))
        pairs = home.hint("shuffle_replicate_nl").join(other, (
            (F.col("home_block") == F.col("other_block")) & (F.col("home_slab") <= F.col("other_slab"))
            & (F.col("home_low") <= F.col("other_high")) & (F.col("other_low") <= F.col("home_high") + radius)))
        found = staged(pairs.mapInArrow(meet, "id long, links long, edge long"), "found")
    discard(spark, path)
    return found


def linked(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    deployed(vectors.sparkSession)
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                            F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    dimensions = most_common_length(source, "v")
    able = F.col("vec_id").isNotNull() & usable("v", dimensions)
    classes = source.where(able).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = staged(classes, "classes")
    amount = classes.count()
    share = min(1.0, SAMPLE / max(1, amount))
    drawn = classes.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * SAMPLE)
    sample = np.array([r["v"] for r in drawn.orderBy("id").collect()], float).reshape(-1, max(1, dimensions))
    spaces = Subspaces(sample, max(1, dimensions), threshold, blocks)
    size = min(TILE, max(FEW, amount // CHUNKS))
    axes = spaces.bounds[:-1].tolist()
    slabs = {b: Slabs(places, max(1, -(-amount // size))) for b, places in enumerate(spaces.rotated(sample, axes).T)}
    stored = max(1, amount) * 8 * (spaces.bounds[-1] + 2)
    at_once = int(max(1, ROUND_BYTES // stored))
    found = None
    for first in range(0, len(axes), at_once):
        some = list(range(first, min(first + at_once, len(axes))))
        more = _found(classes, spaces, some, slabs, size, int(max(8, -(-stored * len(some) // TASK_BYTES))))
        found = more if found is None else found.union(more)
    counts = found.where("edge IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    named = components(found.where("edge IS NOT NULL").select(F.col("id").alias("a"), F.col("edge").alias("b")))
    per_class = classes.join(counts, "id", "left").join(
        named.withColumnRenamed("id", "named"), F.col("id") == F.col("named"), "left").select(
        F.col("v").alias("same"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    # rows that link with nothing have no class; the rest meet theirs by the vector
    keyed = source.withColumn("v", F.when(able, F.col("v")))
    out = keyed.join(per_class, F.col("v") == F.col("same"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
