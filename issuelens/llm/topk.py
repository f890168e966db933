"""Exact top-k by integer inner product, over a pivot-distance index.

Components are turned into integers. Vectors get one more component, so that
all have the same norm; the greatest inner product is then the least distance.
Every vector is keyed by its nearest pivot and the annulus around it in which
its distance falls. A query knows from its own distance to a pivot how near an
annulus can come (triangle inequality): it first visits its most promising
annulus, and then, with the k-th score found so far, those that can still hold
a better one. Pivots come from a bounded sample; every vector is indexed, and
the result is exact whatever the sample.

Equal vectors are one entry with its least ids (one more than k, so that a
query finds k besides itself) and how often each occurs; equal queries are
searched once. Cuts keep rows until k are left without the rows of any one id,
and of no id more than k, so 2k at most. Annuli and their queries are dealt
into tiles of bounded size.

Vectors that are null, of another length than most, or that hold null or
non-finite components take no part, nor do rows with a null id. A row that is
repeated counts as often as it occurs among the candidates, and asks once; an
id with several vectors asks with each. Rows with a query's own id are not its
candidates, and take no candidate's place. An empty table gives an empty
result. Only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.deploy import deployed
from issuelens.llm.embedding_dedup import most_common_length
from issuelens.session import staged

K, SCALE, EVERY = 20, 64, 20
SAMPLE, ANNULI, TILE = 4096, 8, 8192
#: Vectors per pivot aimed at; the number of pivots stays between these.
PER_PIVOT, PIVOTS = 16_384, (4, 256)


def whole(column: str, scale: int = SCALE):
    """Components times ``scale``, rounded down."""
    return F.transform(column, lambda x: F.floor(x * scale))


def _finite(column: str, dimensions: int):
    big = F.lit(float("inf"))
    return F.coalesce((F.size(column) == dimensions) & F.forall(column, lambda x: F.coalesce(
        ~F.isnan(x) & (x < big) & (x > -big), F.lit(False))), F.lit(False))


class Index:
    """Pivots in the space of equal norms, and annulus widths."""

    def __init__(self, sample: np.ndarray, norm: float, amount: int):
        self.norm = norm
        n = int(np.clip(amount // PER_PIVOT, *PIVOTS))
        chosen = np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int) if len(sample) else []
        self.pivots = self.lifted(sample[chosen]) if len(sample) else np.zeros((1, sample.shape[1] + 1))
        # no two points of the sphere are further apart
        self.width = max(2 * np.sqrt(norm), 1e-9) / ANNULI / 2

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm - (x * x).sum(1), 0))
        return np.hstack([x, rest[:, None]])

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = ((points * points).sum(1)[:, None] + (self.pivots**2).sum(1)[None, :]
                   - 2 * points @ self.pivots.T)
        return np.sqrt(np.maximum(squares, 0))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell of every vector: its nearest pivot and annulus."""
        apart = self.distances(self.lifted(x))
        pivot = apart.argmin(1)
        annulus = np.minimum(apart[np.arange(len(x)), pivot] // self.width, 2 * ANNULI - 1).astype(int)
        return pivot * 2 * ANNULI + annulus

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Per query and cell, a score that no vector of the cell exceeds."""
        lifted = np.hstack([q, np.zeros((len(q), 1))])
        apart = self.distances(lifted)[:, :, None]
        inner = np.arange(2 * ANNULI) * self.width
        outer = inner + self.width
        outer[-1] = np.inf
        gap = np.maximum(np.maximum(inner - apart, apart - outer), 0)
        own = (q * q).sum(1)[:, None, None]
        best = (own + self.norm - gap**2) / 2
        # rounding of distances, in units of the squares involved
        return (best + 1e-6 * (own + self.norm) + 1).reshape(len(q), -1)


def _vectors(column) -> np.ndarray:
    packed = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
    if not len(packed) or ends[-1] == ends[0]:
        return np.zeros((len(packed), 0), np.int64)
    return np.frombuffer(packed.buffers()[2], "<i8", (ends[-1] - ends[0]) // 8, ends[0]).reshape(len(packed), -1)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point only where that is exact."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


def _enough(vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The best rows in order, until k are left without those of any one id."""
    order = np.lexsort((vec, -score))
    by_id = np.argsort(vec[order], kind="stable")
    ids = vec[order][by_id]
    number = np.empty(len(order), np.int64)
    number[by_id] = 1 + np.arange(len(ids)) - np.searchsorted(ids, ids)
    order, number = order[number <= k], number[number <= k]
    return order[1 + np.arange(len(order)) - np.maximum.accumulate(number) <= k]


def _visited(queries: pa.Table, entries: pa.Table, k: int) -> pa.Table:
    """Each query's best rows of a tile: (query, vec_id, score)."""
    out = []
    if len(queries) and len(entries):
        ids = entries.column("ids").combine_chunks()
        ends = ids.offsets.to_numpy()
        flat = ids.values.to_numpy()
        least = flat[ends[:-1]]
        order = np.argsort(least, kind="stable")
        least = least[order]
        x, q = _vectors(entries.column("vector"))[order], _vectors(queries.column("vector"))
        names = queries.column("entry").to_numpy()
        for at in range(0, len(q), 256):
            block = scores(q[at:at + 256], x)
            for name, row in zip(names[at:at + 256], block):
                near, n = np.arange(len(row)), k + 1
                while len(row) > n:
                    limit = np.partition(row, len(row) - n)[len(row) - n]
                    near = np.flatnonzero(row >= limit)
                    near = near[np.argsort(-row[near], kind="stable")][:n]
                    most = np.unique(least[near], return_counts=True)[1].max()
                    if n - most >= k:
                        break
                    near, n = np.arange(len(row)), 2 * n
                own = order[near]
                sizes = ends[own + 1] - ends[own]
                vec = np.concatenate([flat[ends[i]:ends[i + 1]] for i in own])
                score = np.repeat(row[near], sizes)
                best = _enough(vec, score, k)
                out.append((np.full(len(best), name), vec[best], score[best]))
    parts = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
    return pa.table([pa.array(p) for p in parts], names=["query", "vec_id", "score"])


def _visit(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows per query over the cells that each query names; queries are
    (entry, vector, cells), entries (entry, ids, vector, cell)."""
    asked = queries.select("entry", "vector", F.explode("cells").alias("cell"))
    tiles = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    # one row per cell, of which there are at most pivots * annuli
    plan = F.broadcast(staged(tiles(asked, "q").join(tiles(entries, "x"), "cell"), "cells"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("entry"), F.col(n)).cast("int")
    left = asked.join(plan, "cell").select("cell", "entry", "vector", part("q").alias("i"), upto("x").alias("j"))
    right = entries.join(plan, "cell").select(
        "cell", "entry", "ids", "vector", upto("q").alias("i"), part("x").alias("j"))
    key = ["cell", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        lambda a, b: _visited(a, b, k), "query long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best rows per query until ``k`` are left without those of any one id; at the last, ``others`` is k."""
    alike = Window.partitionBy("query", "vec_id").orderBy(F.desc("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "number")
    numbered = found.repartition("query").withColumn("number", F.row_number().over(alike)).where(F.col("number") <= k)
    return numbered.withColumn("others", F.row_number().over(order) - F.max("number").over(
        order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("others") <= k).drop("number")


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``."""
    deployed(vectors.sparkSession)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                            F.col(vector_col).cast("array<double>").alias("v"))
    dimensions = most_common_length(source, "v")
    rows = source.where(F.col("vec_id").isNotNull() & _finite("v", dimensions)).select(
        "vec_id", whole("v", scale).alias("v"))
    is_query = F.col("vec_id") % every == 0
    # of equal vectors the k + 1 least ids are enough for any query, and k occurrences of each
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    times = F.least(F.count("*"), F.lit(k)).cast("int")
    least = rows.groupBy("v", "vec_id").agg(times.alias("times")).withColumn("place", place).where(
        F.col("place") <= k + 1).groupBy("v").agg(F.flatten(F.transform(
            F.sort_array(F.collect_list(F.struct("vec_id", "times"))),
            lambda x: F.array_repeat(x["vec_id"], x["times"]))).alias("ids"))
    asking = rows.where(is_query).groupBy("v").agg(F.min("vec_id").alias("asker"))
    # an id can be the least of several vectors, so entries are numbered
    entries = staged(least.join(asking, "v", "left").select(
        "v", "ids", "asker", F.monotonically_increasing_id().alias("entry")), "entries")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    facts = entries.agg(F.count("*").alias("n"), F.max(square).alias("norm")).first()
    share = min(1.0, SAMPLE / max(1, facts["n"]))
    drawn = entries.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * SAMPLE)
    sample = np.array([r["v"] for r in drawn.select("v").orderBy("v").collect()], np.int64).reshape(
        -1, max(1, dimensions))
    index = Index(sample.astype(float), float(facts["norm"] or 0.0), facts["n"])

    def keyed(batches):
        for batch in filter(len, batches):
            values = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            cells = index.cells(values.astype(float))
            width = values.shape[1] * 8
            yield pa.RecordBatch.from_arrays([
                *batch.columns[1:], pa.Array.from_buffers(pa.binary(), batch.num_rows, [
                    None, pa.py_buffer((np.arange(batch.num_rows + 1) * width).astype(np.int32)),
                    pa.py_buffer(np.ascontiguousarray(values, "<i8"))]),
                pa.array(cells.astype(np.int32))], names=["ids", "asker", "entry", "vector", "cell"])

    indexed = staged(entries.select("v", "ids", "asker", "entry").mapInArrow(
        keyed, "ids array<long>, asker long, entry long, vector binary, cell int"), "index")
    numbered, entries = entries, indexed.select("entry", "ids", "vector", "cell")
    queries = indexed.where("asker IS NOT NULL").select("entry", "vector")

    def promising(batches):
        """The cell with the greatest bound, of those that hold sampled vectors."""
        held = np.unique(index.cells(sample.astype(float))) if len(sample) else np.zeros(0, int)
        for batch in filter(len, batches):
            bounds = index.bounds(_vectors(batch.column(1)).astype(float))
            best = held[bounds[:, held].argmax(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(
                [[int(c)] for c in best], pa.list_(pa.int32()))], names=["entry", "vector", "cells"])

    schema = "entry long, vector binary, cells array<int>"
    first = staged(queries.mapInArrow(promising, schema), "asked")
    seen = staged(_best(_visit(first, entries, k), k), "seen")
    reached = seen.where(F.col("others") == k).groupBy(F.col("query").alias("named")).agg(
        F.max("score").alias("limit"))

    def remaining(batches):
        """All other cells that can hold as good a score as the worst one kept so far."""
        for batch in filter(len, batches):
            bounds = index.bounds(_vectors(batch.column(1)).astype(float))
            limit = batch.column(3).fill_null(np.iinfo(np.int64).min).to_numpy().astype(float)
            done = np.array([c[0] for c in batch.column(2).to_pylist()])
            open_ = bounds >= limit[:, None]
            open_[np.arange(len(done)), done] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
                [np.flatnonzero(row).astype(np.int32) for row in open_], pa.list_(pa.int32()))],
                names=["entry", "vector", "cells"])

    again = first.join(reached, F.col("entry") == F.col("named"), "left").select(
        "entry", "vector", "cells", "limit").mapInArrow(remaining, schema)
    more = _visit(staged(again, "asked"), entries, k)
    best = _best(seen.drop("others").union(more), k).drop("others")
    # every query id gets the result of its vector, without itself
    askers = rows.where(is_query).join(
        numbered.select("v", F.col("entry").alias("query")), "v").select("vec_id", "query").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.join(askers.withColumnRenamed("vec_id", "query_id"), "query").where(
        "vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
