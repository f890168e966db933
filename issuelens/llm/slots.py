"""Documents in slots, and fingerprints that meet.

A slot is a few megabytes of neighbouring documents, stored together. What a
slot knows of a fingerprint, however often it holds it, is one entry, so a
fingerprint that a third of all documents hold makes no more entries than there
are slots: that is the pre-aggregation before the shuffle. Entries travel as
packed arrays to buckets of the fingerprint space (``ask``), are matched there
(``meet``), and each slot gets back what concerns it, to be read beside its own
documents (``cogroup``). A bucket and a slot are bounded in size; their number
grows with the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm.bytetext import mixed
from issuelens.llm.deploy import deployed
from issuelens.session import scratch_path

SLOT_BYTES = 6 << 20
#: Bytes of text whose fingerprints share a bucket.
BUCKET_BYTES = 4 << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written once to the shared folder, dealt by ``key``, and read back.

    Later groupings by ``key`` read their rows in place, without a shuffle. The
    table is external, so dropping it from the catalogue keeps its files; the
    folder is under ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("path", scratch_path(spark, name)).option("compression", "zstd")
     .bucketBy(partitions(spark), key).saveAsTable(table))
    return spark.table(table)


def in_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             carry: Sequence[str] = (), slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """(slot, row, doc_id, text) of every row, and the columns ``carry`` as carry_<name>.

    ``row`` is unique; a null text is kept. A text longer than a slot makes a
    slot of its own.
    """
    deployed(docs.sparkSession)
    source = docs.select(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"),
                         F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         *[F.col(c).alias(f"carry_{c}") for c in carry])
    schema = T.StructType([T.StructField("slot", T.LongType()), T.StructField("row", T.LongType()),
                           *source.schema.fields[1:]])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        slot, row, held = first, first, 0
        for batch in batches:
            sizes = np.cumsum(batch.column(0).to_numpy())
            at, done = 0, 0
            while at < len(batch):
                end = int(np.searchsorted(sizes, done + slot_bytes - held, side="right"))
                if end <= at and held:
                    slot, held = slot + 1, 0
                    continue
                end = max(end, at + 1)
                own = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(end - at, slot)), pa.array(np.arange(row, row + end - at)),
                    *own.columns[1:]], names=names)
                held += int(sizes[end - 1]) - done
                row, done, at = row + end - at, int(sizes[end - 1]), end

    return bucketed(source.mapInArrow(run, schema), "slot", "slots")


def bucket_count(slotted: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of the fingerprint space, in proportion to the text."""
    spark = slotted.sparkSession
    size = slotted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * partitions(spark), -(-size // bucket_bytes))


def entries_schema(fields: dict[str, str]) -> str:
    return "bucket int, slot long, " + ", ".join(f"{name} binary" for name in fields)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    # mixed anew, since selected fingerprints are the least of many and so small
    return ((mixed(key) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def dealt_order(key: np.ndarray, buckets: int) -> np.ndarray:
    """The order in which ``dealt`` packs entries."""
    return np.argsort(bucket_of(key, buckets), kind="stable")


def dealt(slot: int, key: np.ndarray, fields: dict[str, np.ndarray], buckets: int) -> pa.Table:
    """Entries as one row per bucket, which ``key`` (uint64) chooses."""
    order = dealt_order(key, buckets)
    bucket = bucket_of(key, buckets)[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    columns = [pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(len(starts), slot, np.int64))]
    for values in fields.values():
        values = values[order]
        ends = np.append(starts, len(values)) * values.itemsize
        columns.append(pa.Array.from_buffers(pa.binary(), len(starts), [
            None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]))
    return pa.table(columns, names=["bucket", "slot", *fields])


def gathered(table: pa.Table, fields: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Slot of every entry, and the entries' fields, of a group's rows."""
    out, counts = {}, None
    for name, kind in fields.items():
        packed = table.column(name).combine_chunks()
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
        size = np.dtype(kind).itemsize
        data = packed.buffers()[2]
        out[name] = (np.frombuffer(data, kind, (ends[-1] - ends[0]) // size, ends[0])
                     if len(packed) and ends[-1] > ends[0] else np.zeros(0, kind))
        counts = np.diff(ends) // size
    return np.repeat(table.column("slot").to_numpy(), counts), out


def by_slot(slot: np.ndarray, fields: dict[str, np.ndarray]) -> pa.Table:
    """Answers as one row per slot."""
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    starts = np.flatnonzero(np.diff(slot, prepend=-1))
    columns = [pa.array(slot[starts])]
    for values in fields.values():
        values = values[order]
        ends = np.append(starts, len(values)) * values.itemsize
        columns.append(pa.Array.from_buffers(pa.binary(), len(starts), [
            None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]))
    return pa.table(columns, names=["slot", *fields])


def answer_schema(fields: dict[str, str]) -> str:
    return "slot long, " + ", ".join(f"{name} binary" for name in fields)


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): positions sorted by the keys, and where each group begins."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys:
        own = key[order]
        new[1:] |= own[1:] != own[:-1]
    return order, np.flatnonzero(new)


def sizes_of(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


class Members:
    """Membership in a sorted array of 64-bit values, by a bit table first."""

    def __init__(self, known: np.ndarray):
        self.known = np.sort(known)
        bits = min(26, max(12, int(len(known)).bit_length() + 4))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.known & self.mask] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the values that are known, and their places among the known."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[values & self.mask])
        place = np.searchsorted(self.known, values[at])
        place[place == len(self.known)] = 0
        hit = self.known[place] == values[at]
        return at[hit], place[hit]


def lookup(keys: np.ndarray, checks: np.ndarray, known: np.ndarray,
           known_checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the (key, check) pairs that are known, and their places among the known."""
    order = np.lexsort((known_checks, known))
    members = Members(known)
    at, place = members.find(keys)
    checks, known_checks = checks[at], known_checks[order]
    while True:
        # keys that share their 64 bits stand in a row; step through them
        wrong = np.flatnonzero(known_checks[place] < checks)
        wrong = wrong[place[wrong] + 1 < len(known)]
        wrong = wrong[members.known[place[wrong] + 1] == members.known[place[wrong]]]
        if not len(wrong):
            break
        place[wrong] += 1
    hit = known_checks[place] == checks
    return at[hit], order[place[hit]]


def per_slot(slotted: DataFrame, schema: str, run: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    """``run(slot, documents)`` over every slot."""
    return slotted.groupBy("slot").applyInArrow(
        lambda documents: run(documents.column("slot")[0].as_py(), documents), schema)


def with_answers(slotted: DataFrame, answers: DataFrame, schema: str,
                 run: Callable[[int, pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """``run(slot, documents, answers)`` over every slot, also those without answers."""
    def own(documents: pa.Table, found: pa.Table) -> pa.Table:
        return run(documents.column("slot")[0].as_py(), documents, found)

    return slotted.groupBy("slot").cogroup(answers.groupBy("slot")).applyInArrow(own, schema)
