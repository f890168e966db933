"""Ranked lexical search of many items at once, by shared partial scores.

The score of a document for an item is a sum over the item's terms, so what
several items have in common is summed once per document:

* Items are taken in blocks of bounded text; each block is one pass over the
  documents. A block is mined for the term sets that its items share: an item
  is the sequence of its terms, those in most items first; two neighbours that
  stand together in at least two items become one new symbol, the most common
  pair first, until no pair repeats. A symbol is a set of terms, and the symbols
  form a graph without cycles whose inner nodes have two parts each.
* Documents are reduced to their postings in the block's vocabulary, written
  once: number of terms, and the occurrences of each known term.
* A task holds a batch of documents as one row of partial scores per symbol,
  filled in the order of the graph: leaves from the postings, each shared set
  once from its two parts, and items at last from the symbols left in them.
* Every task keeps the best of each item; a ranking joins the tasks' rows.

A term is a maximal run of ASCII letters and digits and of characters beyond
ASCII, A to Z lower-cased. N counts the documents with a term, L their terms, n
a document's terms, df the documents that hold a term, tf its occurrences. With
w = floor(1000 ln((2N + 2) / (2df + 1))) and m = 25 + (75 n N) div L, a document
scores the sum of w ((10^9 tf) div (1000 tf + 8 m)) over an item's terms,
repeats included, in 64-bit integers.

Defined results: a null or empty text has no term; such a document is never
found, such an item finds nothing and has no row. Documents with a score of 0
are left out. Ties go to the smaller id; a null id comes last. Rows of
documents with one id are documents of their own. Items with equal texts get
equal results under their own ids, a repeated item as often as it stands there.
An empty table gives an empty result; other columns play no part. Long texts
are read whole, a piece between two separators at a time.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm import slots
from issuelens.llm.deploy import deployed
from issuelens.session import staged

TOP = 10
#: Text of the items in a block, and of the longest piece that is split into words at once.
BLOCK_BYTES, PIECE_BYTES = 256 << 10, 1 << 20
#: Bytes of partial scores that a task holds, and documents in them.
HELD_BYTES, HELD_DOCS = 48 << 20, 4096
LAST = np.iinfo(np.int64).max

#: Bytes of terms, lower-cased, and a space for every other one.
TERM_BYTES = bytes(
    b + 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))


def term_pieces(text: bytes, table: bytes = TERM_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of bounded size."""
    plain = text.translate(table)
    at = 0
    while len(plain) - at > PIECE_BYTES:
        end = plain.find(b" ", at + PIECE_BYTES)
        if end < 0:
            break
        yield plain[at:end].split()
        at = end
    yield (plain[at:] if at else plain).split()


def term_counts(text: bytes | None, table: bytes = TERM_BYTES) -> Counter[bytes]:
    found: Counter[bytes] = Counter()
    for piece in term_pieces(text or b"", table):
        found.update(piece)
    return found


def shared_pairs(sequences: list[list[int]], symbols: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(pairs, rests): neighbours that repeat as new symbols, and what is left of each sequence.

    Pair i is the symbol ``symbols + i``. A symbol stands at most once in a
    sequence, so a sequence is a linked list by symbol and one replacement
    touches only the pair's neighbours.
    """
    following = [dict(zip(s, s[1:])) for s in sequences]
    before = [dict(zip(s[1:], s)) for s in sequences]
    first = [s[0] if s else None for s in sequences]
    holders: dict[tuple[int, int], set[int]] = {}
    for i, own in enumerate(following):
        for pair in own.items():
            holders.setdefault(pair, set()).add(i)
    queue = [(-len(held), pair) for pair, held in holders.items() if len(held) > 1]
    heapq.heapify(queue)
    pairs: list[tuple[int, int]] = []
    while queue:
        count, pair = heapq.heappop(queue)
        held = holders.get(pair, set())
        if len(held) != -count:
            if len(held) > 1:
                heapq.heappush(queue, (-len(held), pair))
            continue
        a, b = pair
        new = symbols + len(pairs)
        pairs.append(pair)
        grown = set()
        for i in sorted(held):
            left, right = before[i].pop(a, None), following[i].pop(b, None)
            del following[i][a], before[i][b]
            if left is None:
                first[i] = new
            else:
                holders[left, a].discard(i)
                following[i][left], before[i][new] = new, left
                holders.setdefault((left, new), set()).add(i)
                grown.add((left, new))
            if right is not None:
                holders[b, right].discard(i)
                following[i][new], before[i][right] = right, new
                holders.setdefault((new, right), set()).add(i)
                grown.add((new, right))
        del holders[pair]
        for other in grown:
            if len(holders[other]) > 1:
                heapq.heappush(queue, (-len(holders[other]), other))
    rests = []
    for own, at in zip(following, first):
        rest = []
        while at is not None:
            rest.append(at)
            at = own.get(at)
        rests.append(rest)
    return pairs, rests


PLAN = "slot long, symbol int, term binary, bit int, left int, right int, item long, parts array<int>"


def _mined(slot: int, items: pa.Table) -> pa.Table:
    """The sharing graph of a block: a row per leaf, per pair and per item.

    A leaf is a term times a power of two, so that repeats of a term are shared
    as well.
    """
    counts = [term_counts(t.encode() if t else b"") for t in items.column("text").to_pylist()]
    elements = [[(term, bit) for term, n in own.items() for bit in range(n.bit_length()) if n >> bit & 1]
                for own in counts]
    common = Counter(e for own in elements for e in own)
    leaves = sorted(common, key=lambda e: (-common[e], e))
    symbol = {e: i for i, e in enumerate(leaves)}
    pairs, rests = shared_pairs([sorted(symbol[e] for e in own) for own in elements], len(leaves))
    rows = [{"symbol": i, "term": term, "bit": bit} for i, (term, bit) in enumerate(leaves)]
    rows += [{"symbol": i, "left": a, "right": b} for i, (a, b) in enumerate(pairs, len(leaves))]
    rows += [{"item": item, "parts": rest} for item, rest in zip(items.column("row").to_pylist(), rests) if rest]
    schema = pa.schema([("slot", pa.int64()), ("symbol", pa.int32()), ("term", pa.binary()), ("bit", pa.int32()),
                        ("left", pa.int32()), ("right", pa.int32()), ("item", pa.int64()),
                        ("parts", pa.list_(pa.int32()))])
    return pa.Table.from_pylist([{"slot": slot, **row} for row in rows], schema)


class Shared:
    """A block's sharing graph, as arrays."""

    def __init__(self, rows: Iterable):
        leaves, pairs, items = [], [], []
        for row in rows:
            (items if row.item is not None else leaves if row.term is not None else pairs).append(row)
        leaves.sort(key=lambda r: r.symbol)
        pairs.sort(key=lambda r: r.symbol)
        self.terms = sorted({bytes(r.term) for r in leaves})
        place = {term: i for i, term in enumerate(self.terms)}
        self.leaf_term = np.array([place[bytes(r.term)] for r in leaves], np.int64)
        self.leaf_bit = np.array([r.bit for r in leaves], np.int64)
        self.pairs = [(r.left, r.right) for r in pairs]
        self.items = np.array([r.item for r in items], np.int64)
        self.parts = [np.array(r.parts, np.int64) for r in items]

    def batch(self) -> int:
        """Documents whose partial scores are held at once."""
        rows = 2 * len(self.terms) + len(self.leaf_term) + len(self.pairs) + 2 * len(self.items)
        return max(1, min(HELD_DOCS, HELD_BYTES // (8 * max(1, rows))))

    def scores(self, values: np.ndarray) -> np.ndarray:
        """(items, documents) from (terms, documents): every symbol is summed once."""
        held = np.empty((len(self.leaf_term) + len(self.pairs), values.shape[1]), np.int64)
        np.left_shift(values[self.leaf_term], self.leaf_bit[:, None], out=held[:len(self.leaf_term)])
        for symbol, (left, right) in enumerate(self.pairs, len(self.leaf_term)):
            np.add(held[left], held[right], out=held[symbol])
        out = np.empty((len(self.items), values.shape[1]), np.int64)
        for i, parts in enumerate(self.parts):
            held[parts].sum(0, out=out[i])
        return out


def _lists(flat: list, ends: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(flat, kind))


def postings(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): how often a document has each of ``terms``, by their places there."""
    known = docs.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value
        for batch in batches:
            n, ends, found, tfs = [], [], [], []
            for text in batch.column(1):
                text = text.as_buffer()
                counts = term_counts(text.to_pybytes() if text is not None else None)
                n.append(sum(counts.values()))
                for term in counts.keys() & place.keys():
                    found.append(place[term])
                    tfs.append(counts[term])
                ends.append(len(found))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), _lists(found, ends, pa.int32()),
                _lists(tfs, ends, pa.int64())], names=["doc_id", "n", "terms", "tfs"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Positions of the best ``top`` of every item, items together."""
    order = np.lexsort((doc, -score, item))
    starts = np.flatnonzero(np.diff(item[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < top]


def _products(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m per document, beyond 64 bits where its product needs them."""
    factor = 75 * documents
    if len(n) and int(n.max()) * factor > LAST:
        return np.array([25 + int(x) * factor // total for x in n], np.int64)
    return 25 + n * factor // total


def found(posted: DataFrame, shared: Shared, weights: np.ndarray, documents: int, total: int,
          top: int = TOP) -> DataFrame:
    """(item, doc_id, score): per task the best of every item of the block."""
    sent = posted.sparkSession.sparkContext.broadcast((shared, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weight = sent.value
        item, score, doc = (np.zeros(0, np.int64) for _ in range(3))
        nulls = pa.scalar(LAST, pa.int64())
        least = np.ones(len(graph.items), np.int64)
        for whole in batches:
            for at in range(0, len(whole), graph.batch()):
                batch = whole.slice(at, graph.batch())
                ids = batch.column(0).fill_null(nulls).to_numpy(zero_copy_only=False)
                terms = batch.column(2)
                counts = np.diff(terms.offsets.to_numpy())
                if not counts.sum():
                    continue
                m = _products(batch.column(1).to_numpy(), documents, total)
                term, tf = (batch.column(c).flatten().to_numpy() for c in (2, 3))
                column = np.repeat(np.arange(len(batch)), counts)
                values = np.zeros((len(graph.terms), len(batch)), np.int64)
                values[term, column] = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[column]))
                scores = graph.scores(values)
                i, d = np.nonzero(scores >= least[:, None])
                item, score, doc = (np.append(a, b) for a, b in ((item, i), (score, scores[i, d]), (doc, ids[d])))
                keep = _best(item, score, doc, top)
                item, score, doc = item[keep], score[keep], doc[keep]
                # what an item's last place scores is the least that can still enter
                last = np.flatnonzero(np.bincount(item, minlength=len(least)) == top)
                ends = np.searchsorted(item, last, side="right") - 1
                least[last] = np.maximum(score[ends], 1)
        yield pa.RecordBatch.from_arrays([
            pa.array(graph.items[item]), pa.array(doc, mask=doc == LAST), pa.array(score)],
            names=["item", "doc_id", "score"])

    return posted.mapInArrow(run, "item long, doc_id long, score long")


def _texts(items: DataFrame, text_col: str) -> DataFrame:
    """(slot, row, text): every different text once, in blocks of bounded size."""
    texts = items.select(F.col(text_col).alias("text")).where(F.length(text_col) > 0).distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return slots.in_slots(texts.withColumn("none", F.lit(0)).coalesce(size // BLOCK_BYTES + 1), "none", "text",
                          slot_bytes=BLOCK_BYTES)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``top`` documents of every item."""
    spark = deployed(docs.sparkSession)
    texts = _texts(items, item_text_col)
    plan = staged(slots.per_slot(texts, PLAN, _mined), "sharing")
    best, documents, total = None, None, None
    for block in plan.where("item IS NOT NULL").select("slot").distinct().toLocalIterator():
        shared = Shared(plan.where(F.col("slot") == block.slot).toLocalIterator())
        posted = staged(postings(docs, shared.terms, id_col, text_col), "postings")
        if documents is None:
            documents, total = posted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        df = np.zeros(len(shared.terms), np.int64)
        for row in posted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[row.term] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        own = staged(found(posted, shared, weights, documents, total or 1, top), "found")
        best = own if best is None else best.union(own)
    if best is None:
        best = spark.createDataFrame([], "item long, doc_id long, score long")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    named = asked.join(texts.select("text", F.col("row").alias("item")), "text")
    return named.join(best, "item").select("item_id", "rank", "doc_id", "score")
