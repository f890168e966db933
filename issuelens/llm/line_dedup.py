"""Line dedup by winnowing over line hashes.

Lines are the parts of a text between line feeds, compared as they are. Of
every ``run`` neighbouring lines the one with the least hash (the last among
equals) is a fingerprint; so every repeated run of that length holds a
fingerprint at the same place in each of its copies. Fingerprints that occur
again are joined, and matches are extended to both sides, line by line, as far
as a run reaches; a run of ``run`` lines is deleted wherever its sequence also
starts earlier: in a document with a smaller id, or further up in the same one.
Longer repeats are chains of such runs. Runs of blank lines only do not count.
With the ``run`` of two of the query and its SQL, a repeated line stays where no
neighbour repeats with it, and so does a text of one line; a run of one, as in
the corpus pipeline, takes these too.

Null texts stay null and empty ones empty. A row with a null id deletes nothing
and loses nothing; two rows with equal ids and equal line numbers do not delete
from each other. An empty table gives an empty result. Columns other than id
and text are only carried where they are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm import bytetext, slots

RUN = 2
BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
ASKED = {"key": "<u8", "n": "<u4"}
ANSWERED = {"key": "<u8"}
EXTENDED = {"key": "<u8", "check": "<u4", "doc": "<i8", "line": "<i4"}
EXTENDED_ASKED = {**EXTENDED, "last_doc": "<i8", "last_line": "<i4"}


class Lines:
    """Line bounds, hashes and places of a slice of texts."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, run: int, copies: bool = True):
        self.rows, self.data, self.offsets = rows, data, offsets
        stops = np.flatnonzero(data == 0x0A)
        # a line starts where a text does, and after every line feed
        self.starts = np.sort(np.concatenate([offsets[:-1], stops + 1]), kind="stable")
        n = len(offsets) - 1
        counts = 1 + np.diff(np.searchsorted(stops, offsets))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        # starts of empty texts coincide with their neighbours'; the order by text is the same
        self.text = np.repeat(np.arange(n), counts)
        self.ends = np.append(self.starts[1:], len(data))
        final = np.zeros(len(self.starts), bool)
        final[self.first[1:] - 1] = True
        self.ends[final] = offsets[1:]
        self.ends[~final] -= 1
        visible = np.concatenate([[0], np.cumsum(~bytetext.SEPARATORS[data])])
        blank = visible[self.ends] == visible[self.starts]
        self.hashes = bytetext.word_hashes(data, self.starts, self.ends)
        self.checks = lambda: bytetext.word_hashes(data, self.starts, self.ends, seed=1)
        ids = rows.column(rows.schema.get_field_index("doc_id"))
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()[self.text]
        self.line = np.arange(len(self.starts)) - self.first[self.text]
        if not copies:
            # tells a text of one line from the first line of a longer one
            self.line[(counts == 1)[self.text]] = -1
        whole = bytetext.whole_windows(self.first, run, len(self.starts))
        blanks = np.concatenate([[0], np.cumsum(blank)])
        windows = np.arange(max(0, len(self.starts) - run + 1))
        own = whole[:len(windows)] & known[self.text[:len(windows)]]
        own &= blanks[windows + run] - blanks[windows] < run
        self.windows = np.flatnonzero(own)
        # the last of equal minima: count positions from the right
        mirrored = bytetext.sliding_argmin(self.hashes[::-1], run)
        self.fingerprint = (len(self.starts) - 1 - mirrored)[::-1]


def _lines(documents: pa.Table, run: int, copies: bool = True):
    for rows, data, offsets in bytetext.slices(documents.to_batches()):
        yield Lines(rows, data, offsets, run, copies)


def _fingerprints(slot: int, documents: pa.Table, run: int, buckets: int) -> pa.Table:
    found = [own.hashes[np.unique(own.fingerprint[own.windows])] for own in _lines(documents, run)]
    key, n = np.unique(np.concatenate(found), return_counts=True)
    return slots.dealt(slot, key, {"key": key, "n": n.astype("<u4")}, buckets)


def _repeated(table: pa.Table) -> pa.Table:
    slot, entry = slots.gathered(table, ASKED)
    order, starts = slots.grouped(entry["key"])
    sizes = slots.sizes_of(starts, len(order))
    again = (np.add.reduceat(entry["n"][order], starts) > 1) if len(starts) else np.zeros(0, bool)
    own = order[np.repeat(again, sizes)]
    return slots.by_slot(slot[own], {"key": entry["key"][own]})


def _run_keys(own: Lines, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and check of every run, from independent hashes of its lines."""
    return (bytetext.window_hashes(own.hashes, run, BASES[0]),
            (bytetext.window_hashes(own.checks(), run, BASES[1]) >> np.uint64(32)).astype("<u4"))


def _extended(slot: int, documents: pa.Table, answers: pa.Table, run: int, buckets: int, copies: bool) -> pa.Table:
    """Runs around repeated fingerprints, with the first and last place of each in the slot."""
    known = slots.Members(slots.gathered(answers, ANSWERED)[1]["key"])
    parts = []
    for own in _lines(documents, run, copies):
        alive = np.zeros(len(own.hashes), bool)
        alive[known.find(own.hashes)[0]] = True
        at = own.windows[alive[own.fingerprint[own.windows]]]
        key, check = _run_keys(own, run)
        parts.append((key[at], check[at], own.ids[at], own.line[at].astype("<i4")))
    key, check, ids, line = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((line, ids, check, key))
    key, check, ids, line = key[order], check[order], ids[order], line[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    starts = np.flatnonzero(new)
    last = starts + slots.sizes_of(starts, len(key)) - 1
    return slots.dealt(slot, key[starts], {
        "key": key[starts], "check": check[starts], "doc": ids[starts], "line": line[starts],
        "last_doc": ids[last], "last_line": line[last]}, buckets)


def _earliest(table: pa.Table) -> pa.Table:
    """To every slot that holds a run later than its first place, that place."""
    slot, entry = slots.gathered(table, EXTENDED_ASKED)
    order = np.lexsort((entry["line"], entry["doc"], entry["check"], entry["key"]))
    key, check = entry["key"][order], entry["check"][order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    starts = np.flatnonzero(new)
    first = np.repeat(order[starts], slots.sizes_of(starts, len(order)))
    doc, line = entry["doc"][first], entry["line"][first]
    later = (entry["last_doc"][order] > doc) | (
        (entry["last_doc"][order] == doc) & (entry["last_line"][order] > line))
    own = order[later]
    return slots.by_slot(slot[own], {
        "key": entry["key"][own], "check": entry["check"][own], "doc": doc[later], "line": line[later]})


def _cut(documents: pa.Table, answers: pa.Table, run: int, names: list[str], carried: list[str],
         copies: bool) -> pa.Table:
    _, known = slots.gathered(answers, EXTENDED)
    out = []
    for own in _lines(documents, run, copies):
        n = len(own.starts)
        gone = np.zeros(n + 1, np.int32)
        if len(own.windows) and len(known["key"]):
            key, check = _run_keys(own, run)
            at, place = slots.lookup(key[own.windows], check[own.windows], known["key"], known["check"])
            at = own.windows[at]
            doc, line = known["doc"][place], known["line"][place]
            at = at[((own.ids[at] > doc) | ((own.ids[at] == doc) & (own.line[at] > line)))
                    & ~((own.line[at] < 0) & (line < 0))]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + run, -1)
        covered = np.cumsum(gone[:-1]) > 0
        kept = ~covered
        left = np.concatenate([[0], np.cumsum(kept)])[own.first]
        lengths = own.ends[kept] - own.starts[kept] + 1
        final = left[1:][np.diff(left) > 0] - 1
        lengths[final] -= 1
        to = np.cumsum(lengths)
        offsets = np.concatenate([[0], to])[left]
        total = int(to[-1]) if len(to) else 0
        text = np.take(own.data, np.arange(total) + np.repeat(
            own.starts[kept] - to + lengths, lengths), mode="clip") if total else np.zeros(0, np.uint8)
        feeds = np.ones(len(to), bool)
        feeds[final] = False
        text[to[feeds] - 1] = 0x0A
        whole = pa.Array.from_buffers(pa.string(), len(own.rows), [
            None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)])
        before = own.rows.column(own.rows.schema.get_field_index("text"))
        whole = pa.compute.if_else(before.is_valid(), whole, pa.scalar(None, pa.string()))
        removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[own.first])
        column = lambda name: own.rows.column(own.rows.schema.get_field_index(name))  # noqa: E731, B023
        columns = {"n_lines": pa.array(np.diff(own.first)), "n_removed": pa.array(removed),
                   **{c: column(f"carry_{c}") for c in carried}}
        out.append(pa.table([column("doc_id"), whole, *columns.values()], names=names))
    return pa.concat_tables(out)


def dedup(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text",
          carry: Sequence[str] = (), copies: bool = True) -> DataFrame:
    """Per row: id, the text left, its lines, the lines removed, and the columns ``carry``.

    A carried column named n_lines or n_removed takes that count's place. Without
    ``copies``, a text of one line whose first occurrence is such a text as well
    is left whole, for a later step that drops copies of documents with their row.
    """
    slotted = slots.in_slots(docs, id_col, text_col, carry)
    buckets = slots.bucket_count(slotted)
    asked = slots.per_slot(slotted, slots.entries_schema(ASKED),
                           lambda slot, d: _fingerprints(slot, d, run, buckets))
    repeated = asked.groupBy("bucket").applyInArrow(_repeated, slots.answer_schema(ANSWERED))
    extended = slots.with_answers(slotted, repeated, slots.entries_schema(EXTENDED_ASKED),
                                  lambda slot, d, a: _extended(slot, d, a, run, buckets, copies))
    earliest = extended.groupBy("bucket").applyInArrow(_earliest, slots.answer_schema(EXTENDED))
    carried = list(carry)
    types = {"n_lines": T.LongType(), "n_removed": T.LongType(), **{c: docs.schema[c].dataType for c in carried}}
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField(text_col, T.StringType()),
                           *[T.StructField(c, kind) for c, kind in types.items()]])
    names = schema.fieldNames()
    return slots.with_answers(slotted, earliest, schema,
                              lambda slot, d, a: _cut(d, a, run, names, carried, copies))


def line_digests(docs: DataFrame) -> DataFrame:
    """Per document: lines, lines removed and the digest of the text left."""
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
