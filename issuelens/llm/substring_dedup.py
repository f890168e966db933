"""Substring dedup by level-wise doubling of repeated word windows.

A window of ``length`` words is deleted where its sequence also starts in a
document with a smaller id. Whether it does is found by levels: windows of
``start`` words that occur once cannot be part of a repeat, those that occur
again are extended to twice the length, and so on until ``length``; what does
not survive a level is not looked at again. At the first level a target window
is stood for by the one of its sub-windows with the least hash, the same in
every copy, so that a fraction of the windows is enough.

Words are runs of bytes other than space and 0x09 to 0x0D, unchanged. Nulls and
empty texts have no words. A row with a null id deletes nothing and loses
nothing; rows with equal ids do not delete from each other. An empty table
gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm import bytetext, slots

LENGTH, START = 13, 7
BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: What a slot says of a window and hears of it, at the last level and before.
ASKED = {"key": "<u8", "check": "<u4", "first": "<i8", "more": "<u1"}
ANSWERED = {"key": "<u8", "check": "<u4", "first": "<i8"}
ASKED_BEFORE = {"key": "<u8", "more": "<u1"}
ANSWERED_BEFORE = {"key": "<u8"}
RESULT = ("doc_id long, n_words long, n_removed long, kept string, "
          "removed array<struct<start:int,end:int>>")


def levels(length: int, start: int) -> list[int]:
    out = [min(start, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _places(hashes: np.ndarray, length: int, steps: list[int]) -> list[np.ndarray]:
    """Per level, the sub-window that stands for each target window, wherever that stands."""
    first = bytetext.window_hashes(hashes, steps[0], BASES[0])
    at = bytetext.sliding_argmin(first, length - steps[0] + 1)
    out = [at]
    window = np.arange(len(at))
    for size in steps[1:]:
        out.append(np.clip(out[-1], window, window + length - size))
    return out


def _checks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """32 bits more of every window, from hashes of its words that are independent of the keys'."""
    hashes = bytetext.word_hashes(data, starts, ends, seed=1)
    return (bytetext.window_hashes(hashes, size, BASES[1]) >> np.uint64(32)).astype("<u4")


def _windows(documents: pa.Table, length: int):
    """Per slice: rows, bytes, word bounds, first words, hashes, target windows, id per word."""
    for rows, data, offsets in bytetext.slices(documents.to_batches()):
        starts, ends, first = bytetext.words(data, offsets)
        hashes = bytetext.word_hashes(data, starts, ends)
        n = max(0, len(hashes) - length + 1)
        known = rows.column(2)
        ids = np.repeat(known.fill_null(0).to_numpy(), np.diff(first))
        valid = bytetext.whole_windows(first, length, len(hashes))[:n]
        if known.null_count:
            valid &= np.repeat(known.is_valid().to_numpy(zero_copy_only=False), np.diff(first))[:n]
        yield rows, data, starts, ends, first, hashes, np.flatnonzero(valid), ids


def _asked(slot: int, documents: pa.Table, answers: pa.Table | None, length: int, steps: list[int],
           level: int, buckets: int) -> pa.Table:
    """Entries of the windows that are still candidates, one per sequence of words."""
    parts = []
    last = level == len(steps) - 1
    if answers is not None:
        survivors = slots.Members(slots.gathered(answers, ANSWERED_BEFORE)[1]["key"])
    for _, data, starts, ends, _, hashes, windows, ids in _windows(documents, length):
        if not len(windows):
            continue
        places = _places(hashes, length, steps[:level + 1])
        if answers is not None:
            before = bytetext.window_hashes(hashes, steps[level - 1], BASES[0])
            alive = np.zeros(len(before), bool)
            alive[survivors.find(before)[0]] = True
            windows = windows[alive[places[level - 1][windows]]]
        at = np.unique(places[level][windows])
        key = bytetext.window_hashes(hashes, steps[level], BASES[0])
        check = _checks(data, starts, ends, steps[level])[at] if last else np.zeros(len(at), "<u4")
        parts.append((key[at], check, ids[at]))
    key, check, ids = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind)
                       for i, kind in enumerate(("<u8", "<u4", "<i8")))
    order, starts = slots.grouped(key, check) if last else slots.grouped(key)
    ids = ids[order]
    least = np.minimum.reduceat(ids, starts) if len(starts) else ids
    most = np.maximum.reduceat(ids, starts) if len(starts) else ids
    own = order[starts]
    said = {"key": key[own], "check": check[own], "first": least, "more": (most > least).astype("<u1")}
    return slots.dealt(slot, key[own], {f: said[f] for f in (ASKED if last else ASKED_BEFORE)}, buckets)


def _met(table: pa.Table) -> pa.Table:
    """To every slot those of its windows that more than one document holds."""
    slot, entry = slots.gathered(table, ASKED_BEFORE)
    order, starts = slots.grouped(entry["key"])
    sizes = slots.sizes_of(starts, len(order))
    more = np.maximum.reduceat(entry["more"][order], starts) if len(starts) else entry["more"]
    own = order[np.repeat((more > 0) | (sizes > 1), sizes)]
    return slots.by_slot(slot[own], {"key": entry["key"][own]})


def _met_last(table: pa.Table) -> pa.Table:
    """To every slot those of its windows that a document with a smaller id holds."""
    slot, entry = slots.gathered(table, ASKED)
    order, starts = slots.grouped(entry["key"], entry["check"])
    first = entry["first"][order]
    least = np.repeat(np.minimum.reduceat(first, starts), slots.sizes_of(starts, len(order))) if len(starts) else first
    later = (first > least) | (entry["more"][order] > 0)
    own = order[later]
    return slots.by_slot(slot[own], {
        "key": entry["key"][own], "check": entry["check"][own], "first": least[later]})


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts made of these words, one space between two."""
    lengths = ends - starts + 1
    final = first[1:][np.diff(first) > 0] - 1
    lengths[final] -= 1
    to = np.cumsum(lengths)
    offsets = np.concatenate([[0], to])[first]
    total = int(to[-1]) if len(to) else 0
    at = np.arange(total) + np.repeat(starts - to + lengths, lengths)
    out = np.take(data, at, mode="clip")
    spaces = np.ones(len(to), bool)
    spaces[final] = False
    out[to[spaces] - 1] = 0x20
    return out, offsets


def _removed(documents: pa.Table, answers: pa.Table, length: int) -> pa.Table:
    _, known = slots.gathered(answers, ANSWERED)
    out = []
    for rows, data, starts, ends, first, hashes, windows, ids in _windows(documents, length):
        gone = np.zeros(len(hashes) + 1, np.int32)
        if len(windows) and len(known["key"]):
            key = bytetext.window_hashes(hashes, length, BASES[0])
            check = _checks(data, starts, ends, length)
            at, place = slots.lookup(key[windows], check[windows], known["key"], known["check"])
            at = windows[at]
            at = at[ids[at] > known["first"][place]]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + length, -1)
        covered = np.cumsum(gone[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(covered)])[first]
        kept = ~covered
        left = np.concatenate([[0], np.cumsum(kept)])[first]
        text, offsets = joined_words(data, starts[kept], ends[kept], left)
        edges = np.concatenate([[False], covered, [False]])
        inner = np.isin(np.arange(len(covered)), first[1:-1])
        begin = np.flatnonzero(covered & (~edges[:-2] | inner))
        after = np.concatenate([inner[1:], [True]]) if len(inner) else inner
        end = np.flatnonzero(covered & (~edges[2:] | after)) + 1
        owner = np.searchsorted(first, begin, side="right") - 1
        runs = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(begin, first).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array((begin - first[owner]).astype(np.int32)),
                                        pa.array((end - first[owner]).astype(np.int32))], names=["start", "end"]))
        out.append(pa.table([
            rows.column(2), pa.array(np.diff(first)), pa.array(np.diff(total)),
            pa.Array.from_buffers(pa.string(), len(rows), [
                None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)]), runs],
            names=["doc_id", "n_words", "n_removed", "kept", "removed"]))
    return pa.concat_tables(out)


def dedup(docs: DataFrame, length: int = LENGTH, start: int = START, id_col: str = "doc_id",
          text_col: str = "text", slotted: DataFrame | None = None) -> DataFrame:
    """Per row: words, words removed, the text left (words joined by one space) and the removed runs."""
    slotted = slots.in_slots(docs, id_col, text_col) if slotted is None else slotted
    steps, buckets = levels(length, start), slots.bucket_count(slotted)
    answers = None
    for level in range(len(steps)):
        last = level == len(steps) - 1
        asked = slots.entries_schema(ASKED if last else ASKED_BEFORE)
        if answers is None:
            entries = slots.per_slot(slotted, asked, lambda slot, d: _asked(
                slot, d, None, length, steps, 0, buckets))
        else:
            entries = slots.with_answers(slotted, answers, asked, lambda slot, d, a, k=level: _asked(
                slot, d, a, length, steps, k, buckets))
        answers = entries.groupBy("bucket").applyInArrow(
            _met_last if last else _met, slots.answer_schema(ANSWERED if last else ANSWERED_BEFORE))
    return slots.with_answers(slotted, answers, RESULT, lambda slot, d, a: _removed(d, a, length))


def word_digests(docs: DataFrame) -> DataFrame:
    """Per document: words, words removed, and the digest of the words kept."""
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
