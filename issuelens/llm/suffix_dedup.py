"""Repeated byte strings by a suffix sort on hashes.

A byte is removed where a string of ``length`` bytes that covers it also starts
anywhere else, in the same text or another. Texts are judged as they came in.

Candidates: of the ``GRAM``-byte strings inside a window of ``length`` bytes the
one with the least hash is the window's anchor, at the same place in each copy
of the window. Anchors whose hash occurs once are dropped. The others meet with
the bytes around them, one group per anchor hash.

In a group the suffixes that begin at the anchors are sorted: prefix polynomial
hashes give the hash of any substring at once, a binary search over lengths
finds how far two suffixes agree, and a mergesort on these comparisons orders
them. From the sorted order the strings common to neighbours are walked; where
an extension to the right and one to the left, found in the same way, together
reach ``length`` bytes, the windows between are repeated. Agreement is verified
on the bytes themselves.

An anchor that occurs more than ``LARGE`` times, as in a passage that many texts
share, is not gathered in one group. Its windows, one by one, are dealt by a
96-bit hash, after each slot of documents has merged its own equal ones, so
copies are counted where they meet and no group grows with their number. Equal
hashes there count as equal strings.

Nulls and empty texts have no bytes; rows with equal or null ids are texts of
their own; an empty table gives an empty result. Only the id and text columns
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm import bytetext, slots
from issuelens.llm.bytetext import INVERSE, powers
from issuelens.session import staged

LENGTH = 200
#: Bytes of an anchor, as a part of a window, and the occurrences of a group.
GRAM_SHARE, LARGE = 0.3, 64
SECOND = 0xC2B2AE3D27D4EB4F
SECOND_INVERSE = pow(SECOND, -1, 2**64)
SECOND_VALUES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)
ASKED = {"key": "<u8", "n": "<u4"}
COUNTED = {"key": "<u8", "n": "<u4"}
WINDOW = {"key": "<u8", "check": "<u4", "n": "<u4"}
RESULT = "doc_id long, n_bytes long, kept binary, removed array<struct<start:int,end:int>>"


def gram_of(length: int) -> int:
    return max(1, int(length * GRAM_SHARE))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values.

    Values are cut into blocks of that width; a run is the end of one block and
    the start of the next, whose running minima are kept from both sides.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    blocks = -(-len(values) // width)
    table = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    table[:len(values)] = values
    table = table.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


class Anchors:
    """Anchors of a slice of texts: position, hash, and the first and last window each stands for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        gram = gram_of(length)
        none = np.zeros(0, np.int64)
        self.at, self.low, self.high, self.key = none, none, none, np.zeros(0, np.uint64)
        windows = starts_of_windows(offsets, length)
        if not len(windows):
            return
        prefix = bytetext.prefix_hash(data)
        hashes = prefix[gram:] - prefix[:-gram]
        hashes *= powers(INVERSE, len(hashes))
        hashes = bytetext.mixed(hashes)
        # half of the hash, and the place: the first of equal ones, and the place is known
        ranked = hashes & np.uint64(0xFFFFFFFF00000000)
        ranked |= np.arange(len(hashes), dtype=np.uint64)
        least = sliding_min(ranked, length - gram + 1)[windows]
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=-1))
        self.at, self.low = at[new], windows[new]
        self.high = windows[np.append(new[1:], len(windows)) - 1]
        self.key = hashes[self.at]


def starts_of_windows(offsets: np.ndarray, length: int) -> np.ndarray:
    """Every position from which ``length`` bytes lie in one text."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(offsets[:-1] - ends + counts, counts)


def _anchored(slot: int, documents: pa.Table, length: int, buckets: int) -> pa.Table:
    keys = [Anchors(data, offsets, length).key for _, data, offsets in bytetext.slices(documents.to_batches())]
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return slots.dealt(slot, key, {"key": key, "n": n.astype("<u4")}, buckets)


def _counted(table: pa.Table) -> pa.Table:
    slot, entry = slots.gathered(table, ASKED)
    order, starts = slots.grouped(entry["key"])
    sizes = slots.sizes_of(starts, len(order))
    total = np.add.reduceat(entry["n"][order].astype(np.int64), starts) if len(starts) else sizes
    total = np.repeat(total, sizes)
    own = order[total > 1]
    return slots.by_slot(slot[own], {
        "key": entry["key"][own], "n": np.minimum(total[total > 1], 2**31).astype("<u4")})


GROUPED = {"key": "<u8", "row": "<i8", "low": "<i4", "back": "<i4", "spread": "<i4"}


def _gathered_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    if not len(ends):
        return np.zeros(0, np.uint8)
    return data[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)]


def _surrounded(slot: int, documents: pa.Table, answers: pa.Table, length: int, buckets: int,
                large: int) -> pa.Table:
    """Anchors of small groups with the bytes of all their windows."""
    _, known = slots.gathered(answers, COUNTED)
    members = slots.Members(known["key"][known["n"] <= large])
    parts, texts = [], []
    for rows, data, offsets in bytetext.slices(documents.to_batches()):
        anchors = Anchors(data, offsets, length)
        own, _ = members.find(anchors.key)
        at, low, high, key = (x[own] for x in (anchors.at, anchors.low, anchors.high, anchors.key))
        owner = np.searchsorted(offsets, low, side="right") - 1
        parts.append({"key": key, "row": rows.column(1).to_numpy()[owner],
                      "low": (low - offsets[owner]).astype("<i4"), "back": (at - low).astype("<i4"),
                      "spread": (high - low).astype("<i4")})
        texts.append(_gathered_bytes(data, low, high - low + length))
    entry = {f: np.concatenate([p[f] for p in parts]) for f in GROUPED}
    sizes = entry["spread"].astype(np.int64) + length
    out = slots.dealt(slot, entry["key"], entry, buckets)
    # the bytes follow the order in which the entries were dealt
    order = slots.dealt_order(entry["key"], buckets)
    whole = np.concatenate(texts)
    text = _gathered_bytes(whole, (np.cumsum(sizes) - sizes)[order], sizes[order])
    counts = np.array([len(x.as_buffer()) // 8 for x in out.column("key")], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes[order])])[np.concatenate([[0], np.cumsum(counts)])]
    return out.append_column("text", pa.Array.from_buffers(pa.binary(), len(counts), [
        None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text)]))


class Suffixes:
    """Hash-compared suffixes of one byte array."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.prefix = bytetext.prefix_hash(data)
        self.inverse = powers(INVERSE, len(self.prefix))

    def _same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        prefix, inverse = self.prefix, self.inverse
        return (prefix[i + size] - prefix[i]) * inverse[i] == (prefix[j + size] - prefix[j]) * inverse[j]

    def ahead(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes from i and j on agree, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self._same(i, j, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def behind(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes before i and j agree, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self._same(i - middle, j - middle, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def less(self, i, i_size, j, j_size) -> np.ndarray:
        """Whether suffix i of that size comes before suffix j."""
        shorter = np.minimum(i_size, j_size)
        common = self.ahead(i, j, shorter)
        over = common == shorter
        last = len(self.data) - 1
        own, other = self.data[np.minimum(i + common, last)], self.data[np.minimum(j + common, last)]
        return np.where(over, i_size < j_size, own < other)

    def sort(self, group: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Order by group (ascending already) and suffix: a mergesort, all groups at a time."""
        n = len(group)
        order = np.arange(n)
        starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if n else order
        sizes = slots.sizes_of(starts, n)
        begin, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        place = np.arange(n)
        width = 1
        while len(sizes) and width < sizes.max():
            run = (place - begin) // width
            left = run % 2 == 0
            sibling = begin + (run + np.where(left, 1, -1)) * width
            low = np.minimum(sibling, end)
            high = np.minimum(sibling + width, end)
            first = low.copy()
            own_start = begin + run * width
            active = np.flatnonzero(low < high)
            while len(active):
                middle = (low[active] + high[active]) // 2
                other, own = order[middle], order[place[active]]
                # of equal suffixes those of the left run come first
                before = np.where(
                    left[active], self.less(at[other], size[other], at[own], size[own]),
                    ~self.less(at[own], size[own], at[other], size[other]))
                low[active] = np.where(before, middle + 1, low[active])
                high[active] = np.where(before, high[active], middle)
                active = active[low[active] < high[active]]
            target = np.minimum(own_start, np.where(left, own_start, first)) + (place - own_start) + (low - first)
            merged = np.empty(n, order.dtype)
            merged[target] = order[place]
            order = merged
            width *= 2
        return order

    def verified(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes agree, not only their hashes."""
        out = np.ones(len(i), bool)
        for at in range(0, len(i), 8192):
            a, b, n = i[at:at + 8192], j[at:at + 8192], size[at:at + 8192]
            wrong = _gathered_bytes(self.data, a, n) != _gathered_bytes(self.data, b, n)
            if wrong.any():
                out[at + np.unique(np.repeat(np.arange(len(n)), n)[wrong])] = False
        return out


def repeated_ranges(suffixes: Suffixes, key: np.ndarray, start: np.ndarray, back: np.ndarray,
                    spread: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, low, high): windows of an entry, counted from its first, that some other entry repeats.

    Entries are ascending by key; ``start`` is where an entry's bytes begin, its
    anchor is ``back`` further on, and it has ``spread + 1`` windows.
    """
    at, right = start + back, spread + length - back
    order = suffixes.sort(key, at, right)
    at, right, back, spread = at[order], right[order], back[order], spread[order]
    # equal keys stand together, so the keys keep their order
    n = len(order)
    full = np.zeros(n, bool)
    out = []
    common, step = None, 1
    left = np.flatnonzero(key[1:] == key[:-1]) if n else np.zeros(0, np.int64)
    neighbour = np.zeros(n, np.int64)
    if len(left):
        neighbour[left] = suffixes.ahead(at[left], at[left + 1], np.minimum(right[left], right[left + 1]))
    common = np.full(n, np.iinfo(np.int64).max)
    while len(left):
        i, j = left, left + step
        # what a suffix shares with a later one is the least of what neighbours share
        common[i] = np.minimum(common[i], neighbour[j - 1])
        shared = common[i]
        open_ = ~(full[i] & full[j]) & (shared + np.minimum(back[i], back[j]) >= length)
        i, j, shared = i[open_], j[open_], shared[open_]
        if len(i):
            before = suffixes.behind(at[i], at[j], np.minimum(back[i], back[j]))
            enough = before + shared >= length
            i, j, shared, before = (x[enough] for x in (i, j, shared, before))
            true = suffixes.verified(at[i] - before, at[j] - before, before + shared)
            for k in np.flatnonzero(~true):
                shared[k], before[k] = _exact(suffixes.data, at[i[k]], at[j[k]], shared[k], before[k])
            keep = before + shared >= length
            i, j, shared, before = (x[keep] for x in (i, j, shared, before))
            for own in (i, j):
                low, high = back[own] - before, back[own] + shared - length
                out.append((order[own], low, high))
                full[own[(low == 0) & (high == spread[own])]] = True
        step += 1
        left = left[left + step < n]
        left = left[key[left + step] == key[left]]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _exact(data: np.ndarray, i: int, j: int, ahead: int, behind: int) -> tuple[int, int]:
    """Agreement byte by byte, after a collision of hashes."""
    right = np.flatnonzero(data[i:i + ahead] != data[j:j + ahead])
    left = np.flatnonzero(data[i - behind:i][::-1] != data[j - behind:j][::-1])
    return (int(right[0]) if len(right) else ahead), (int(left[0]) if len(left) else behind)


ANSWER = {"row": "<i8", "low": "<i4", "high": "<i4", "key": "<u8", "check": "<u4"}


def _answer(slot: np.ndarray, **fields: np.ndarray) -> pa.Table:
    found = slots.by_slot(slot, fields)
    empty = pa.array([b""] * len(found), pa.binary())
    return pa.table([found.column("slot"), *[
        found.column(f) if f in fields else empty for f in ANSWER]], names=["slot", *ANSWER])


def _sorted_groups(table: pa.Table, length: int) -> pa.Table:
    slot, entry = slots.gathered(table, GROUPED)
    packed = table.column("text").combine_chunks()
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
    data = (np.frombuffer(packed.buffers()[2], np.uint8)[ends[0]:ends[-1]] if len(packed) and ends[-1] > ends[0]
            else np.zeros(0, np.uint8))
    sizes = entry["spread"].astype(np.int64) + length
    start = np.cumsum(sizes) - sizes
    order = np.lexsort((entry["low"], entry["row"], entry["key"]))
    own, low, high = repeated_ranges(
        Suffixes(data), entry["key"][order], start[order], entry["back"][order].astype(np.int64),
        entry["spread"][order].astype(np.int64), length)
    own = order[own]
    return _answer(slot[own], row=entry["row"][own], low=(entry["low"][own] + low).astype("<i4"),
                   high=(entry["low"][own] + high).astype("<i4"))


def _checks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    prefix = bytetext.prefix_hash(data, SECOND_VALUES, SECOND)
    second = (prefix[at + length] - prefix[at]) * powers(SECOND_INVERSE, len(prefix))[at]
    return (bytetext.mixed(second) >> np.uint64(32)).astype("<u4")


def _single_windows(slot: int, documents: pa.Table, answers: pa.Table, length: int, buckets: int,
                    large: int) -> pa.Table:
    """Windows of the anchors that occur too often for a group, equal ones merged."""
    _, known = slots.gathered(answers, COUNTED)
    members = slots.Members(known["key"][known["n"] > large])
    keys, checks = [np.zeros(0, np.uint64)], [np.zeros(0, "<u4")]
    if len(members.known):
        for _, data, offsets in bytetext.slices(documents.to_batches()):
            anchors = Anchors(data, offsets, length)
            own, _ = members.find(anchors.key)
            if not len(own):
                continue
            counts = anchors.high[own] - anchors.low[own] + 1
            ends = np.cumsum(counts)
            at = np.arange(ends[-1]) + np.repeat(anchors.low[own] - ends + counts, counts)
            prefix = bytetext.prefix_hash(data)
            keys.append(bytetext.mixed((prefix[at + length] - prefix[at]) * powers(INVERSE, len(prefix))[at]))
            checks.append(_checks(data, at, length))
    key, check = np.concatenate(keys), np.concatenate(checks)
    order, starts = slots.grouped(key, check)
    own = order[starts]
    return slots.dealt(slot, key[own], {
        "key": key[own], "check": check[own],
        "n": slots.sizes_of(starts, len(order)).astype("<u4")}, buckets)


def _same_windows(table: pa.Table) -> pa.Table:
    slot, entry = slots.gathered(table, WINDOW)
    order, starts = slots.grouped(entry["key"], entry["check"])
    sizes = slots.sizes_of(starts, len(order))
    again = (np.add.reduceat(entry["n"][order].astype(np.int64), starts) > 1) if len(starts) else np.zeros(0, bool)
    own = order[np.repeat(again, sizes)]
    return _answer(slot[own], key=entry["key"][own], check=entry["check"][own])


def _removed(documents: pa.Table, answers: pa.Table, length: int) -> pa.Table:
    known = {f: slots.gathered(answers, {f: kind})[1][f] for f, kind in ANSWER.items()}
    order = np.argsort(known["row"], kind="stable")
    row, low, high = (known[f][order] for f in ("row", "low", "high"))
    members = slots.Members(known["key"])
    out = []
    for rows, data, offsets in bytetext.slices(documents.to_batches()):
        edge = np.zeros(len(data) + 1, np.int32)
        own = rows.column(1).to_numpy()
        first, last = np.searchsorted(row, own, "left"), np.searchsorted(row, own, "right")
        counts = last - first
        ends = np.cumsum(counts)
        if ends[-1]:
            at = np.arange(ends[-1]) + np.repeat(first - ends + counts, counts)
            shift = np.repeat(offsets[:-1], counts)
            np.add.at(edge, shift + low[at], 1)
            np.add.at(edge, shift + high[at] + length, -1)
        if len(members.known):
            windows = starts_of_windows(offsets, length)
            prefix = bytetext.prefix_hash(data)
            keys = (prefix[windows + length] - prefix[windows]) * powers(INVERSE, len(prefix))[windows]
            keys = bytetext.mixed(keys)
            hit, _ = members.find(keys)
            if len(hit):
                checks = _checks(data, windows[hit], length)
                sure, _ = slots.lookup(keys[hit], checks, known["key"], known["check"])
                at = windows[hit[sure]]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
        covered = np.cumsum(edge[:-1]) > 0
        kept = np.concatenate([[0], np.cumsum(~covered)])[offsets]
        # texts touch: a run ends with its text
        starts_text = np.zeros(len(data) + 1, bool)
        starts_text[offsets] = True
        before = np.concatenate([[False], covered[:-1]]) if len(data) else covered
        after = np.concatenate([covered[1:], [False]]) if len(data) else covered
        begin = np.flatnonzero(covered & (~before | starts_text[:-1]))
        end = np.flatnonzero(covered & (~after | starts_text[1:])) + 1
        owner = np.searchsorted(offsets, begin, side="right") - 1
        runs = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(begin, offsets).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array((begin - offsets[owner]).astype(np.int32)),
                                        pa.array((end - offsets[owner]).astype(np.int32))], names=["start", "end"]))
        out.append(pa.table([
            rows.column(2), pa.array(np.diff(offsets)), pa.Array.from_buffers(pa.binary(), len(rows), [
                None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(data[~covered])]), runs],
            names=["doc_id", "n_bytes", "kept", "removed"]))
    return pa.concat_tables(out)


def dedup(docs: DataFrame, length: int = LENGTH, large: int = LARGE, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per row: bytes, the bytes kept, and the removed runs."""
    slotted = slots.in_slots(docs, id_col, text_col)
    buckets = slots.bucket_count(slotted)
    asked = slots.per_slot(slotted, slots.entries_schema(ASKED),
                           lambda slot, d: _anchored(slot, d, length, buckets))
    counted = staged(asked.groupBy("bucket").applyInArrow(_counted, slots.answer_schema(COUNTED)), "anchors")
    groups = slots.with_answers(slotted, counted, slots.entries_schema({**GROUPED, "text": ""}),
                                lambda slot, d, a: _surrounded(slot, d, a, length, buckets, large))
    ranges = groups.groupBy("bucket").applyInArrow(
        lambda t: _sorted_groups(t, length), slots.answer_schema(ANSWER))
    windows = slots.with_answers(slotted, counted, slots.entries_schema(WINDOW),
                                 lambda slot, d, a: _single_windows(slot, d, a, length, buckets, large))
    same = windows.groupBy("bucket").applyInArrow(_same_windows, slots.answer_schema(ANSWER))
    return slots.with_answers(slotted, ranges.union(same), RESULT, lambda slot, d, a: _removed(d, a, length))


def byte_digests(docs: DataFrame) -> DataFrame:
    """Per document: bytes, bytes removed, runs removed, and the digest of the bytes kept."""
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
