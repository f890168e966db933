"""Vectorised helpers over the UTF-8 bytes of an Arrow text column.

Texts are handled in slices of about ``CHUNK`` bytes, so the arrays of a task
stay bounded however many rows an Arrow batch holds; a longer text makes a
slice of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RANDOM = np.random.default_rng(20260601)
#: A random 64-bit value per byte, and the odd base of the prefix polynomials.
BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}
#: Of eight bytes the first 0 to 8, and one odd number per seed.
KEPT_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SEEDS = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, 1024)
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if size <= 2 * CHUNK:
            _POWERS[base] = known
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values, so that every bit depends on all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for slices of at most CHUNK bytes, or one long text.

    ``offsets`` has one entry more than rows and starts at 0. A null text
    counts as empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        if text.null_count:
            text = text.fill_null(b"" if pa.types.is_binary(text.type) else "")
        wide = text.cast(pa.large_binary())
        offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset:wide.offset + len(wide) + 1]
        data = wide.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at, rows = 0, len(wide)
        while at < rows:
            end = int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1
            end = min(rows, max(at + 1, end))
            own = offsets[at:end + 1]
            yield batch.slice(at, end - at), data[own[0]:own[-1]], own - own[0]
            at = end


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_VALUES, base: int = BASE) -> np.ndarray:
    """Prefix polynomial: entry i covers bytes before i."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.take(values, data, out=out[1:], mode="clip")
    out[1:] *= powers(base, len(data))
    np.cumsum(out[1:], out=out[1:])
    return out


def ranges_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end), the same wherever they stand."""
    inverse = powers(INVERSE, len(prefix))
    return (prefix[ends] - prefix[starts]) * inverse[starts]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total) of all words.

    A word is a run of bytes other than space and 0x09 to 0x0D; none crosses
    the end of its text.
    """
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(len(offsets), np.int64),)
    inside = ~SEPARATORS[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[0] = True
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge[:-1] | ~before))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the bytes in each [start, end), one after another.

    Every eight bytes are mixed with their number before they are added up, so
    no pattern of the bytes makes unequal texts equal, as it does with a
    polynomial. Hashes of two seeds are independent.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    blocks = np.maximum(1, (ends - starts + 7) >> 3)
    upto = np.cumsum(blocks)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    done = 0
    while done < len(starts):
        before = upto[done - 1] if done else 0
        end = max(done + 1, int(np.searchsorted(upto, before + CHUNK, side="right")))
        own = blocks[done:end]
        first = upto[done:end] - own - before
        unit = np.repeat(np.arange(end - done), own)
        number = np.arange(len(unit)) - first[unit]
        at = starts[done:end][unit] + 8 * number
        block = eights[at] & KEPT_BYTES[np.minimum(ends[done:end][unit] - at, 8)]
        block ^= mixed((number.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE) ^ SEEDS[seed])
        out[done:end] = np.add.reduceat(mixed(block), first)
        done = end
    return mixed(out + (ends - starts).astype(np.uint64) * SEEDS[seed])


def window_hashes(units: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of units[i:i+length] for every i; empty when there are too few."""
    n = len(units) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = np.uint64(base | 1)
    for j in range(length):
        out *= factor
        out += units[j:j + n]
    return mixed(out)


def whole_windows(first: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of the n unit positions start a window inside one text."""
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + length <= ends


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the (first) least value of each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = values[:n].copy(), np.arange(n)
    for j in range(1, width):
        other = values[j:j + n]
        lower = other < least
        np.copyto(least, other, where=lower)
        at[lower] = np.flatnonzero(lower) + j
    return at


def as_long(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as the signed longs Spark has."""
    return x.view(np.int64)
