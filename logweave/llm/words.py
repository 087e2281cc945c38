"""Words of whole texts as 64-bit hashes, vectorised over Arrow string batches.

A word is a run of bytes other than the ASCII white space \\x20 and \\x09-\\x0D.
White space is ASCII, so UTF-8 bytes are cut exactly where the text would be.
Texts are hashed in blocks of about ``BLOCK`` bytes that end at white space, so
memory does not grow with the length of a text beyond 8 bytes per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (two multiply-xorshift rounds)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    p = np.full(max(n, 1), base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of an Arrow string column (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, first = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[first:first + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = offsets[0] if n else 0
    hi = offsets[-1] if n else 0
    return data[lo:hi], offsets - lo if n else np.zeros(1, np.int64)


def _cuts(data: np.ndarray, block: int):
    """Block ends: behind white space, or the end of the bytes."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + block, n)
        while end < n:
            look = data[end:end + 4096]
            gaps = np.flatnonzero(~_IS_WORD[look])
            if len(gaps):
                end += int(gaps[0]) + 1
                break
            end = min(end + 4096, n)
        yield at, end
        at = end


def word_hashes(column, lower: bool = False, spans: bool = False):
    """``(hash of every word, words per text)`` of an Arrow string column.

    ``lower`` folds A-Z.  ``spans`` adds the byte start and end of every word in
    the flat bytes.
    """
    data, offsets = flat(column)
    table = _BYTE_LOWER if lower else _BYTE
    marks = offsets[:-1][np.diff(offsets) > 0]           # first byte of each non-empty text
    hashes, starts, ends = [], [], []
    for lo, hi in _cuts(data, BLOCK):
        b = data[lo:hi]
        w = _IS_WORD[b]
        first = w.copy()
        first[1:] &= ~w[:-1]
        a, z = np.searchsorted(marks, [lo, hi])
        at = marks[a:z] - lo
        first[at[w[at]]] = True                          # a new text starts a new word
        s = np.flatnonzero(first)
        if not len(s):
            continue
        last = w.copy()
        last[:-1] &= ~w[1:] | first[1:]
        e = np.flatnonzero(last) + 1
        size = e - s
        pos = np.flatnonzero(w)
        bounds = np.cumsum(size) - size
        within = np.arange(len(pos)) - np.repeat(bounds, size)
        p = powers(int(size.max()))
        h = np.add.reduceat(table[b[pos]] * p[within], bounds)
        hashes.append(mix(h ^ (size.astype(np.uint64) << np.uint64(56))))
        starts.append(s + lo)
        ends.append(e + lo)
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    h, s = cat(hashes, np.uint64), cat(starts, np.int64)
    counts = np.diff(np.searchsorted(s, offsets))
    return (h, counts, s, cat(ends, np.int64), data, offsets) if spans else (h, counts)


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of ``h[i:i+k]`` for every i (``len(h) - k + 1`` of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    p = powers(k)
    out = np.zeros(n, np.uint64)
    if k <= 8:
        for j in range(k):
            out += h[j:j + n] * p[j]
        return mix(out)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    for lo in range(0, n, 1 << 16):                      # prefix sums per stretch: short power tables
        part = h[lo:lo + (1 << 16) + k - 1]
        up = powers(len(part) + 1)
        total = np.concatenate(([np.uint64(0)], np.cumsum(part * up[:len(part)], dtype=np.uint64)))
        m = len(part) - k + 1
        out[lo:lo + m] = (total[k:k + m] - total[:m]) * powers(m, inverse)
    return mix(out)


def groups(batch, size: int = 1 << 22, column: str = "text"):
    """Row slices of an Arrow batch with about ``size`` bytes of text (one row at least)."""
    data = batch.column(batch.schema.get_field_index(column))
    n = len(data)
    if not n:
        return
    lengths = np.asarray(pc.binary_length(data.cast(pa.large_string())).fill_null(0))
    lo, acc = 0, 0
    for i, x in enumerate(lengths.tolist()):
        if i > lo and acc + x > size:
            yield batch.slice(lo, i - lo)
            lo, acc = i, 0
        acc += x
    yield batch.slice(lo)
