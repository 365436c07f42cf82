"""Vectorised text primitives shared by the Arrow operators.

Everything works on the UTF-8 bytes of an Arrow string column: one ``uint8``
buffer and one offset per document.  Words are found with a byte table, hashed
with a polynomial over 2**64 (prefix sums, so the cost per byte does not depend
on word length) and rolled into k-gram hashes the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; scratch arrays are about 30 times as large.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F | 1)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xA24BAED4963EE407))


def _inverse(x: np.uint64) -> np.uint64:
    return _U(pow(int(x), -1, 1 << 64))


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inv, self.n = base, _inverse(base), 0
        self.up = self.down = np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            m = max(1024, 1 << (n - 1).bit_length())
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inv)):
                    out = np.full(m, b, np.uint64)
                    out[0] = 1
                    setattr(self, name, np.multiply.accumulate(out))
            self.n = m
        return self.up, self.down


_BYTE_POW, _GRAM_POW = _Powers(_BASE), _Powers(_GRAM)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Word bytes of ``[^\x20\x09-\x0D]+``.
WORD_BYTES = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Identity and A-Z to a-z.
KEEP_CASE = np.arange(256, dtype=np.uint8)
FOLD_CASE = KEEP_CASE.copy()
FOLD_CASE[65:91] += 32


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length n + 1, from 0) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents [a, b) of about ``limit`` bytes; a longer one stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the word offsets of each document."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    w = table[buf]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    full = offsets[1:] > offsets[:-1]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    first[head], last[tail] = w[head], w[tail]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = KEEP_CASE, seed: int = 0) -> np.ndarray:
    """One 64-bit hash per word, from its (folded) bytes."""
    out = np.empty(len(starts), np.uint64)
    code = mix64(BYTE_CODE + _U(seed)) if seed else BYTE_CODE
    code = code[fold]
    a = 0
    while a < len(starts):
        lo = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, lo + CHUNK_BYTES, "right")))
        hi = int(ends[b - 1])
        up, down = _BYTE_POW.get(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(code[buf[lo:hi]] * up[: hi - lo], out=total[1:])
        out[a:b] = (total[ends[a:b] - lo] - total[starts[a:b] - lo]) * down[starts[a:b] - lo]
        a = b
    return mix64(out)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 places have none."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out, step = np.empty(m, np.uint64), 1 << 18
    for a in range(0, m, step):
        b = min(m, a + step)
        part = h[a : b + k - 1]
        up, down = _GRAM_POW.get(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[a:b] = (total[k : k + b - a] - total[: b - a]) * down[: b - a]
    return mix64(out)


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence, of any length."""
    return gram_hashes(h, len(h))[0] ^ _U(len(h)) if len(h) else _U(0)


def spans(lengths: np.ndarray) -> np.ndarray:
    """0 .. length - 1 for each length, one after another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def strings_at(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(buf)))
