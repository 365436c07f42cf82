"""Texts as arrays of code points, for what column expressions would do character by character."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

U = np.uint64
_BASES = (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03))


def members(char_class: str) -> np.ndarray:
    """True for the code points below 0x10000 that a character class of the column expressions holds."""
    c = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{m[1]}", char_class))
    return np.fromiter((c.fullmatch(chr(i)) is not None for i in range(0x10000)), bool, 0x10000)


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and each text's first and the end; nulls are empty."""
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if col.buffers()[2] is not None else np.empty(0, np.uint8)
    codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return codes, lead[off - off[0]]


def stretches(edges: np.ndarray, limit: int = 1 << 20):
    """Runs of texts [a, b) of about ``limit`` code points; a longer text stands alone."""
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + limit, "right")) - 1)
        yield a, b
        a = b


def without(codes: np.ndarray, edges: np.ndarray, leave_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points that ``leave_out`` does not hold, and the new edges."""
    keep = ~leave_out[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    return codes[keep], np.concatenate(([0], np.cumsum(keep)))[edges]


def distinct_pairs(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many different pairs of neighbouring code points each text has."""
    n = len(edges) - 1
    text = np.repeat(np.arange(n), np.diff(edges))
    if len(codes) < 2:
        return np.zeros(n, np.int64)
    inside = np.flatnonzero(text[1:] == text[:-1])
    seen, small = np.unique(codes, return_inverse=True)
    key = np.unique((text[inside] * len(seen) + small[inside]) * len(seen) + small[inside + 1])
    return np.bincount(key // (len(seen) * len(seen)), minlength=n)


class Rolling:
    """Two polynomial hashes over 2**64 of any stretch of a sequence, from prefix sums."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums, self.down = [], []
        for base in _BASES:
            up = np.full(n + 1, base, U)
            up[0] = 1
            np.multiply.accumulate(up, out=up)
            down = np.full(n + 1, U(pow(int(base), -1, 1 << 64)), U)
            down[0] = 1
            np.multiply.accumulate(down, out=down)
            self.sums.append(np.concatenate((np.zeros(1, U), np.cumsum((codes.astype(U) + U(1)) * up[:n]))))
            self.down.append(down)

    def of(self, start: np.ndarray, length, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return (s[start + length] - s[start]) * self.down[which][start]
