"""Word scanning and rolling hashes over Arrow string columns, vectorised with numpy.

Everything works on *pieces*: runs of whole rows with about a megabyte of text, so memory in a
Python worker follows the longest single text and not the size of an Arrow batch.

A word's hash is a polynomial over its bytes modulo 2**64, taken from one cumulative sum over the
piece; a k-gram's hash is the same over word hashes. Both are equal for equal content wherever it
stands, in any process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

ASCII_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def separator_table(separators: bytes) -> np.ndarray:
    """256 booleans: whether a byte belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words are runs of anything but ASCII white space.
PLAIN = separator_table(ASCII_SPACE)
#: Words are runs of ASCII digits, letters and everything beyond ASCII.
ALNUM = separator_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n (at least) powers of base and of its inverse, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(1 << 16, 1 << (int(n) - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words:
    """The words of some rows: byte range and row of each, and where each row's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = table[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = False
            np.logical_and(inside[:-1], ~edge[1:n], out=before[1:])
            np.logical_and(inside[1:], ~edge[1:n], out=after[:-1])
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = powers(_BYTE_BASE, n + 1)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum((self.data.astype(U) + U(1)) * up[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def same_row(self, k: int) -> np.ndarray:
        """Whether the k words from each place on (as far as k words follow) are of one row."""
        n = len(self) - k + 1
        return self.row[:n] == self.row[k - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def span_sums(h: np.ndarray) -> np.ndarray:
    up, _ = powers(_WORD_BASE, len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from start to end, given span_sums of their hashes."""
    _, down = powers(_WORD_BASE, len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def kgrams(h: np.ndarray, k: int, sums: np.ndarray | None = None) -> np.ndarray:
    """The hash of the k words from each place on, as far as k words follow."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    sums = span_sums(h) if sums is None else sums
    _, down = powers(_WORD_BASE, len(sums))
    return mix((sums[k:] - sums[:n]) * down[:n])


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return body, at - at[0]


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about `size` bytes of text: (rows, their bytes, row offsets)."""
    data, offsets = raw(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, n, at + 65536)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def scan(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN, lower: bool = False) -> Words:
    return Words(LOWER[data] if lower else data, offsets, table)


def sliding_min(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each window of `width`, and where it first stands."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0], np.zeros(0, dtype=np.int64)
    best, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best = np.where(take, right, left)
        at = np.where(take, at[step:], at[: len(at) - step])
        have += step
    return best[:n], at[:n]
