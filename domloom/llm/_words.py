"""Vectorised word splitting and hashing over the raw bytes of Arrow string columns.

A word hash is a polynomial in the word's bytes modulo 2**64, read off one running sum over the buffer, then mixed.
Everything is deterministic, so a task that runs again on another executor yields the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PIECE = 1 << 19
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two xor-shift-multiply rounds."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x632BE59BD9B4E019 % (1 << 64)))


class Ring:
    """Powers of an odd base and of its inverse modulo 2**64, and a random value for each byte."""

    def __init__(self, seed: int):
        values = randoms(258, seed)
        self.base = int(values[256]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.byte = values[:256]
        self.up = self.down = np.ones(1, U)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]))
            with np.errstate(over="ignore"):
                self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up, self.down

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Running sums of values times powers; one longer than values."""
        up, _ = self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], the same wherever it stands."""
        _, down = self.powers(len(sums))
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each word data[start:end]; words are in order and don't overlap. Bounded memory: PIECE bytes at once."""
        out, i, n = np.empty(len(start), U), 0, len(start)
        while i < n:
            a = int(start[i])
            j = max(i + 1, int(np.searchsorted(end, a + PIECE, "right")))
            sums = self.sums(self.byte[data[a : int(end[j - 1])]])
            out[i:j] = self.between(sums, start[i:j] - a, end[i:j] - a)
            i = j
        return out


RINGS = (Ring(1), Ring(2))

SPACE = np.ones(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = ALNUM[ord("A") : ord("Z") + 1] = ALNUM[ord("a") : ord("z") + 1] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows, of at most limit bytes or one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the number of words before it (n + 1 values). A word never crosses rows."""
    if not len(data):
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = member[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
