"""Hashed sparse text features as index arrays, for the linear models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._words import ALNUM, CHUNK, LOWER, RINGS, U, buffers, chunks, mix, spans

BITS = 18
MARK = np.ones(256, bool)
MARK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
SHAPE = np.zeros(256, np.uint8)
SHAPE[ord("a") : ord("z") + 1], SHAPE[ord("A") : ord("Z") + 1], SHAPE[ord("0") : ord("9") + 1], SHAPE[0x80:] = 1, 2, 3, 1


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A small number for each token: which kinds of characters it has, its first and last kind, and its length class."""
    kind = SHAPE[data]
    out = np.minimum(end - start, 15).astype(np.int64)
    for k in range(4):
        seen = np.concatenate([[0], np.cumsum(kind == k)])
        out = out << 1 | (seen[end] > seen[start])
    return (out << 4 | kind[start] << 2 | kind[end - 1]).astype(U)


def word_grams(column: pa.Array, bits: int = BITS, shapes: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its sorted distinct feature indices and their weights.

    Features are hashed one- and two-word grams of lower-cased words (letters and digits), and, if `shapes`, one- to
    three-grams of the shapes of tokens between white space, and repeats of the token before. A feature's weight is
    1 + log of its count, and the row has length 1. An empty text has no features.
    """
    data, off = buffers(column)
    size = U((1 << bits) - 1)
    for i, j in chunks(off, CHUNK // 2):
        raw = data[off[i] : off[j]]
        rows = off[i : j + 1] - off[i]
        piece = LOWER[raw]
        start, end, first = spans(piece, rows, ALNUM)
        words = RINGS[0].words(piece, start, end)
        parts = [(words, np.arange(len(words)))]
        if len(words) > 1:
            parts.append((mix(words[:-1] * U(3) + words[1:]), np.arange(len(words) - 1)))
        if shapes:
            s, e, f = spans(raw, rows, MARK)
            tokens, shape = RINGS[1].words(raw, s, e), _shapes(raw, s, e)
            again = np.zeros(len(tokens), U)
            again[1:] = tokens[1:] == tokens[:-1]
            again[f[:-1][f[:-1] < len(tokens)]] = 0  # a row's first token repeats none of the row before
            one = shape * U(2) + again
            grams = [mix(one + U(0x100000))]
            for n in (2, 3):
                if len(one) >= n:
                    grams.append(mix(grams[-1][:-1] * U(5) + one[n - 1 :] + U(n << 24)))
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            own = [h[a : max(a, b - k)] for k, (h, _) in enumerate(parts)]
            if shapes:
                own += [g[f[r] : max(f[r], f[r + 1] - k)] for k, g in enumerate(grams)]
            index, count = np.unique((np.concatenate(own) & size).astype(np.int32), return_counts=True)
            weight = 1.0 + np.log(count)
            norm = np.sqrt((weight * weight).sum())
            yield index, weight / norm if norm else weight
