"""Toxicity severity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._features import BITS
from ._words import ALNUM, LOWER, RINGS, U, buffers, chunks, mix, randoms, signed, spans
from .minhash import shingle_sets

SAMPLE = 16_000
EPOCHS = 400
GRADES = 4
#: Parts of the labelled texts; a text's grade comes from the model of the others.
FOLDS = 5
#: Of the marked words, the share that may be chance.
FDR = 0.05
#: Lengths in bytes of the word beginnings that are features.
STEMS = (4, 5, 6, 8)


def counts(column: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted distinct hashed features and how often each occurs; none for a text without words.

    Features are lower-cased words, and the first bytes of longer words, so that forms of one stem teach together.
    """
    data, off = buffers(column)
    mask = U((1 << bits) - 1)
    for i, j in chunks(off):
        piece = LOWER[data[off[i] : off[j]]]
        start, end, first = spans(piece, off[i : j + 1] - off[i], ALNUM)
        found = [RINGS[0].words(piece, start, end) & mask]
        for n in STEMS:
            stem = mix(RINGS[1].words(piece, start, np.minimum(end, start + n)) + U(n)) & mask
            found.append(np.where(end - start > n, stem, found[0]))
        found = np.stack(found).astype(np.int64)
        for r in range(j - i):
            block = found[:, first[r] : first[r + 1]]
            index, times = np.unique(block, return_counts=True)
            yield index, times


def _tails(bad: np.ndarray, seen: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    """P(at least `bad` of `seen` texts have label 1), were the n[0] and n[1] labels dealt at random: Fisher's exact test."""
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n[0] + n[1] + 1)))])
    choose = lambda m, k: log[m] - log[k] - log[m - k]
    pairs, back = np.unique(np.stack([bad, seen]), axis=1, return_inverse=True)
    p = np.empty(pairs.shape[1])
    for i, (k, m) in enumerate(pairs.T):
        j = np.arange(max(k, m - n[0]), min(m, n[1]) + 1)
        p[i] = np.exp(choose(n[1], j) + choose(n[0], m - j) - choose(n[0] + n[1], m)).sum()
    return p[back.reshape(-1)]


def _markers(index: list[np.ndarray], toxic: np.ndarray, bits: int) -> np.ndarray:
    """Log odds of each hashed word between the two labels, where label 1 has significantly more of it; 0 elsewhere.

    The test is exact and on absolute counts, so a word needs no share of the labels: the same few texts mark it however many
    others there are of other languages or sources. The false discovery rate is FDR (Benjamini-Hochberg), over the words frequent
    enough to be significant at all (Gilbert): the thousands seen once or twice don't raise the bar.
    """
    size = 1 << bits
    seen = [np.zeros(size, np.int64), np.zeros(size, np.int64)]
    for i, y in zip(index, toxic, strict=True):
        seen[int(y)][i] += 1
    n = tuple(int((toxic == y).sum()) for y in (0, 1))
    out = np.zeros(size)
    at = np.flatnonzero(seen[1])
    if not n[0] or not len(at):
        return out
    both = seen[0][at] + seen[1][at]
    least = np.sort(_tails(np.minimum(both, n[1]), both, n))
    k = 1
    while np.searchsorted(least, FDR / k, "right") > k:
        k += 1
    able = int(np.searchsorted(least, FDR / k, "right"))
    p = _tails(seen[1][at], both, n)
    rank = np.sort(p)[:able]
    passed = np.flatnonzero(rank <= FDR * np.arange(1, able + 1) / max(able, 1))
    if len(passed):
        odds = np.log((seen[1][at] + 0.5) / (n[1] + 1)) - np.log((seen[0][at] + 0.5) / (n[0] + 1))
        sure = (p <= rank[passed[-1]]) & (odds > 0)
        out[at[sure]] = odds[sure]
    return out


def _minima(sets: list[np.ndarray]) -> list[list[int]]:
    """Four minima over each set of shingles; near copies nearly always share one."""
    flips = randoms(4, 21)[:, None]
    return [signed(mix(s[None] ^ flips).min(1)).tolist() if len(s) else [] for s in sets]


def _one_of_copies(minima: list[list[int]], sets: list[np.ndarray]) -> np.ndarray:
    """Rows to learn from: a text goes if it shares a minimum with an earlier one that stays, and their shingle sets have a
    similarity of 0.8 or more. Words of one much-copied text would look like words of its label."""
    holders: dict[tuple[int, int], list[int]] = {}
    out = []
    for row, found in enumerate(minima):
        own, keys = sets[row], list(enumerate(found))
        for other in {r for key in keys for r in holders.get(key, ())}:
            a, b = sorted((len(own), len(sets[other])))
            if 5 * a >= 4 * b:
                both = len(np.intersect1d(own, sets[other], assume_unique=True))
                if 5 * both >= 4 * (a + b - both):
                    break
        else:
            out.append(row)
            for key in keys:
                holders.setdefault(key, []).append(row)
    return np.array(out, np.int64)


def held_out_scores(index: list[np.ndarray], times: list[np.ndarray], toxic: np.ndarray, bits: int) -> np.ndarray:
    """For each labelled text the score of a two-grade model fitted on the other FOLDS - 1 parts of the texts alone."""
    out, part = np.zeros(len(toxic)), np.arange(len(toxic)) % FOLDS
    for k in range(FOLDS):
        own = np.flatnonzero(part != k)
        useful = _markers([index[i] for i in own], toxic[own], bits) > 0
        rows = [_row(index[i], times[i], useful) for i in own]
        m = CumulativeLink.fit([i for i, _ in rows], [v for _, v in rows], toxic[own], 2, (1 << bits) + 2, useful=useful)
        for i in np.flatnonzero(part == k):
            out[i] = m.eta(index[i], times[i])
    return out


def grades(scores: np.ndarray, toxic: np.ndarray, levels: int) -> np.ndarray:
    """Severity grades for labelled texts: 0 where the label is 0; 1 up to levels - 1 by the score that models which haven't seen
    the text give it, cut where that splits the texts with label 1 evenly. So a grade isn't made of the words that the text
    itself has marked."""
    load = scores
    bad = toxic > 0
    out = np.zeros(len(toxic), np.int64)
    if bad.any():
        cuts = np.quantile(load[bad], np.arange(1, levels - 1) / (levels - 1)) if levels > 2 else np.empty(0)
        out[bad] = 1 + np.searchsorted(cuts, load[bad], side="right").clip(0, levels - 2)
    return out


class CumulativeLink:
    """P(grade <= k) = logistic(theta[k] - w.x): one weight vector for all of the ordered thresholds."""

    def __init__(self, weights: np.ndarray, theta: np.ndarray, useful: np.ndarray):
        self.w, self.theta, self.useful = weights, theta, useful

    def eta(self, index: np.ndarray, times: np.ndarray) -> float:
        at, value = _row(index, times, self.useful)
        return float(self.w[at] @ value) if len(at) else 0.0

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.theta[None] - np.asarray(eta)[:, None], -35, 35)))

    @staticmethod
    def fit(index: list[np.ndarray], value: list[np.ndarray], grade: np.ndarray, levels: int, size: int, epochs: int = EPOCHS, rate: float = 0.5, l2: float = 1e-6, useful: np.ndarray | None = None) -> CumulativeLink:
        """Full-batch AdaGrad on the likelihood; thresholds are a first one plus positive gaps, so they stay in order, and
        weights of marked features don't go below 0."""
        if not len(index):
            return CumulativeLink(np.zeros(size, np.float32), np.full(levels - 1, 35.0), useful)
        row = np.repeat(np.arange(len(index)), [len(i) for i in index])
        at, v = np.concatenate(index), np.concatenate(value)
        w, gw = np.zeros(size), np.full(size, 1e-8)
        share = np.clip([(grade <= k).mean() for k in range(levels - 1)], 1e-3, 1 - 1e-3)
        first = np.log(share / (1 - share))
        base = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
        gb = np.full(levels - 1, 1e-8)
        one = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
        for _ in range(epochs):
            theta = np.cumsum(np.concatenate([base[:1], np.exp(base[1:])]))
            eta = np.bincount(row, v * w[at], len(index))
            cdf = np.hstack([np.zeros((len(eta), 1)), one(theta[None] - eta[:, None]), np.ones((len(eta), 1))])
            slope = cdf * (1 - cdf)
            n = np.arange(len(eta))
            p = np.maximum(cdf[n, grade + 1] - cdf[n, grade], 1e-9)
            d_eta = (slope[n, grade + 1] - slope[n, grade]) / p
            g = np.bincount(at, v * d_eta[row], size) / len(eta) + l2 * w
            d_theta = np.array([(np.where(grade == k, slope[:, k + 1], 0) - np.where(grade == k + 1, slope[:, k + 1], 0)) @ (1 / p) for k in range(levels - 1)]) / len(eta)
            tail = np.cumsum(d_theta[::-1])[::-1]
            d_base = -np.concatenate([tail[:1], tail[1:] * np.exp(base[1:])])
            gw += g * g
            gb += d_base * d_base
            w = np.maximum(w - rate * g / np.sqrt(gw), 0.0)
            base -= 0.1 * d_base / np.sqrt(gb)
        return CumulativeLink(w.astype(np.float32), np.cumsum(np.concatenate([base[:1], np.exp(base[1:])])), useful)


def _row(index: np.ndarray, times: np.ndarray, useful: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sparse row of a text: its marked features, that it has any, and the log of how many. Presence counts, not the
    share of the text: a few insults in a long document count in full."""
    keep = useful[index]
    index, times = index[keep], times[keep]
    if not len(index):
        return index, times.astype(float)
    extra = len(useful)
    return np.append(index, [extra, extra + 1]), np.concatenate([np.full(len(index), 0.5), [1.0, np.log(times.sum())]])


def train(docs: DataFrame, labels: DataFrame, train_on: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", *, sample: int = SAMPLE, levels: int = GRADES, bits: int = BITS) -> CumulativeLink:
    """Fitted on about `sample` labelled rows where train_on holds (the documented bound), each read whole.

    Near copies teach once; the sample's shingle sets come to the driver to tell them. Only words that set the labels apart keep a feature; the rest of a text, which is most of a long document, is nothing
    that severity should grow with.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.max(label).cast("double").alias("mark"))
    marked = marked.select("key", "mark", F.xxhash64(F.col("key").cast("string")).alias("h"))
    count = marked.count()
    below = (1 << 63) - 1 if count <= sample else int(sample / count * 2.0**64) - (1 << 63)
    chosen = docs.where(train_on & F.col(text_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).join(marked.where(F.col("h") <= below), "key").select("h", "mark", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sets = list(counts(batch.column(2), bits)), list(shingle_sets(batch.column(2), 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([t.astype(np.int32) for _, t in found], pa.list_(pa.int32())), pa.array(_minima(sets), pa.list_(pa.int64())), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], ["h", "mark", "index", "times", "minima", "shingles"])

    got = chosen.mapInArrow(run, "h long, mark double, index array<int>, times array<int>, minima array<long>, shingles array<long>").toArrow().sort_by([("h", "ascending"), ("mark", "ascending")])
    arrays = lambda c: [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in got.column(c)]
    index, times, toxic = arrays("index"), arrays("times"), (got.column("mark").to_numpy() > 0).astype(np.int64)
    one = _one_of_copies(got.column("minima").to_pylist(), arrays("shingles"))
    index, times, toxic = [index[i] for i in one], [times[i] for i in one], toxic[one]
    grade = grades(held_out_scores(index, times, toxic, bits), toxic, levels)
    useful = _markers(index, toxic, bits) > 0
    rows = [_row(i, t, useful) for i, t in zip(index, times, strict=True)]
    return CumulativeLink.fit([i for i, _ in rows], [v for _, v in rows], grade, levels, (1 << bits) + 2, useful=useful)


def severity(docs: DataFrame, model: CumulativeLink, id_col: str = "doc_id", text_col: str = "text", *, bits: int = BITS) -> DataFrame:
    """One row per document: id_col, severity (expected grade), grade (the likeliest), toxic (P(grade > 0) >= 0.5).

    One pass without a shuffle; the broadcast is 2**bits floats. Null and wordless texts: severity by the thresholds alone,
    which is that of a text without marked language. Other columns are ignored, whatever their names; repeated rows each get
    their row, an empty table has none. Of equally likely grades the lower one is given. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.w, model.theta, model.useful))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = CumulativeLink(*shared.value)
        for batch in batches:
            eta = [m.eta(i, t) for i, t in counts(batch.column(1), bits)]
            above = m.above(np.array(eta)) if eta else np.zeros((0, len(m.theta)))
            p = -np.diff(np.hstack([np.ones((len(eta), 1)), above, np.zeros((len(eta), 1))]), axis=1)
            columns = [batch.column(0), pa.array(above.sum(1)), pa.array(p.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "severity", "grade", "toxic"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, severity double, grade int, toxic boolean").withColumnRenamed("id", id_col)
