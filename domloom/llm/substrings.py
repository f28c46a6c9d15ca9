"""Substring deduplication on a De Bruijn graph of words.

Every window of `window` words is an edge between two nodes, its first and its last `window` - 1 words. Consecutive windows
of a document that share an anchor (their smallest k-gram) are one segment, an edge from the head node of its first window to
the tail node of its last; segments are short enough for the two nodes to hold all of their words. Equal segments meet by
(head, tail, length) in one shuffle, and all but the first are repeats as a whole. Where several unlike segments share an
anchor the graph branches: a count by anchor finds those, a join brings them back, and they are taken apart into single edges,
which meet by (head, tail) in the same way. Repeats carry the coordinates of a source. Neighbours on one diagonal compact into
spans, in the batch or after the join that gathers a document's repeats, and each span's words are compared with the words
that stand at its source's coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import durable
from ._words import RINGS, SPACE, U, buffers, chunks, mix, signed, spans

ANCHOR = 5
SALTS = 64
EDGES = "anchor long, head long, tail long, n int, id long, start int, src long, at int"
SPANS = "id long, start int, n int, src long, at int, digest binary"


def anchors(hashes: np.ndarray, doc: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `window` words: its start, and the place of its smallest k-gram (the last one of equals).

    hashes are of the words, doc is the row of each word; windows don't cross rows. Text alone decides on the place, so
    equal windows have equal k-grams at equal distances.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        z = np.empty(0, np.int64)
        return z, z
    ring = RINGS[1]
    at = np.arange(len(hashes) - k + 1)
    grams = ring.between(ring.sums(hashes), at, at + k)
    best, place = grams[:n].copy(), np.arange(n)
    for step in range(1, window - k + 1):
        other = grams[step : step + n]
        less = other <= best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + step
    start = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return start, place[start]


def _edges(anchor: np.ndarray, head: np.ndarray, tail: np.ndarray, n: np.ndarray, ids: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Pre-aggregation: of equal edges the first in the batch goes on under its key. The others are repeats of it; they travel
    under keys of their own, and those that follow one another on a diagonal of one source are one row."""
    order = np.lexsort((start, ids, n, tail, head))
    anchor, head, tail, n, ids, start = (x[order] for x in (anchor, head, tail, n, ids, start))
    opens = np.ones(len(n), bool)
    opens[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]) | (n[1:] != n[:-1])
    first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    later = (ids != ids[first]) | (start != start[first])
    of = first[later]
    runs = _compacted(start[later], n[later], ids[of], start[of], ids[later])
    keep = ~later
    none = np.zeros(int(keep.sum()), bool)
    spread = signed(mix(runs[4].view(U) * U(31) + runs[0].astype(np.int64).view(U)))
    zero = np.zeros(len(spread), np.int64)
    sent = np.concatenate([~none, np.zeros(len(spread), bool)])
    columns = [
        np.concatenate([x[keep], y])
        for x, y in ((anchor, zero), (head, spread), (tail, zero), (n, runs[1]), (ids, runs[4]), (start, runs[0]), (ids, runs[2]), (start, runs[3]))
    ]
    types = (np.int64, np.int64, np.int64, np.int32, np.int64, np.int32, np.int64, np.int32)
    arrays = [pa.array(c.astype(t), mask=sent if k > 5 else None) for k, (c, t) in enumerate(zip(columns, types, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, ["anchor", "head", "tail", "n", "id", "start", "src", "at"])


def _compacted(start: np.ndarray, n: np.ndarray, src: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Repeats (window starts start..start+n of a document, equal to those from `at` of src) that touch on a diagonal, as one."""
    start, n, at = start.astype(np.int64), n.astype(np.int64), at.astype(np.int64)
    order = np.lexsort((start, at - start, src, ids))
    start, n, src, at, ids = (x[order] for x in (start, n, src, at, ids))
    if not len(start):
        return start, n, src, at, ids
    end = start + n
    new = np.ones(len(start), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (src[1:] != src[:-1]) | (at[1:] - start[1:] != at[:-1] - start[:-1]) | (start[1:] > end[:-1])
    head = np.flatnonzero(new)
    return start[head], np.maximum.reduceat(end, head) - start[head], src[head], at[head], ids[head]


def _segments(window: int, k: int):
    """Rows (id, text) to segments: windows in a row that share an anchor, as edges between nodes of window - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = RINGS[0]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = buffers(batch.column(1))
            parts = []
            for i, j in chunks(off):
                piece = data[off[i] : off[j]]
                start, end, first = spans(piece, off[i : j + 1] - off[i], SPACE)
                words = RINGS[1].words(piece, start, end)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                at, place = anchors(words, doc, k, window)
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(at)))
                begin, where = at[head], place[head]
                anchor = RINGS[1].between(RINGS[1].sums(words), where, where + k)
                sums = ring.sums(ring.words(piece, start, end))
                nodes = (signed(ring.between(sums, x, x + window - 1)) for x in (begin, begin + n))
                parts.append((signed(anchor), *nodes, n, ids[i:j][doc[begin]].astype(np.int64), begin - first[doc[begin]]))
            if parts:
                yield _edges(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def _single(window: int):
    """Rows (id, text, at: [(start, n)]) to single windows as edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = RINGS[0]
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(2)
            data, off = buffers(batch.column(1))
            bounds = lists.offsets.to_numpy()
            starts, counts = (lists.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
            parts = []
            for r in range(len(batch)):
                piece = data[off[r] : off[r + 1]]
                s, e, _ = spans(piece, np.array([0, len(piece)]), SPACE)
                a, n = starts[bounds[r] : bounds[r + 1]], counts[bounds[r] : bounds[r + 1]]
                begin = np.unique(np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum()))
                begin = begin[begin + window <= len(s)]
                if len(begin):
                    sums = ring.sums(ring.words(piece, s, e))
                    nodes = [signed(ring.between(sums, x, x + window - 1)) for x in (begin, begin + 1)]
                    parts.append((np.zeros(len(begin), np.int64), *nodes, np.ones(len(begin), np.int64), np.full(len(begin), ids[r], np.int64), begin))
            if parts:
                yield _edges(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def _met(edges: DataFrame) -> DataFrame:
    """edges with the coordinates of an earlier equal one in src and at; null where there is none.

    An edge has one row a batch at most, whatever the number of its copies, and rows of a key stream through the window in
    order: neither a hot edge nor a hot anchor is held.
    """
    w = Window.partitionBy("head", "tail", "n").orderBy("id", "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = edges.withColumn("f_id", F.first("id").over(w)).withColumn("f_start", F.first("start").over(w))
    later = (F.col("id") != F.col("f_id")) | (F.col("start") != F.col("f_start"))
    src, at = F.coalesce("src", F.when(later, F.col("f_id"))), F.coalesce("at", F.when(later, F.col("f_start")))
    return df.select("anchor", "id", "start", "n", src.alias("src"), at.alias("at"))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _spans(window: int):
    """Rows (id, text, at: [(start, n, src, at)]) to spans: windows on one diagonal of one source that touch, with a digest
    of the span's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            lists = batch.column(2)
            data, off = buffers(batch.column(1))
            raw, at = data.tobytes(), lists.offsets.to_numpy()
            start, n, src, source = (lists.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n", "src", "at"))
            out: list[tuple] = []
            for r, i in enumerate(ids):
                part = slice(at[r], at[r + 1])
                words = raw[off[r] : off[r + 1]].split()
                a, size, c, d, _ = _compacted(start[part], n[part], src[part], source[part], np.zeros(part.stop - part.start, np.int64))
                for s, e, x, y in zip(a.tolist(), (a + size).tolist(), c.tolist(), d.tolist(), strict=True):
                    if e + window - 1 <= len(words):
                        out.append((i, s, e - s, x, y, _digest(words[s : e + window - 1])))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["id", "start", "n", "src", "at", "digest"])

    return run


def _differing(window: int):
    """Rows (src, at, n, digest, text) of spans and the texts of their sources: those whose words differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad, text, words = [], None, []
            places, sizes, digests = (batch.column(k).to_pylist() for k in (1, 2, 3))
            data, off = buffers(batch.column(4))
            raw = data.tobytes()
            for r in range(len(batch)):
                own = raw[off[r] : off[r + 1]]
                if own != text:
                    text, words = own, own.split()
                if _digest(words[places[r] : places[r] + sizes[r] + window - 1]) != digests[r]:
                    bad.append(r)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(bad, pa.int64())) for k in range(4)], ["src", "at", "n", "digest"])

    return run


def _cut(window: int):
    """Rows (id, text, at: [(start, n)]) to (id, n_words, n_removed, text): words that a listed window covers go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2).to_pylist()
            data, off = buffers(batch.column(1))
            raw = data.tobytes()
            total, gone, kept = [], [], []
            for r, at in enumerate(lists):
                words = raw[off[r] : off[r + 1]].split()
                total.append(len(words))
                if at:
                    edge = np.zeros(len(words) + 1, np.int32)
                    a = np.array([x["start"] for x in at])
                    np.add.at(edge, np.minimum(a, len(words)), 1)
                    np.add.at(edge, np.minimum(a + np.array([x["n"] for x in at]) + window - 1, len(words)), -1)
                    words = [words[x] for x in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), text], ["id", "n_words", "n_removed", "text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 20, anchor: int = ANCHOR) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, text (the kept words, joined by one space).

    Words are runs of bytes other than ASCII white space, unchanged. A word goes if a window of `window` consecutive words
    covers it whose word sequence also starts earlier: in a document of a smaller id, or earlier in the same one. Windows
    are judged on the input.

    Scale. A document sends one row for each segment, about a ninth of its words at 20 words and anchors of 5; batches are
    combined first, so that a passage shared by a third of all rows sends one row a batch to its key. Keys are whole segments
    and windows; an anchor is a key of a partially aggregated count and of an equi join only, which AQE splits. Spans of one
    source are made distinct before they meet its text, in an equi join that AQE splits where a source is hot. A span whose
    words differ from its source's is no repeat.

    Edge cases. Null, empty or short texts: nothing goes. Rows that share an id are one document: an equal text at the same
    start is not earlier, and what goes from one goes from all; if their texts differ, spans that a source's text doesn't bear out
    stay. Rows without an id lose nothing and are no source.
    """
    if not 2 <= anchor < window:
        raise ValueError("an anchor has two words or more, and fewer than a window")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = texts.where("id IS NOT NULL")
    found = durable(_met(known.mapInArrow(_segments(window, anchor), EDGES)), "segments")

    lone = found.where("src IS NULL")
    branching = lone.groupBy(F.col("anchor").alias("b_anchor")).count().where("count > 1").select("b_anchor")
    branch = lone.join(branching, F.col("anchor") == F.col("b_anchor")).groupBy(F.col("id").alias("b_id")).agg(F.collect_list(F.struct("start", "n")).alias("at"))
    single = known.join(branch, F.col("id") == F.col("b_id")).select("id", "text", "at").mapInArrow(_single(window), EDGES)
    columns = ("id", "start", "n", "src", "at")
    repeats = found.union(_met(single)).where("src IS NOT NULL").select(*columns)
    listed = repeats.groupBy(F.col("id").alias("r_id")).agg(F.collect_list(F.struct("start", "n", "src", "at")).alias("at"))
    spans = durable(known.join(listed, F.col("id") == F.col("r_id")).select("id", "text", "at").mapInArrow(_spans(window), SPANS), "spans")

    key = ("src", "at", "n", "digest")
    named = spans.select(*key).distinct()
    bad = named.join(known, F.col("src") == F.col("id")).select(*key, "text").mapInArrow(_differing(window), "src long, at int, n int, digest binary").distinct()
    # A passage's copies are one key; salt deals them over several tasks, and what they meet is next to nothing.
    salted = spans.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(SALTS)).cast("int"))
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    good = salted.join(bad, [*key, "salt"], "left_anti").groupBy(F.col("id").alias("g_id")).agg(F.collect_list(F.struct("start", "n")).alias("at"))
    out = texts.join(good, F.col("id") == F.col("g_id"), "left").select("id", "text", "at").mapInArrow(_cut(window), "id long, n_words long, n_removed long, text string")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
