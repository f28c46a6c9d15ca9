"""MinHash near-duplicate detection with tensored banding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import durable
from ._words import LOWER, RINGS, SPACE, U, buffers, chunks, mix, randoms, signed, spans

HALVES, ROWS = 20, 3
HUBS = 12
BLOCK = 512
SKETCH = 192
WIDTH = 4


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles as 64-bit hashes; a text of fewer words is one shingle."""
    data, off = buffers(column)
    ring = RINGS[0]
    for i, j in chunks(off):
        piece = LOWER[data[off[i] : off[j]]]
        start, end, first = spans(piece, off[i : j + 1] - off[i], SPACE)
        sums = ring.sums(ring.words(piece, start, end))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            at = np.arange(a, max(b - k, a) + 1 if b > a else a)
            yield np.unique(ring.between(sums, at, np.minimum(at + k, b)))


class Hasher:
    def __init__(self, halves: int, rows: int):
        self.halves, self.rows = halves, rows
        n = halves * rows
        self.flip, self.times = randoms(n, 11)[:, None], randoms(n, 12)[:, None] | U(1)

    def halfkeys(self, hashes: np.ndarray) -> list[int]:
        """halves numbers, each of rows minima cut to 16 bits."""
        low = np.full(self.halves * self.rows, np.iinfo(U).max, U)
        with np.errstate(over="ignore"):
            for i in range(0, len(hashes), 4096):
                np.minimum(low, ((hashes[None, i : i + 4096] ^ self.flip) * self.times).min(1), out=low)
        cut = (mix(low) & U(0xFFFF)).astype(np.int64).reshape(self.halves, self.rows)
        out = cut[:, 0].copy()
        for r in range(1, self.rows):
            out = out << 16 | cut[:, r]
        return out.tolist()


def _signatures(k: int, halves: int, rows: int):
    """Rows (id, text) to the size of the set, a cryptographic digest of the sequence of lower-cased words, and the half-keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(halves, rows)
        for batch in batches:
            n, keys, digests = [], [], []
            data, off = buffers(batch.column(1))
            for r, s in enumerate(shingle_sets(batch.column(1), k)):
                n.append(len(s))
                words = LOWER[data[off[r] : off[r + 1]]].tobytes().split()
                digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                keys.append(hasher.halfkeys(s) if len(s) else [])
            halves_of = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            arrays = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(halves_of[:, 0]), pa.array(halves_of[:, 1]), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "d1", "d2", "keys"])

    return run


def _verified(k: int, percent: int):
    """Of rows (a, b, text_a, text_b): the pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return run


def _sketches(k: int, size: int):
    """Rows (node, text) to (node, n, sketch): the set's size and its `size` smallest hashes, cut to 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                out.append((s[:size] & U(0xFFFF)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(out, pa.binary())], ["node", "n", "sketch"])

    return run


def _shared(sketches: list[np.ndarray]) -> np.ndarray:
    """How many values each two sketches share, by products of 0-1 matrices over slices of the values."""
    row = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
    values, column = np.unique(np.concatenate(sketches), return_inverse=True)
    out = np.zeros((len(sketches), len(sketches)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, len(values), 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        part = np.zeros((len(sketches), min(4096, len(values) - low)), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def _unresolved(size: int, percent: int):
    """Of rows (bucket, x, y, one, two, side, node, comp, n, sketch, keys) in order of groups: likely pairs across components.

    A group is a bucket's block or pair of blocks, so its size is bounded. Sketches of whole sets give the similarity
    itself, others bound it to 4.5 standard deviations; the pairs left are few and are verified on full sets. A pair comes
    out of the first table that holds both (one and two are the table's half-keys), and so once.
    """

    def pairs(one, two, side, node, comp, n, sketch, keys) -> Iterator[tuple[int, int]]:
        shared = _shared([np.frombuffer(s, "<u2") for s in sketch]) + 3
        most = np.maximum(n[:, None], n[None]).astype(np.float64)
        both = np.where(most > size, np.minimum(1.0, (shared + 4.5 * (size * 0.16) ** 0.5) / size) * most, shared)
        both = np.minimum(both, np.minimum(n[:, None], n[None]))
        likely = (100 * both >= percent * (n[:, None] + n[None] - both)) & (comp[:, None] != comp[None])
        if (side != side[0]).any():
            likely &= side[:, None] != side[None]
        i, j = np.nonzero(np.triu(likely, 1))
        for a in range(0, len(i), 65536):
            u, v = i[a : a + 65536], j[a : a + 65536]
            same = keys[u] == keys[v]
            first = same.argmax(1)
            same[np.arange(len(u)), first] = False
            here = (first == one) & (same.argmax(1) == two)
            yield from zip(np.minimum(node[u], node[v])[here].tolist(), np.maximum(node[u], node[v])[here].tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            left = None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                left = t if left is None else pa.concat_tables([left, t])
                if not len(left):
                    continue
                key = np.stack([left.column(c).to_numpy() for c in ("bucket", "x", "y")])
                cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
                for a, b in zip([0, *cut[:-1]], cut, strict=False):
                    yield left.slice(a, b - a)
                left = left.slice(cut[-1]) if len(cut) else left
            if left is not None and len(left):
                yield left

        found: set[tuple[int, int]] = set()
        for g in groups():
            if len(g) < 2:
                continue
            keys = g.column("keys").combine_chunks().flatten().to_numpy().reshape(len(g), -1)
            found.update(pairs(*(g.column(c)[0].as_py() for c in ("one", "two")), *(g.column(c).to_numpy() for c in ("side", "node", "comp", "n")), g.column("sketch").to_pylist(), keys))
            if len(found) >= 10_000:
                yield _pairs(found)
                found = set()
        yield _pairs(found)

    return run


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _blocks(placed: DataFrame) -> DataFrame:
    """Members (bucket, one, two, node, comp) of buckets with several components, dealt into groups (bucket, x, y) that hold
    each two members of different components together, and no more than two blocks.

    A bucket's largest component is compared with the others alone, never with itself: its members go once to each block of the
    others, and those to every block. So a bucket of a million with one stray costs about its size, and in general its size
    times the number of blocks that lie outside its largest component.
    """
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    members = placed.join(open_, "bucket")
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all")).select("bucket", F.col("top.comp").alias("main"), F.col("top.c").alias("most"), "all")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    members = members.join(main, "bucket").withColumn("inner", F.col("comp") == F.col("main")).withColumn("nm", blocks(F.col("most"))).withColumn("nr", blocks(F.col("all") - F.col("most")))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    members = members.withColumn("mine", F.when(F.col("inner"), deal(F.col("nm"))).otherwise(F.col("nm") + deal(F.col("nr"))))
    members = members.withColumn("other", F.explode(F.sequence(F.when(F.col("inner"), F.col("nm")).otherwise(F.lit(0)), F.col("nm") + F.col("nr") - 1)))
    return members.select("bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "one", "two", F.col("mine").alias("side"), "node", "comp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document is the set of its `shingle`-word
    shingles. Documents whose sets have a Jaccard similarity of at least percent / 100 are linked; component_id is the
    smallest id reachable.

    Method. `halves` half-keys of `rows` minima each; every pair of half-keys is a table key, so halves * (halves - 1) / 2
    tables of 2 * rows minima cost halves * rows hash functions. Rows whose lower-cased words are the same sequence, by a
    cryptographic digest of 128 bits, are one class from the start; every other link is confirmed on full sets.
    Half-keys that one class alone has can't lead to a partner and go first. In each bucket a pseudo-random pivot stands
    for the rest; up to HUBS pivots of a class are verified on full sets and components contracted. Then all pairs of a
    bucket that still lie in different components are compared, in blocks and by sketches inside the task, and the likely
    ones verified on full sets; a bucket's largest component isn't compared with itself. So a large bucket of similar documents
    costs about its size, not its square.
    A pair at exactly 0.8 shares no table with a chance of 1.3e-5 (20 half-keys of 3), one at 0.85 of 3e-8.

    Edge cases. Null or wordless texts: n_shingles 0, linked with nothing, component_id their own id. Rows that share an id
    are one document. A null id takes part as a copy only; it is kept if its class has no id at all. Other columns are
    ignored, whatever their names.
    """
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = durable(rows_in.mapInArrow(_signatures(shingle, halves, rows), "id long, n long, d1 long, d2 long, keys array<long>"), "signatures")
    full = sig.where("n > 0")
    classes = durable(full.groupBy("d1", "d2", "n").agg(F.min("id").alias("node"), F.first("keys").alias("keys")).where("node IS NOT NULL"), "classes")

    half = classes.select("node", F.explode(F.transform("keys", lambda v, i: F.struct(i.alias("i"), v.alias("v")))).alias("key"))
    shared = half.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    live = half.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("h")).where("size(h) > 1")
    live = durable(live, "live-keys")
    tables = F.flatten(F.transform("h", lambda x, i: F.transform(F.slice("h", i + 2, F.size("h")), lambda y: F.struct(x["i"].alias("one"), y["i"].alias("two"), F.xxhash64(x["i"], x["v"], y["i"], y["v"]).alias("bucket")))))
    buckets = live.select("node", F.explode(tables).alias("t")).select("node", "t.*")

    texts = durable(
        # Sorted on both sides at any size: neither side is bounded, so neither is ever broadcast.
        rows_in.join(live.select(F.col("node").alias("id")).hint("merge"), "id", "left_semi").dropDuplicates(["id", "text"]).select(F.col("id").alias("node"), "text"), "candidates"
    )

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        return durable(pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(_verified(shingle, percent), "a long, b long"), "links")

    order = F.struct(F.xxhash64("node", "bucket"), "node")
    pivot = buckets.groupBy("bucket").agg(F.min(order).alias("p"), F.count("*").alias("c")).where("c > 1").select("bucket", F.col("p.node").alias("pivot"))
    met = durable(buckets.join(pivot, "bucket").select("bucket", "one", "two", "node", "pivot"), "buckets")
    times = met.where("node <> pivot").groupBy("node", "pivot").count()
    best = times.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "pivot")), False), 1, HUBS).alias("p"))
    first = best.select("node", F.explode("p.pivot").alias("pivot")).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = verify(first)
    root = components(links)

    placed = met.join(root, "node", "left").select("bucket", "one", "two", "node", F.coalesce("root", "node").alias("comp"))
    rest = _blocks(placed)
    sketches = texts.mapInArrow(_sketches(shingle, SKETCH), "node long, n int, sketch binary")
    sketches = sketches.join(classes.select("node", "keys"), "node")
    rest = rest.join(sketches, "node").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    rest = rest.select("bucket", "x", "y", "one", "two", "side", "node", "comp", "n", "sketch", "keys")
    found = rest.mapInArrow(_unresolved(SKETCH, percent), "a long, b long").distinct()
    more = verify(found)
    final = components(links.union(more))

    named = classes.join(final, "node", "left").select("d1", "d2", "n", F.coalesce("root", "node").alias("component"))
    out = sig.select("id", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.isnull(F.coalesce("component", "id"))).alias("kept"),
    )
