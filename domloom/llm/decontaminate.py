"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import durable
from ._words import ALNUM, LOWER, RINGS, U, buffers, chunks, mix, signed, spans
from .substrings import anchors

GRAM = 5
FILTER_BITS = 1 << 23


def _slots(prints: np.ndarray) -> list[np.ndarray]:
    """Places of fingerprints in the bit filter."""
    return [(mix(prints.view(U) ^ U(salt)) % U(FILTER_BITS)).astype(np.int64) for salt in (0x1F, 0x2E)]


def _fingerprints(column: pa.Array, window: int, gram: int, short: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """For each text: fingerprints, their word places, the words, and each fingerprint's length in words, negative for a whole run.

    Winnowing keeps the smallest gram of every window, so two texts that share `window` words keep the same gram of them.
    Lengths in `short` are the ones of items with fewer words; their runs are all kept.
    """
    data, off = buffers(column)
    for i, j in chunks(off):
        piece = LOWER[data[off[i] : off[j]]]
        start, end, first = spans(piece, off[i : j + 1] - off[i], ALNUM)
        words = RINGS[1].words(piece, start, end)
        doc = np.repeat(np.arange(j - i), np.diff(first))
        sums = RINGS[1].sums(words)
        _, place = anchors(words, doc, gram, window)
        place = np.unique(place)
        parts = [(RINGS[1].between(sums, place, place + gram), place, np.full(len(place), gram))]
        for n in short:
            at = np.arange(max(0, len(words) - n + 1))
            at = at[doc[at] == doc[at + n - 1]]
            parts.append((mix(RINGS[1].between(sums, at, at + n) ^ U(0x5A5A)), at, np.full(len(at), -n)))
        prints, place, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(place, kind="stable")
        prints, place, length = prints[order], place[order], length[order]
        cut = np.searchsorted(place, first)
        raw = piece.tobytes()
        for r in range(j - i):
            a, b = cut[r], cut[r + 1]
            f, g = first[r], first[r + 1]
            yield prints[a:b], place[a:b] - f, (raw, start[f:g], end[f:g]), length[a:b]


def _around(words, place: int, length: int, reach: int) -> tuple[list[bytes], int]:
    """The words that windows over place..place+length can touch, and the place of the fingerprint among them."""
    raw, start, end = words
    a = max(0, place - reach)
    b = min(len(start), place + length + reach)
    return [raw[start[x] : end[x]].decode() for x in range(a, b)], place - a


def _item_rows(window: int, gram: int, short: tuple[int, ...]):
    """Items to (print, item, whole, words, at): fingerprints with the words around them. An item of fewer than window
    words has one fingerprint, of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, (prints, place, words, length) in zip(batch.column(0).to_pylist(), _fingerprints(batch.column(1), window, gram, short), strict=True):
                n = len(words[1])
                for p, at, k in zip(signed(prints).tolist(), place.tolist(), length.tolist(), strict=True):
                    if n >= window and k == gram:
                        around, where = _around(words, at, k, window - gram)
                        out.append((p, item, window, around, where))
                    elif n < window and k == -n:
                        out.append((p, item, n, *_around(words, at, n, 0)))
            yield pa.RecordBatch.from_pylist([dict(zip(("print", "item", "whole", "words", "at"), x, strict=True)) for x in out], _ITEM)

    return run


_ITEM = pa.schema([("print", pa.int64()), ("item", pa.string()), ("whole", pa.int32()), ("words", pa.list_(pa.string())), ("at", pa.int32())])
_DOC = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("print", pa.int64()), ("place", pa.int32()), ("words", pa.list_(pa.string())), ("at", pa.int32())])))])


def _doc_rows(window: int, gram: int, short: tuple[int, ...], bits: np.ndarray):
    """Documents to their number of words and the fingerprints that pass the filter, with the words around each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, (prints, place, words, length) in zip(batch.column(0).to_pylist(), _fingerprints(batch.column(1), window, gram, short), strict=True):
                hits = []
                if len(prints):
                    passed = np.ones(len(prints), bool)
                    for slot in _slots(prints):
                        passed &= (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                    for p, at, k in zip(signed(prints[passed]).tolist(), place[passed].tolist(), length[passed].tolist(), strict=True):
                        around, where = _around(words, at, abs(k), window - gram if k > 0 else 0)
                        hits.append({"print": p, "place": at, "words": around, "at": where})
                out.append({"row": row, "n_words": len(words[1]), "hits": hits})
            yield pa.RecordBatch.from_pylist(out, _DOC)

    return run


def _filter_bits(items: DataFrame) -> np.ndarray:
    """A bit filter of the items' fingerprints. Its size is fixed, whatever the number of items: bits are merged by Spark
    into at most FILTER_BITS / 64 rows, and a fuller filter lets more fingerprints through to the join, no fewer."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_slots(batch.column(0).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((at & 63).astype(np.int32))], ["cell", "bit"])

    cells = items.select("print").mapInArrow(slots, "cell long, bit int").groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    got = cells.toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    if len(got):
        out[got.column("cell").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def _extended():
    """Joined rows to (row, start, n, item): each window that holds the fingerprint and is the same on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                mine, theirs, at, there, n = x["mine"], x["theirs"], x["at"], x["there"], x["whole"]
                shift = at - there
                low, high = max(0, shift), min(len(mine), len(theirs) + shift)
                if not low <= at < high:
                    continue
                a = at
                while a > low and mine[a - 1] == theirs[a - 1 - shift]:
                    a -= 1
                b = at
                while b < high and mine[b] == theirs[b - shift]:
                    b += 1
                if b - a >= n:
                    out.append({"row": x["row"], "start": x["place"] - at + a, "n": b - a, "item": x["item"]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("item", pa.string())]))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a row in order of their starts to the spans that they cover; runs that overlap or touch are one span. Linear."""
    for batch in batches:
        starts, lengths = batch.column(2), batch.column(3)
        cut = starts.offsets.to_numpy()
        begin, count = (c.values.to_numpy()[cut[0] : cut[-1]].astype(np.int64) for c in (starts, lengths))
        cut = cut - cut[0]
        # Rows laid end to end, with room between them, are one line of runs.
        gap = int((begin + count).max(initial=0)) + 1
        shift = np.repeat(np.arange(len(cut) - 1, dtype=np.int64) * gap, np.diff(cut))
        reach = np.maximum.accumulate(begin + count + shift)
        first = np.ones(len(begin), bool)
        first[1:] = (begin + shift)[1:] > reach[:-1]
        first[cut[:-1][np.diff(cut) > 0]] = True
        heads = np.flatnonzero(first)
        last = np.append(heads, len(begin))[1:] - 1
        spans = pa.StructArray.from_arrays([pa.array((begin[heads]).astype(np.int32)), pa.array((reach[last] - shift[last]).astype(np.int32))], ["start", "end"])
        bounds = np.searchsorted(heads, cut).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bounds), spans)], ["row", "items", "spans"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, window: int = 10, gram: int = GRAM) -> DataFrame:
    """One row per document: id_col, n_words, n_hit, items (sorted ids as strings), spans ([start, end) runs of hit words).

    Words are runs of a-z, 0-9 and bytes over 0x7F, A-Z lower-cased. A window is `window` consecutive words of an item; an
    item of fewer words, but not none, is one window. Words of a document inside any occurrence of a window are hit.

    Method. Winnowing: the smallest gram of `gram` words is kept of each window, so any shared window shares a kept gram.
    Fingerprints of documents and items are joined, and each match is extended word by word on the words themselves, so a
    chance match of hashes has no effect. Only the documents' fingerprints that pass a bit filter of fixed size are
    shuffled. Items of fewer words than a window are looked up by runs of their own lengths (under `window` of them).

    Scale. Neither side is broadcast whole or collected. The join is a plain equi join, skewed keys are split by AQE; the
    rows of a document meet in one group, bounded by its length and by the items that it holds.

    Edge cases. Null or wordless texts: no words, no hits; such items never occur. Rows are told apart even if ids repeat
    or are null; each gets its own row. Repeated items count once per id; items without an id hit but aren't named.
    """
    spark = docs.sparkSession
    base = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    found = durable(base.mapInArrow(_item_rows(window, gram, tuple(range(1, window))), "print long, item string, whole int, words array<string>, at int"), "item-prints")
    short = tuple(sorted(r[0] for r in found.where(F.col("whole") < window).select("whole").distinct().collect()))
    found = found.distinct()
    bits = spark.sparkContext.broadcast(_filter_bits(found))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    source = numbered.select("row", "text", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids.append(batch.column(2))
                yield batch

        for out in _doc_rows(window, gram, short, bits.value)(seen()):
            yield pa.RecordBatch.from_arrays([*out.columns, ids.pop(0)], [*out.schema.names, "id"])

    id_type = numbered.schema["id"].dataType.simpleString()
    rows = durable(source.mapInArrow(run, f"row long, n_words long, hits array<struct<print:long,place:int,words:array<string>,at:int>>, id {id_type}"), "doc-prints")
    hits = rows.where("size(hits) > 0").select("row", F.explode("hits").alias("h")).select("row", "h.print", "h.place", F.col("h.words").alias("mine"), F.col("h.at").alias("at"))
    matched = hits.join(found.select("print", "item", "whole", F.col("words").alias("theirs"), F.col("at").alias("there")), "print")
    spans_ = matched.select("row", "place", "mine", "at", "theirs", "there", "whole", "item").mapInArrow(_extended(), "row long, start int, n int, item string").distinct()
    hit = spans_.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("runs"), F.sort_array(F.collect_set("item")).alias("items"))
    hit = hit.select("row", "items", F.col("runs.start").alias("start"), F.col("runs.n").alias("n")).mapInArrow(_merged, "row long, items array<string>, spans array<struct<start:int,end:int>>")
    none = F.expr("cast(array() as array<string>)")
    out = rows.select("row", "id", "n_words").join(hit, "row", "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]), F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"))
