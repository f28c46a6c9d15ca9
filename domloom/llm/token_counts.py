"""Token counts of documents in flat token files, found by their separators alone."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def _encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def flat_blocks(docs: DataFrame, ranks_path: str, pattern: str, eod: int, id_col: str = "doc_id", text_col: str = "text", *, block: int = BLOCK) -> DataFrame:
    """docs as flat token files in blocks: (file, block, content, ids).

    A file is what one task reads: each text's ids, then eod, as little-endian 16-bit numbers with nothing between and no
    index, cut every `block` bytes wherever that falls. ids has the documents that end in a block, to name the counts by;
    the scan doesn't read it. Null and empty texts have no tokens, and their separator all the same; texts of any length are
    encoded whole and cut over blocks, repeated rows each have their document, an empty table has no blocks. A vocabulary whose
    ids don't fit 16 bits, or an odd block size, is an error.
    """
    if block < 2 or block % 2:
        raise ValueError("a block holds whole ids of two bytes")
    if not 0 <= eod < 1 << 16:
        raise ValueError("the separator must fit 16 bits")
    id_type = docs.schema[id_col].dataType.simpleString()
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoder(ranks_path, pattern)
        file, number = TaskContext.get().partitionId(), 0
        kind = arrow_id.get(id_type, pa.string())
        held, size, names = [], 0, []

        def out(content: bytes, names: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int64()), pa.array([content], pa.binary()), pa.array([names], pa.list_(kind))], ["file", "block", "content", "ids"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoding.encode_to_numpy(text.as_py() or "", disallowed_special=())
                if len(ids) and int(ids.max()) >> 16:
                    raise ValueError("the vocabulary has ids that don't fit 16 bits")
                raw = ids.astype("<u2").tobytes() + eod.to_bytes(2, "little")
                while size + len(raw) >= block:
                    held.append(raw[: block - size])
                    done = size + len(raw) == block
                    yield out(b"".join(held), [*names, name] if done else names)
                    raw, held, size, names = raw[block - size :], [], 0, []
                    number += 1
                    if done:
                        break
                else:
                    held.append(raw)
                    size += len(raw)
                    names.append(name)
        if size:
            yield out(b"".join(held), names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"file int, block long, content binary, ids array<{id_type}>")


def read_flat_files(spark: SparkSession, path: str, *, block: int = BLOCK) -> DataFrame:
    """Flat token files as blocks (file, block, content). Any path that Spark reads; each file up to 2 GB, as Spark's
    binary source takes it whole, and cut into blocks by slices."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", "length")
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("length") / block) - 1))
    cut = raw.select("file", "content", F.explode(pieces).alias("block"))
    return cut.select("file", "block", F.expr(f"substring(content, cast(block * {block} + 1 as int), {block})").alias("content"))


def _found(eod: int, width: int, extra: list[str]):
    """Blocks to (…, n, places): how many ids, and where the separators are; one vectorised comparison a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, places = [], []
            for content in batch.column(len(extra)):
                raw = content.as_buffer() if content.is_valid else b""
                ids = np.frombuffer(raw, f"<u{width}", len(raw) // width)
                n.append(len(ids))
                places.append(np.flatnonzero(ids == eod))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(extra)], pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int64()))], [*extra, "n", "places"])

    return run


def count_tokens(blocks: DataFrame, eod: int, *, width: int = 2) -> DataFrame:
    """Documents of flat files: (file, ordinal, n_tokens), ordinal from 0 in the file; the separator isn't counted.

    blocks has file, block (in order, from any number) and content; a block holds whole ids of `width` bytes. If blocks has
    an array column ids, the result has doc_id, its entry for each separator found.

    Each block is searched on its own. A prefix scan over one row a block then carries, along each file, how many ids and
    separators went before and where the last separator was; so documents that span blocks come out whole, and blocks
    without a separator pass the carry on. Only those summaries are shuffled, never contents.

    Edge cases. Ids after the last separator are no document yet and are left out. Empty documents count 0. Empty or null
    blocks are fine; an empty table has no documents. Other columns are ignored.
    """
    named = "ids" in blocks.columns
    extra = ["file", "block", *["ids"] * named]
    schema = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in extra)
    found = blocks.select(*extra, "content").mapInArrow(_found(eod, width, extra), f"{schema}, n long, places array<long>")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    start = F.coalesce(F.sum("n").over(before), zero)
    first = F.coalesce(F.sum(F.size("places")).over(before), zero)
    placed = found.withColumn("start", start).withColumn("first", first)
    placed = placed.withColumn("at", F.transform("places", lambda p: p + F.col("start")))
    placed = placed.withColumn("carry", F.coalesce(F.max(F.array_max("at")).over(before), F.lit(-1).cast("long")))
    ends = placed.select("file", "first", "carry", "at", *["ids"] * named, F.posexplode("at").alias("i", "end"))
    out = ends.select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("end") - F.coalesce(F.get("at", F.col("i") - 1), F.col("carry")) - 1).alias("n_tokens"), *[F.get("ids", F.col("i")).alias("doc_id")] * named
    )
    return out
