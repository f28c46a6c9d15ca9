"""Line deduplication by overlapping three-line windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import durable

WINDOW = 3


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW) -> DataFrame:
    """(row, id, places): for each row with repeats the places (from 0, among its lines with a word) of lines to remove.

    See remove_repeated_lines; row numbers the input's rows. docs must read the same rows each time.
    """
    return _marked(docs, id_col, text_col, window)[1]


def _marked(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = base.where("id IS NOT NULL").select("id", lines.alias("lines")).where(F.size("lines") >= window)
    hashed = cut.select("id", F.transform("lines", lambda x: F.md5(x.cast("binary"))).alias("h"))
    spans = F.transform(F.sequence(F.lit(1), F.size("h") - (window - 1)), lambda i: F.unhex(F.md5(F.array_join(F.slice("h", i, window), "").cast("binary"))))
    windows = durable(hashed.select("id", F.posexplode(spans).alias("at", "key")), "line-windows")
    first = windows.groupBy("key").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    later = windows.join(first, "key").where(F.struct("id", "at") != F.col("first")).select("id", "at")
    places = later.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + (window - 1))))).alias("places"))
    return base, places


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW) -> DataFrame:
    """docs with repeated lines removed from text_col, and the columns n_lines and n_removed_lines added.

    Lines are what stands between "\\n"; those with a word (a character other than ASCII white space) count. A window is
    `window` consecutive such lines of a document, as they stand. A line goes if it lies in a window whose lines also make a
    window that starts earlier: in a document of a smaller id, or earlier in the same one. Windows are judged on the input.
    What is left is joined by "\\n"; a text that loses nothing stays as it was, blank lines included.

    Scale. A window is a 128-bit digest; its first place comes from a partial aggregate, so a window that a third of all
    documents share costs one row a task, and the join back is an equi join that AQE splits where a key is hot. Texts are
    shuffled once. A group by id holds one document's places.

    Edge cases. Null, empty and short texts lose nothing. Rows that share an id are one document: an equal window at the
    same place is not earlier. Rows without an id lose nothing and are no source. Other columns are carried, whatever their
    names; the two added ones replace columns of the same name.
    """
    _, places = _marked(docs, id_col, text_col, window)
    key = "__line_dedup_id"
    places = places.select(F.col("id").alias(key), F.array_sort("places").alias("__line_dedup_places"))
    df = docs.join(places, F.col(id_col).cast("long") == F.col(key), "left")
    parts = F.split(F.col(text_col).cast("string"), "\n")
    df = df.withColumn("__line_dedup_lines", F.filter(parts, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    lines, gone = F.col("__line_dedup_lines"), F.col("__line_dedup_places")
    # Places to remove become the sorted complement, so that the cost is a merge and not a search for each line.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    n = F.coalesce(F.size(lines), F.lit(0))
    df = df.withColumn("__line_dedup_text", F.when(gone.isNull(), F.col(text_col)).otherwise(kept))
    df = df.withColumn("n_lines", F.when(lines.isNull(), 0).otherwise(n).cast("long")).withColumn("n_removed_lines", F.coalesce(F.size(F.array_intersect(F.sequence(F.lit(0), n - 1), gone)), F.lit(0)).cast("long"))
    df = df.withColumn(text_col, F.col("__line_dedup_text"))
    return df.select(*docs.columns, *[c for c in ("n_lines", "n_removed_lines") if c not in docs.columns])
