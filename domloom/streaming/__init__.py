"""Pages as a stream. Parsing keeps no state, so every operator of domloom.operators takes a streaming DataFrame as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.parse import parse


def read_pages(spark: SparkSession, path: str, schema: StructType | str, *, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files of pages."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def first_of_pages(pages: DataFrame, keys: list[str], time_col: str, late: str = "1 hour") -> DataFrame:
    """Each page once: repeats within the watermark go; state is bounded by `late`."""
    return pages.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def text_stats(pages: DataFrame, time_col: str, window: str = "10 minutes", late: str = "1 hour", html_col: str = "html") -> DataFrame:
    """Per window of event time: pages, characters of visible text, and pages that failed."""
    made = parse(pages.withWatermark(time_col, late), html_col, outputs=("text",), keep=(time_col,))
    agg = made.groupBy(F.window(time_col, window).alias("w")).agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.count("parse_failure").alias("failed"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "pages", "chars", "failed")
