"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domloom.llm import decontaminate, lines, minhash, quality, sentencepiece
from domloom.llm._pieces import default_path
from domloom.llm._store import durable, sweep, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts 0 go. It is fitted on labelled rows of this stage's input, folds as in op7.

    Edge cases. Null and empty texts are scored by the bias alone; rows are judged one by one, whether ids repeat or are null;
    without labels every score is a half and all stay. An empty table stays empty. All columns of docs are kept as they are.
    """
    train_on = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0, F.lit(False))
    weights, bias = quality.train(docs, table(spark, sf_dir, "labels"), train_on)
    return quality.keep(docs, weights, bias)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go from the texts; a document that loses all of its lines goes.

    Edge cases. Null and empty texts have no lines and stay as they are. Rows without an id lose nothing and are no source; rows
    that share an id are no repeats of one another. n_chars follows the text, null where the text is. An empty table stays empty.
    """
    out = lines.remove_repeated_lines(docs)
    out = out.where(~((F.col("n_removed_lines") > 0) & (F.col("n_removed_lines") == F.col("n_lines"))))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a row number, and its column. Verdicts go by row: a null id matches none, and a repeated one several."""
    row = "row"
    while row in [c.lower() for c in docs.columns]:
        row += "_"
    return durable(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) one row stays: that of the smallest id.

    A row without an id stays only where its group has no id at all. Rows that share an id are told apart: they are copies
    of one another by their texts alone. Null, empty and wordless texts are copies of nothing and stay.
    """
    rows, row = numbered(docs)
    found = minhash.near_duplicates(rows, id_col=row, shingle=5, percent=80).select(row, "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    # One row a group, by partial aggregates; what isn't it goes, by a join on the row, so no group meets in one task.
    first = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order)[row].alias(row)).select(row)
    gone = found.select(row).join(first, row, "left_anti")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold ten consecutive words of a benchmark item go, each by its own text, whether its id is null or repeated.

    Edge cases. Null, empty and wordless texts hold nothing and stay; a benchmark without items takes nothing away.
    """
    rows, row = numbered(docs)
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), id_col=row, window=10)
    return rows.join(found.where("n_hit > 0").select(row), row, "left_anti").select(*docs.columns)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, and whether decoding them gives the text back.

    Edge cases. Null and empty texts have no ids and decode to themselves; every row has its own, whether ids repeat or are null.
    """
    out = sentencepiece.encode(docs.select("doc_id", "lang", "source", "text"), default_path("piece_bpe_32k.model"), check_col="round_trip")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece_encoding),
]

#: The classifier is fitted and the encoder is an automaton; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in order. Once a stage is written, the tables that it read or made on the way are deleted."""
    docs = table(spark, sf_dir, "documents")
    start = written()
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        end = written()
        docs = durable(out, name)
        sweep(spark, start, end)
    return STAGES[-1][1](spark, docs, sf_dir)
