"""The thin queries of __spark_entry__ over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dealt
from . import decontaminate, language, lines, minhash, oracles, quality, quality_rules, sentencepiece, substrings, token_counts, toxicity
from ._pieces import default_path, pattern
from ._store import durable, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, as files have it or as the session deals it (spark.domloom.partitions)."""
    return dealt(table(spark, sf_dir, "documents"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=4, percent=80)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(documents(spark, sf_dir), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    out = language.identify(docs, ~held_out, default_path("piece_bpe_32k.model"))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    model = toxicity.train(docs, labels, ~held_out)
    return toxicity.severity(docs, model).select("doc_id", held_out.alias("held_out"), "severity", "grade", "toxic")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_repeated_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    weights, bias = quality.train(docs, labels, ~held_out)
    out = quality.score(docs, weights, bias)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = sentencepiece.encode(docs, default_path("piece_bpe_32k.model"), check_col="round_trip")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    blocks = durable(token_counts.flat_blocks(docs, default_path("byte_bpe_50k.tiktoken"), pattern(), 50256), "flat-tokens")
    return token_counts.count_tokens(blocks, 50256).select("doc_id", "n_tokens")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).drop("failed")


QUERIES = {
    q.__name__: q
    for q in (
        op1_minhash_near_dedup, op2_substring_dedup, op3_benchmark_decontamination, op4_language_id, op5_toxicity,
        op6_line_dedup, op7_quality_classifier, op8_sentencepiece, op9_token_counts, op10_quality_rules,
    )
}
ORACLE_SQL = {
    "op1_minhash_near_dedup": oracles.OP1,
    "op2_substring_dedup": oracles.OP2,
    "op3_benchmark_decontamination": oracles.OP3,
    "op6_line_dedup": oracles.OP6,
    "op10_quality_rules": oracles.OP10,
}
