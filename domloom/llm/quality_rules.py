"""Quality rules: a table of thresholds compiled into one Spark projection. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_SPLIT = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of four languages.
STOP_WORDS = """
the be to of and that have with in is it for on as was
le la les de des et un une que dans est pas pour en
der die das und den von zu mit ein eine ist nicht sich
el los las del y que en por con una para es
""".split()


@dataclass(frozen=True)
class Rule:
    """Keep a document where low <= metric <= high; a bound of None doesn't apply."""

    metric: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value, out = F.col(self.metric), F.lit(True)
        if self.low is not None:
            out = out & (value >= F.lit(self.low))
        if self.high is not None:
            out = out & (value <= F.lit(self.high))
        return out


#: Length, symbol, stop-word and line ratios, on the scale of the published heuristics for web text.
RULES = (
    Rule("n_words", 20),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", high=0.2),
    Rule("n_stop_words", 2),
    Rule("alpha_word_ratio", 0.5),
    Rule("upper_ratio", high=0.6),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.4),
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _stripped(side: str, value: Column) -> Column:
    """value without WHITE at its ends: `btrim`, `ltrim` or `rtrim`."""
    return F.call_function(side, value, F.lit(WHITE)) if side == "btrim" else getattr(F, side)(value, F.lit(WHITE))


def _with_later(hashes: str, step: int) -> Column:
    """Each hash but the last `step`, hashed with the one `step` places later."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + step)))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measures that rules read. A few projections; no shuffle, no user function.

    A projection that holds functions of array elements copies every column that it hands on, so measures of one depth share one.
    Lines are tested by their ends, without patterns. A window's hash is doubled up from those of two, four and eight words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumn("_text", text).withColumn("_inner", _stripped("btrim", F.col("_text")))
    df = df.withColumns(
        {
            "_words": F.when(F.col("_inner") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("_inner", WORD_SPLIT)),
            "_lines": F.filter(F.split("_text", "\n"), lambda x: _stripped("ltrim", x) != ""),
            "_runs": F.split(F.lower("_text"), r"[^\p{L}]+"),
            "_upper": F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")),
            "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", f"[{SYMBOLS}]+", ""))).cast("long"),
        }
    )
    n_words, n_lines, word_chars = F.size("_words").cast("long"), F.size("_lines"), F.length(F.array_join("_words", "")).cast("long")
    n_dup_lines = (n_lines - F.size(F.array_distinct("_lines"))).cast("long")
    bullet = lambda x: _stripped("ltrim", x).substr(1, 1).isin("-", "*", "•")
    dots = lambda x: _stripped("rtrim", x).endswith("...") | _stripped("rtrim", x).endswith("…")
    df = df.withColumns(
        {
            "n_words": n_words,
            "word_chars": word_chars,
            "n_dup_lines": n_dup_lines,
            "n_stop_words": F.size(F.array_intersect("_runs", F.array(*map(F.lit, sorted(set(STOP_WORDS)))))),
            "upper_ratio": _share(F.col("_upper"), F.length(F.array_join("_runs", ""))),
            "alpha_word_ratio": _share(F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))), n_words),
            "mean_word_chars": _share(word_chars, n_words),
            "symbol_ratio": _share(F.col("n_symbols"), n_words),
            "dup_line_ratio": _share(n_dup_lines, n_lines),
            "bullet_line_ratio": _share(F.size(F.filter("_lines", bullet)), n_lines),
            "ellipsis_line_ratio": _share(F.size(F.filter("_lines", dots)), n_lines),
            "_h": F.when(n_words >= WINDOW, F.transform("_words", lambda w: F.xxhash64(w))),
        }
    )
    for step in (1, 2, 4):
        df = df.withColumn("_h", _with_later("_h", step))
    # Pack: 37 leading bits of the hash, 27 bits of the place. Equal hashes end up side by side.
    df = df.withColumn("_packed", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: h.bitwiseAND(F.lit(-(1 << 27))).bitwiseOR(i.cast("long"))))))
    top = lambda x: F.shiftright(x, 27)
    near = F.filter(
        F.transform("_packed", lambda x, i: F.when((top(x) == top(F.get("_packed", i - 1))) | (top(x) == top(F.get("_packed", i + 1))), x.bitwiseAND(F.lit((1 << 27) - 1)).cast("int"))),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("_near", F.when(F.col("_packed").isNotNull(), near))
    df = df.withColumn("_pairs", F.sort_array(F.transform("_near", lambda i: F.struct(F.get("_h", i).alias("h"), i.alias("i")))))
    same = F.transform("_pairs", lambda x, i: F.when((x["h"] == F.get("_pairs", i - 1)["h"]) | (x["h"] == F.get("_pairs", i + 1)["h"]), x["i"]))
    df = df.withColumn("_at", F.sort_array(F.filter(same, lambda x: x.isNotNull())))
    covered = F.aggregate(
        F.transform("_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda acc, x: acc + x
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed.

    failed lists the metrics of the rules that don't hold. base_failed: under 20 words, or over 30 % of words in repeated
    8-word windows; such a document isn't kept. The rules compile into one projection over the measures.

    Edge cases. Null and empty texts have no words and fail. Ties: bounds belong to the kept side. Rows are judged one by
    one, so repeated rows each get theirs, and an empty table gives none; other columns are ignored. Cost grows with a text's length, times its logarithm
    for windows of a text that has repeats; texts of up to 2**27 words.
    """
    df = measures(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_in")), "_in")
    failed = F.filter(F.array(*[F.when(~r.holds(), F.lit(r.metric)) for r in rules]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed"),
    )
