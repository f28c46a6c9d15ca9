"""Language identification by unigram piece models, summed over all segmentations."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._pieces import load_pieces
from ._store import durable

SAMPLE = 600
ROUNDS = 3
CACHE = 300_000
LETTERS = re.compile(r"[^\W\d_]{1,32}")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, cut every 32 letters so that no probability underflows; all that the models see."""
    return LETTERS.findall(text.lower()) if text else []


class Lattice:
    """The pieces that can cover a word, each in every place. A letter that no piece covers is a piece of its own."""

    def __init__(self, pieces: dict[str, int]):
        self.unknown = len(pieces)
        #: Pieces by text, and -1 for texts that only begin one: a search goes on while it finds anything.
        self.steps = {p[:n]: -1 for p in pieces for n in range(1, len(p))} | pieces

    def arcs(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) by start, over the word with its mark."""
        w, get, out = "\u2581" + word, self.steps.get, []
        n = len(w)
        for s in range(n):
            piece = get(w[s : s + 1])
            out.append((s, s + 1, self.unknown if piece is None or piece < 0 else piece))
            if piece is None:
                continue
            for e in range(s + 2, n + 1):
                piece = get(w[s:e])
                if piece is None:
                    break
                if piece >= 0:
                    out.append((s, e, piece))
        return out


class Models:
    """Log probabilities of words in each language by the forward algorithm, with a cache of bounded size."""

    def __init__(self, pieces: dict[str, int], probabilities: list[list[float]]):
        self.lattice, self.p = Lattice(pieces), probabilities
        self.cache: dict[str, int] = {}
        self.logs = np.zeros((CACHE, len(probabilities)))

    def _word(self, word: str) -> int:
        """The row of a word not in the cache: logs of the sums over all of its segmentations."""
        if len(self.cache) >= CACHE:
            self.cache.clear()
        row = self.cache[word] = len(self.cache)
        arcs, n = self.lattice.arcs(word), len(word) + 1
        out = []
        for p in self.p:
            alpha = [0.0] * (n + 1)
            alpha[0] = 1.0
            for s, e, piece in arcs:
                alpha[e] += alpha[s] * p[piece]
            out.append(math.log(alpha[n]) if alpha[n] else -700.0)
        self.logs[row] = out
        return row

    def scores(self, text: str | None) -> tuple[np.ndarray, int]:
        """Log likelihoods of a text, and its number of words."""
        words = words_of(text)
        if not any(c.isalpha() for w in words for c in w):  # superscripts and the like look like letters to a pattern
            words = []
        total = np.zeros(len(self.p))
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            if len(self.cache) + len(part) > CACHE:
                self.cache.clear()
            get, new = self.cache.get, self._word
            total += self.logs[[row if (row := get(w)) is not None else new(w) for w in part]].sum(0)
        return total, len(words)


def _expected(pieces: dict[str, int], probabilities: list[list[float]]):
    """Rows (lang index, word, count) to expected counts of pieces, by the forward-backward sums over segmentations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        total: dict[tuple[int, int], float] = {}
        for batch in batches:
            for lang, word, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                arcs, p, n = lattice.arcs(word), probabilities[lang], len(word) + 1
                alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
                for s, e, piece in arcs:
                    alpha[e] += alpha[s] * p[piece]
                for s, e, piece in reversed(arcs):
                    beta[s] += beta[e] * p[piece]
                if alpha[n] <= 0.0:
                    continue
                for s, e, piece in arcs:
                    key = (lang, piece)
                    total[key] = total.get(key, 0.0) + count * alpha[s] * p[piece] * beta[e] / alpha[n]
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.float64())], ["lang", "piece", "n"])

    return run


def _probabilities(counts: list[dict[int, float]], size: int, smoothing: float) -> list[list[float]]:
    out = []
    for c in counts:
        whole = sum(c.values()) + smoothing * size
        out.append([(c.get(i, 0.0) + smoothing) / whole for i in range(size)])
    return out


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, vocabulary: str, *, sample: int = SAMPLE, rounds: int = ROUNDS, smoothing: float = 0.1) -> tuple[list[str], dict[str, int], list[list[float]]]:
    """Languages, pieces and per-language piece probabilities, by expectation maximisation over all segmentations.

    Fitted on about `sample` whole documents a language, those whose hashed id lies below the language's share. Word counts and
    expected counts are gathered by Spark; the driver sees one number for each language and piece of the fixed vocabulary.
    """
    pieces = load_pieces(vocabulary)
    pieces = {p: i for i, p in enumerate(sorted({x.lower() for x in pieces if (x.lstrip("\u2581") == "" or LETTERS.fullmatch(x.lstrip("\u2581").lower()))}))}
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text"))
    ends = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    langs = sorted(r["lang"] for r in ends)
    if not langs:
        return [], pieces, []
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in ends}
    limit = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, (1 << 63) - 1 if v == 1 else int(v * 2.0**64) - (1 << 63))])
    chosen = rows.where(F.col("h") <= F.element_at(limit, F.col("lang")))
    index = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in words_of(text):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    words = chosen.select(F.element_at(index, F.col("lang")).alias("lang"), "text").mapInArrow(split, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = durable(words, "language-words")
    size = len(pieces) + 1
    start = [0.0] * size
    for p, i in pieces.items():
        start[i] = 8.0 ** len(p.lstrip("\u2581"))
    flat = sum(start)
    probabilities = [[x / flat + 1e-9 for x in start] for _ in langs]
    for _ in range(rounds):
        got = words.mapInArrow(_expected(pieces, probabilities), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts: list[dict[int, float]] = [{} for _ in langs]
        for lang, piece, n in zip(*(got.column(c).to_pylist() for c in ("lang", "piece", "n")), strict=True):
            counts[lang][piece] = n
        probabilities = _probabilities(counts, size, smoothing)
    return langs, pieces, probabilities


def identify(docs: DataFrame, train_on: Column, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample: int = SAMPLE) -> DataFrame:
    """One row per document: id_col, lang_pred, score.

    A piece model is learned for each language of the rows where train_on holds (see train). A word's probability is the sum
    over all of its segmentations into pieces, a text's the product over its words; lang_pred is the likeliest language and
    score its posterior from even priors, by the mean log likelihood a word times at most 20 words, which keeps it off 0
    and 1. Ties go to the first language by name. Prediction reads the text alone.

    Scale. One pass without a shuffle; models are broadcast, their size bounded by languages times the fixed vocabulary.
    Edge cases. Null text, no letters, or nothing to learn from: 'und' and score 0. Labels that are null teach nothing. Rows
    are judged one by one, so repeated rows each get theirs, and an empty table gives none; other columns are ignored,
    whatever their names. Texts of any length are read whole, 4,096 words at a time.
    """
    spark = docs.sparkSession
    langs, pieces, probabilities = train(docs.where(train_on), id_col, text_col, lang_col, vocabulary, sample=sample)
    shared = spark.sparkContext.broadcast((langs, pieces, probabilities))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, pieces, probabilities = shared.value
        models = Models(pieces, probabilities)
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1):
                logs, n = models.scores(text.as_py())
                if not n or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(logs.argmax())
                names.append(langs[best])
                scores.append(1.0 / float(np.exp((logs - logs[best]) / n * min(n, 20)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, lang_pred string, score double").withColumnRenamed("id", id_col)
