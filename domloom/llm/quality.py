"""Quality classification: hashed word n-grams, logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._features import BITS, word_grams

SAMPLE = 6000
EPOCHS = 3
#: A score from here on predicts label 1.
THRESHOLD = 0.3


class Ftrl:
    """FTRL-proximal for logistic loss, with L1 and L2 regularisation and per-coordinate rates."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(index)
        g = (sigmoid(float(w @ value)) - label) * value
        n = self.n[index]
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[index] += g - step * w
        self.n[index] = n + g * g


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-min(max(x, -35.0), 35.0))))


def sampled(docs: DataFrame, labels: DataFrame, label: str, train_on: Column, id_col: str, text_col: str, sample: int, bits: int, shapes: bool) -> DataFrame:
    """Features and labels (h, mark, t, index, value) of about `sample` labelled rows; their order by h, mark and t, hashes of
    id and text, is fixed. Bounded by sample."""
    marked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.max(label).cast("double").alias("mark"))
    marked = marked.select("key", "mark", F.xxhash64(F.col("key").cast("string")).alias("h"))
    count = marked.count()
    below = (1 << 63) - 1 if count <= sample else int(sample / count * 2.0**64) - (1 << 63)
    chosen = docs.where(train_on & F.col(text_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).join(marked.where(F.col("h") <= below), "key")
    chosen = chosen.select("h", "mark", F.xxhash64("text").alias("t"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = [], []
            for i, v in word_grams(batch.column(3), bits, shapes):
                index.append(i)
                value.append(v.astype(np.float32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["h", "mark", "t", "index", "value"])

    return chosen.mapInArrow(run, "h long, mark double, t long, index array<int>, value array<float>")


def _fitted(epochs: int, bits: int):
    """Rows (mark, index, value), all of the sample in one task, to one row: the model's weights, the bias last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, index, value = [], [], []
        for batch in batches:
            marks += batch.column(0).to_pylist()
            # Views of the batch's own buffers: the sample is held once.
            for rows, column in ((index, batch.column(1)), (value, batch.column(2))):
                cut = column.offsets.to_numpy()
                rows += np.split(column.values.to_numpy()[: cut[-1]], cut[:-1])[1:]
        model = Ftrl((1 << bits) + 1)
        bias = np.array([1 << bits])
        for _ in range(epochs):
            for i, v, y in zip(index, value, marks, strict=True):
                model.update(np.concatenate([i.astype(np.int64), bias]), np.append(v.astype(np.float64), 1.0), float(y > 0))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f8").tobytes()], pa.binary())], ["weights"])

    return run


def train(docs: DataFrame, labels: DataFrame, train_on: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", *, sample: int = SAMPLE, epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias from about `sample` labelled rows where train_on holds; the bound is on rows, each read whole.

    The updates follow one another, so one task makes them all, on an executor: the driver gets the weights alone, whatever
    the size of the sample and its texts.
    """
    rows = sampled(docs, labels, label, train_on, id_col, text_col, sample, bits, True)
    got = rows.repartition(1).sortWithinPartitions("h", "mark", "t").select("mark", "index", "value").mapInArrow(_fitted(epochs, bits), "weights binary").toArrow()
    w = np.frombuffer(got.column(0)[0].as_py(), "<f8") if len(got) else np.zeros((1 << bits) + 1)
    return w[:-1].astype(np.float32), float(w[-1])


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text", *, bits: int = BITS) -> DataFrame:
    """docs' id_col and a score between 0 and 1: the logistic of a sparse dot product over the whole text.

    One pass, no shuffle; the broadcast is 2**bits floats. Null and empty texts have no features: the bias alone scores
    them. Other columns are ignored, whatever their names; repeated rows each get their row, an empty table has none. Texts of any
    length are read whole. Without labels all weights are 0 and every score is a half.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = [sigmoid(float(w[i] @ v) + bias) for i, v in word_grams(batch.column(1), bits, True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, weights: np.ndarray, bias: float, text_col: str = "text", *, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """The rows of docs whose text scores at least threshold, all columns as they were. One pass, no shuffle or join."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            passed = [sigmoid(float(w[i] @ v) + bias) >= threshold for i, v in word_grams(batch.column(at), bits, True)]
            yield batch.filter(pa.array(passed, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
