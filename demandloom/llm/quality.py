"""Quality classifier: logistic regression over hashed word n-grams, learned by FTRL-proximal updates.

A feature's value is its share of the text's words, so a score is a sparse dot product that costs one
table look-up for each n-gram and grows in proportion to the text. Labels teach only from rows whose
crc32(doc_id) mod 5 is not 0. Training takes at most ``Settings.sample`` labelled documents, those with the
smallest hash of doc_id; they are fitted in one task and give one weight table of fixed size.

Null and empty texts have no words: their score is the bias alone. Labels that are null or neither 0 nor 1,
and doc_ids with contradicting labels, teach nothing. Without any usable label every score is 0.5. Rows are
scored one by one, repeated or not; a null doc_id counts as held out. Only doc_id and text are read from the
documents, only doc_id and the label from the labels. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.common import table, text_steps
from demandloom.llm.features import Grams, Words, word_grams
from demandloom.session import ship_package

FOLDS = 5
KEEP = 0.3


class Settings(NamedTuple):
    sample: int = 8_000
    slots: int = 1 << 18
    rate: float = 0.3
    smooth: float = 1.0
    l1: float = 0.002
    l2: float = 0.05
    scale: float = 20.0
    passes: int = 2


class Ftrl:
    """Follow the regularised leader, per coordinate, over sparse rows."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.z = np.zeros(settings.slots + 1)
        self.n = np.zeros(settings.slots + 1)

    def weights(self, at) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        free = np.where(np.asarray(at) == s.slots, 0.0, s.l1)  # the bias, in the last place, isn't shrunk
        return np.where(np.abs(z) <= free, 0.0, (np.sign(z) * free - z) / ((s.smooth + np.sqrt(n)) / s.rate + s.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> float:
        w = self.weights(at)
        p = sigmoid(w @ x)
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.rate
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        return p


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def sparse(grams: Grams, i: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one text, with the bias in the last place."""
    start, length = grams.starts[i], grams.lengths[i]
    at, count = np.unique(grams.slots[start:start + length], return_counts=True)
    values = np.append(count * (settings.scale / max(length, 1)), 1.0)
    return np.append(at, settings.slots).astype(np.int32), values.astype(np.float32)


def fit(texts: list[bytes], labels: list[int], settings: Settings) -> np.ndarray:
    """The weight table of the given rows, the bias last."""
    model, words = Ftrl(settings), Words()
    rows = [sparse(word_grams([x], words, settings.slots), 0, settings) for x in texts]
    for _ in range(settings.passes):
        for (at, x), y in zip(rows, labels):
            model.learn(at, x, y)
    return model.weights(np.arange(settings.slots + 1)).astype(np.float32)


def scores(texts: list[bytes], words: Words, weights: np.ndarray, settings: Settings) -> np.ndarray:
    grams = word_grams(texts, words, settings.slots)
    each = weights[grams.slots].sum(1, dtype=np.float64)
    sums = np.add.reduceat(np.append(each, 0.0), grams.starts) if len(texts) else np.zeros(0)
    total = np.where(grams.lengths > 0, sums * settings.scale / np.maximum(grams.lengths, 1), 0.0)
    return sigmoid(total + float(weights[-1]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """label, text, at: a bounded sample of the labelled rows outside the held-out fold.

    The sample's ids are at most ``sample`` rows of two numbers, so handing them to every task that reads
    the documents is bounded and no text is shuffled.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    marks = marks.where(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    ids = marks.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    chosen = ids.select("id", "y", F.xxhash64("id").alias("at")).orderBy("at", "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows that share a doc_id would teach one label several times: the smallest text stands for them.
    return texts.join(F.broadcast(chosen), "id").groupBy("at", "id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, label: str, settings: Settings) -> np.ndarray:
    rows = training_rows(docs, labels, label, settings.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(2).cast(pa.binary()).to_pylist()
            marks += batch.column(3).to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([fit(texts, marks, settings).tobytes()])], names=["weights"])

    found = rows.repartition(1).sortWithinPartitions("at", "id").mapInArrow(run, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros(settings.slots + 1, np.float32)


def classify(docs: DataFrame, weights: np.ndarray, settings: Settings) -> DataFrame:
    """doc_id, score for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for rows, texts in text_steps(batches):
            found = scores(texts, words, sent.value, settings)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    ship_package(docs.sparkSession)
    return classify(docs, train(docs, labels, "quality", settings), settings)


def accepted(docs: DataFrame, labels: DataFrame, least: float = KEEP, settings: Settings = Settings()) -> DataFrame:
    """The rows whose text scores at least ``least``, with all their columns."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, "quality", settings))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for rows, texts in text_steps(batches, at):
            yield rows.filter(pa.array(scores(texts, words, sent.value, settings) >= least))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
