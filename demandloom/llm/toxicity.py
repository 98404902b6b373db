"""Toxicity by a classifier chain.

The categories are predicted one after the other: each has a linear model over the presence of hashed words
and over the probabilities of the categories before it. While training, those probabilities come from models
that have not seen the row (out of fold), so a later model learns how far the earlier ones can be trusted.
The last category is the label itself; the ones before it are the labelled rows that hold one of a few words.

Training takes at most ``Settings.sample`` labelled documents, those with the smallest hash of doc_id outside
the held-out fold (crc32(doc_id) mod 5 = 0). The folds of one category are fitted in parallel tasks.

Null and empty texts have no words: they score the chain's biases. Unusable labels teach nothing (see
``quality``); without any, every score is 0.5 and nothing is called toxic. Rows are scored one by one. Only
doc_id and text are read from the documents, only doc_id and toxic from the labels. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.common import table, text_steps
from demandloom.llm.quality import Ftrl, training_rows
from demandloom.llm.quality import Settings as FtrlSettings
from demandloom.llm.quality import sigmoid
from demandloom.session import materialise, ship_package

FOLDS = 5
CALL = 0.5
# Words that put a toxic row into a category; fixed values.
CATEGORIES = {
    "insult": ("idiot", "moron", "loser", "clown", "stupid", "fool", "dumb"),
    "contempt": ("pathetic", "worthless", "disgusting", "useless", "ridiculous"),
    "dehumanising": ("scum", "trash", "vermin", "filth", "garbage"),
}
CHAIN = (*CATEGORIES, "toxic")
# Letters of a word's beginning, so that forms of one word share a feature.
STEM = 5
EDGE = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


class Settings(NamedTuple):
    sample: int = 10_000
    slots: int = 1 << 18
    rate: float = 3.0
    l1: float = 4.0
    passes: int = 3


class Slots(dict):
    """Words to two slots: of the lower case without punctuation at the ends, and of that word's beginning."""

    def __init__(self, slots: int):
        self.slots = slots

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        bare = EDGE.sub(b"", word).decode("utf-8", "replace").lower()
        found = self[word] = (xxhash.xxh64_intdigest(bare) % self.slots, xxhash.xxh64_intdigest(bare[:STEM], seed=1) % self.slots)
        return found


def present(text: bytes, slots: Slots) -> np.ndarray:
    """The slots of a text's words, each once."""
    return np.unique(np.array([slots[w] for w in set(text.split())], np.int32))


def _model(settings: Settings) -> Ftrl:
    """FTRL with a place for each earlier category after the slots, and the bias last."""
    return Ftrl(FtrlSettings(slots=settings.slots + len(CHAIN), rate=settings.rate, l1=settings.l1, passes=settings.passes))


def _row(at: np.ndarray, earlier: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    places = np.concatenate([at, settings.slots + np.arange(len(earlier)), [settings.slots + len(CHAIN)]])
    return places.astype(np.int64), np.concatenate([np.ones(len(at)), earlier, [1.0]])


def fit(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, settings: Settings) -> np.ndarray:
    model = _model(settings)
    ready = [_row(at, before, settings) for at, before in zip(rows, earlier)]
    for _ in range(settings.passes):
        for (at, x), mark in zip(ready, y):
            model.learn(at, x, mark)
    return model.weights(np.arange(settings.slots + len(CHAIN) + 1)).astype(np.float32)


def apply(rows: list[np.ndarray], earlier: np.ndarray, weights: np.ndarray, settings: Settings) -> np.ndarray:
    """Probabilities of one category from slots present and the earlier categories' probabilities."""
    words = np.array([weights[at].sum(dtype=np.float64) for at in rows])
    return sigmoid(words + earlier @ weights[settings.slots:settings.slots + earlier.shape[1]].astype(np.float64) + float(weights[-1]))


def _marked(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """at, id, fold, slots present, and one column y for each category of the chain."""
    rows = training_rows(docs, labels, "toxic", settings.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(settings.slots)
        for part, texts in text_steps(batches):
            found = pa.array([present(x, slots).tolist() for x in texts], pa.list_(pa.int32()))
            keep = [part.column(part.schema.get_field_index(n)) for n in ("at", "id", "y")]
            yield pa.RecordBatch.from_arrays([*keep, found, part.column(part.schema.get_field_index("text"))], names=["at", "id", "toxic", "slots", "text"])

    held = rows.mapInArrow(run, "at long, id long, toxic int, slots array<int>, text string")
    words = {name: r"(?i)\b(" + "|".join(seeds) + r")\b" for name, seeds in CATEGORIES.items()}
    return held.select(
        "at", "id", F.pmod(F.xxhash64("at"), F.lit(FOLDS)).cast("int").alias("fold"), "slots",
        *[((F.col("toxic") == 1) & F.col("text").rlike(w)).cast("int").alias(name) for name, w in words.items()], "toxic")


def _fold_model(name: str, settings: Settings):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """What the model predicts for the fold it leaves out, or its weights if it leaves none out."""
        frame = frame.sort_values(["at", "id"])
        model = int(frame["model"].iloc[0])
        slots, before = frame["slots"].tolist(), np.array(frame["earlier"].tolist(), float).reshape(len(frame), -1)
        seen = (frame["fold"] != model).to_numpy()
        pick = lambda chosen: [slots[i] for i in np.flatnonzero(chosen)]
        weights = fit(pick(seen), before[seen], frame[name].to_numpy()[seen], settings)
        if model == FOLDS:
            return pd.DataFrame({"id": [None], "p": [None], "weights": [weights.tobytes()]})
        p = apply(pick(~seen), before[~seen], weights, settings) if (~seen).any() else []
        return pd.DataFrame({"id": frame["id"][~seen], "p": p, "weights": None})

    return run


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """One weight table for each category, in the chain's order."""
    rows = materialise(_marked(docs, labels, settings))
    # Model f < FOLDS leaves fold f out and predicts it; model FOLDS has all rows and is the one to keep.
    copies = rows.withColumn("earlier", F.array().cast("array<double>"))
    kept = []
    for name in CHAIN:
        every = copies.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
        found = materialise(every.groupBy("model").applyInPandas(_fold_model(name, settings), "id long, p double, weights binary"))
        full = found.where("weights IS NOT NULL").select("weights").collect()
        kept.append(np.frombuffer(full[0][0], np.float32) if full else np.zeros(settings.slots + len(CHAIN) + 1, np.float32))
        copies = copies.join(found.where("id IS NOT NULL").select("id", "p"), "id").withColumn(
            "earlier", F.concat("earlier", F.array("p"))).drop("p")
    return np.stack(kept)


def chain(texts: list[bytes], slots: Slots, weights: np.ndarray, settings: Settings) -> np.ndarray:
    """A row of probabilities for each text, in the chain's order."""
    # Only slots with a weight in some category can change a score.
    useful = weights[:, :settings.slots].any(0)
    rows = [(lambda at: np.unique(at[useful[at]]))(np.array([slots[w] for w in set(x.split())], np.int64).ravel()) for x in texts]
    found = np.zeros((len(texts), 0))
    for table_ in weights:
        found = np.column_stack([found, apply(rows, found, table_, settings)])
    return found


def classify(docs: DataFrame, weights: np.ndarray, settings: Settings) -> DataFrame:
    """doc_id, p: the chain's probabilities."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(settings.slots)
        for rows, texts in text_steps(batches):
            found = chain(texts, slots, sent.value, settings)
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(found[:, i]) for i in range(len(CHAIN))]], names=["doc_id", *CHAIN])

    schema = "doc_id long, " + ", ".join(f"{name} double" for name in CHAIN)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, one probability for each category of the chain."""
    ship_package(docs.sparkSession)
    return classify(docs, train(docs, labels, settings), settings)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", F.col("toxic").alias("score"), (F.col("toxic") > CALL).cast("int").alias("predicted"),
        *[F.col(name).alias(f"p_{name}") for name in CATEGORIES])
