import random

import numpy as np
from corpus import frame, labels, words

from pyspark.sql import functions as F

from demandloom.llm import toxicity as T
from demandloom.llm.quality import held_out

SEEDS = [w for group in T.CATEGORIES.values() for w in group]


def corpus(count, seed=0):
    made, common, rows, marks = random.Random(seed), words(77, 300), [], []
    for i in range(count):
        text = [made.choice(common) for _ in range(60)] + words(seed * 10_000 + i, 20)
        toxic = i % 5 == 0
        if toxic:
            text += [made.choice(SEEDS[:12]) + made.choice(["", ".", ","]) for _ in range(4)]
            made.shuffle(text)
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(toxic)))
    return rows, marks


def test_held_out_accuracy_and_categories(spark):
    rows, marks = corpus(1500)
    found = {r.doc_id: r for r in T.toxicity(frame(spark, rows), labels(spark, marks)).collect()}
    held = spark.createDataFrame(rows, "doc_id long, text string").where(held_out(F.col("doc_id")))
    ids = [r.doc_id for r in held.collect()]
    truth = {i: t for i, _, t in marks}
    called = {i: found[i].toxic > T.CALL for i in ids}
    assert len(ids) > 200 and all(not called[i] for i in ids if not truth[i])
    assert np.mean([called[i] for i in ids if truth[i]]) > 0.95
    insult = [found[i].insult for i in ids if set(T.CATEGORIES["insult"]) & {w.strip(".,") for w in rows[i][1].split()}]
    others = [found[i].insult for i in ids if not truth[i]]
    assert np.median(insult) > 0.8 and max(others) < 0.5


def test_earlier_probabilities_are_out_of_fold():
    """A model that leaves a fold out predicts only that fold; the kept one sees all."""
    import pandas as pd

    settings = T.Settings(slots=64, l1=0.0)
    made = np.random.default_rng(1)
    frame_ = pd.DataFrame({
        "at": np.arange(60), "id": np.arange(60), "fold": np.arange(60) % T.FOLDS, "slots": [made.integers(0, 64, 5).tolist() for _ in range(60)],
        "earlier": [[0.5]] * 60, "toxic": made.integers(0, 2, 60)})
    part = T._fold_model("toxic", settings)(frame_.assign(model=2))
    assert sorted(part["id"]) == list(range(2, 60, 5)) and part["weights"].isna().all()
    changed = frame_.assign(model=2, toxic=np.where(frame_["fold"] == 2, 1 - frame_["toxic"], frame_["toxic"]))
    assert T._fold_model("toxic", settings)(changed)["p"].tolist() == part["p"].tolist()
    whole = T._fold_model("toxic", settings)(frame_.assign(model=T.FOLDS))
    assert len(whole) == 1 and len(np.frombuffer(whole["weights"][0], np.float32)) == 64 + len(T.CHAIN) + 1


def test_the_chain_feeds_forward():
    settings = T.Settings(slots=16)
    weights = np.zeros((len(T.CHAIN), 16 + len(T.CHAIN) + 1), np.float32)
    weights[0, -1] = 3.0
    weights[-1, 16] = 2.0  # the last category has the first one's probability alone
    found = T.chain([b"x y", b""], T.Slots(16), weights, settings)
    first = 1 / (1 + np.exp(-3.0))
    assert np.allclose(found[:, 0], first) and np.allclose(found[:, -1], 1 / (1 + np.exp(-2 * first)))


def test_given_tables(spark, sf):
    found = T.op7_toxicity(spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score > 0.5) for r in found)
