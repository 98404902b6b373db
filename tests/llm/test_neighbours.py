import numpy as np
from pyspark.sql import functions as F

from demandloom.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, list int, rid string"


def exact(ids, vectors, query, k):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = unit @ unit[list(ids).index(query)]
    order = sorted((-s, i) for s, i in zip(scores, ids) if i != query)
    return [i for _, i in order[:k]]


def test_recall_and_order_on_the_given_vectors(spark, sf):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids, vectors = list(rows), np.array(list(rows.values()), float)
    found = {}
    for r in sorted(N.op6_neighbours(spark, sf).collect()):
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {i for i in ids if i % 50 == 0}
    hits = 0
    for q, near in found.items():
        assert [r.rank for r in near] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in near]
        for r in near:
            a, b = np.array(rows[q], float), np.array(rows[r.vec_id], float)
            assert np.isclose(r.score, a @ b / np.linalg.norm(a) / np.linalg.norm(b), rtol=1e-14)
        hits += len({r.vec_id for r in near} & set(exact(ids, vectors, q, 5)))
    assert hits >= 0.9 * 5 * len(found)


def test_recall_of_lists_and_blocks(spark):
    made = np.random.default_rng(1)
    vectors = made.standard_normal((3000, 24)).astype(np.float32) + 2 * made.standard_normal((20, 24)).astype(np.float32)[made.integers(0, 20, 3000)]
    frame = spark.createDataFrame([(i, v.tolist(), None, None) for i, v in enumerate(vectors)], SCHEMA)
    found = {}
    for r in N.neighbours(frame, F.pmod("vec_id", F.lit(50)) == 0, 5, N.Settings(sample=8000, block=40)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found[q] & set(exact(range(3000), vectors.astype(float), q, 5))) for q in range(0, 3000, 50))
    assert hits >= 0.9 * 300


def test_ties_bad_vectors_and_few_candidates(spark):
    a = [1.0, 2.0, 3.0]
    rows = [(i * 10, a, None, "x") for i in range(1, 30)] + [
        (1000, [1.0, 2.0, 2.9], 1, None), (7, None, 1, None), (8, [], 1, None), (9, [0.0, 0.0, 0.0], 1, None),
        (11, [float("nan"), 1.0, 1.0], 1, None), (12, [1.0, None, 2.0], 1, None), (13, [float("inf"), 1.0, 2.0], 1, None),
        (50, a, 2, None), (150, [1.0, 2.0], 3, None), (None, a, 1, None), (2000, [3.0, 2.0], 1, None)]
    found = {}
    for r in sorted(N.neighbours(spark.createDataFrame(rows, SCHEMA), F.pmod("vec_id", F.lit(50)) == 0, 5).collect()):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found[50] == [10, 20, 30, 40, 60] and found[100] == [10, 20, 30, 40, 50]
    assert found[1000] == [10, 20, 30, 40, 50] and found[2000] == [150]
    assert set(found) == {50, 100, 150, 200, 250, 1000, 2000}
    assert N.neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") > 0, 5).count() == 0


def test_scan_keeps_what_lies_within_the_bound():
    made = np.random.default_rng(2)
    members, query = N.unit(made.standard_normal((2000, 64))), N.unit(made.standard_normal((1, 64)))[0]
    turned = N.rotation(64).astype(float)
    assert np.allclose(turned @ turned.T, np.eye(64), atol=1e-5)
    apart = ((members - query) ** 2).sum(1)
    bound = np.sort(apart)[20]
    found = N.scan((query @ turned).astype(np.float32), bound * 1.0001, (members @ turned).astype(np.float32), 10)
    assert len(set(found) & set(np.argsort(apart)[:10])) >= 9
