import random

import numpy as np

from demandloom.llm import components as C


def plain(edges):
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for edge in edges for x in edge}


def graph(made, nodes, edges):
    name = [made.randrange(-2**63, 2**63) for _ in range(nodes)]
    found = [(made.choice(name), made.choice(name)) for _ in range(edges)]
    return [x for x in found if x[0] != x[1]]


def test_forests_by_brute_force():
    made = random.Random(3)
    for trial in range(60):
        edges = graph(made, made.randrange(2, 80), made.randrange(1, 90))
        if not edges:
            continue
        a, b = (np.array(x) for x in zip(*edges))
        found = dict(zip(*(x.tolist() for x in C.forest(a, b))))
        assert found == {x: r for x, r in plain(edges).items() if x != r}
    path = np.random.default_rng(4).permutation(3000)
    assert set(C.forest(path[1:], path[:-1])[1].tolist()) == {0}


def counted(monkeypatch):
    calls = []
    monkeypatch.setattr(C, "materialise", lambda df, real=C.materialise: calls.append(1) or real(df))
    return calls


def test_a_long_path_in_one_partition_takes_one_round(spark, monkeypatch):
    """Each round is some seven shuffles; the last one finds nothing to change."""
    calls = counted(monkeypatch)
    found = C.components(spark.createDataFrame([(k, k + 1) for k in range(500)], "x long, y long")).collect()
    assert sorted(map(tuple, found)) == [(k, 0) for k in range(501)]
    assert len(calls) <= 2


def test_components_across_partitions_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "TOGETHER", 10)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = graph(random.Random(5), 300, 260) + [(k, k + 1) for k in range(60)]
        found = list(map(tuple, C.components(spark.createDataFrame(edges, "x long, y long").repartition(6)).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(found) == len(set(found)) and dict(found) == plain(edges)


def test_text_nodes(spark):
    found = C.components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "x string, y string")).collect()
    assert sorted(map(tuple, found)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


def test_few_edges_need_no_rounds(spark, monkeypatch):
    """A path whose edges lie in many partitions, as many as one of them joins up."""
    calls = counted(monkeypatch)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = list(map(tuple, C.components(spark.createDataFrame([(k, k + 1) for k in range(500)], "x long, y long").repartition(6)).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(found) == [(k, 0) for k in range(501)]
    assert len(calls) == 2
