"""Connected components of a graph given as edges, by alternating large and small stars.

Each partition's edges are joined up among themselves before the first round and after each, so rounds are needed only
for what is linked across partitions. As many edges as one partition joins up at a time need no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.session import materialise, release

# Edges of a partition that are joined up together, beyond those of one batch.
TOGETHER = 1 << 20


def _star(edges: DataFrame, left: Column, right: Column, keep: Column) -> DataFrame:
    """Each node's kept neighbours, linked to the smallest of the node and all its neighbours.

    The smallest neighbour is an aggregate that sums up before the shuffle; the join that hands it out
    has the edges on one side, which AQE splits where one node has many.
    """
    near = edges.select(left.alias("u"), right.alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.join(least, "u").where(keep)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges that reaches a smaller one, and the smallest that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two, up = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        x, y = up[one], up[two]
        apart = x != y
        if not apart.any():
            break
        one, two, x, y = one[apart], two[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (higher := up[up]).tobytes() != up.tobytes():
            up = higher
    below = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[below], nodes[up[below]]


def _numbers(edges: DataFrame) -> bool:
    return all(kind == "bigint" for _, kind in edges.dtypes)


def _joined_up(edges: DataFrame) -> DataFrame:
    """a, b: the edges, each node linked to the smallest that its partition's edges reach. Other types than long stay as they are."""
    if not _numbers(edges):
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= TOGETHER:
                yield joined(held)
                held, size = [], 0
        if size:
            yield joined(held)

    def joined(held):
        found = forest(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def _told(pairs: DataFrame) -> tuple:
    """What tells whether a round has changed an edge."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _rooted(pairs: DataFrame) -> DataFrame:
    """node, root of every node of the pairs, whose second is the first's root."""
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node with an edge to another one, and the smallest node it reaches.

    ``edges`` has two columns of one orderable type; self-links and nulls are dropped. The result does
    not depend on the order or repetition of edges. Rounds end when a round changes no edge; their
    number grows with the logarithm of the longest path.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    pairs = materialise(_joined_up(pairs))
    before = _told(pairs)
    if before[0] <= TOGETHER and _numbers(pairs):
        # No more than one partition joins up by itself.
        return _rooted(materialise(_joined_up(pairs.coalesce(1))))
    while True:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, F.col("a"), F.col("b"), F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Small star: the neighbours not above the node, and the node itself, link to their smallest.
        down = large.where(F.col("a") != F.col("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        pairs = materialise(_joined_up(linked.where(F.col("a") != F.col("b")).distinct()))
        del both, large, down, least, linked
        # The round before, its files and its plans go now: rounds are many small queries.
        release(edges.sparkSession)
        now = _told(pairs)
        if now == before:
            return _rooted(pairs)
        before = now
