"""Approximate nearest neighbours by cosine: inverted lists scanned with adaptive dimension sampling.

A bounded sample of the vectors gives the lists' centres; every vector goes into the list of its nearest
centre. A query probes the nearest lists. There, vectors are compared in a rotated space, one block of
columns after the other: a partial squared distance over t of d columns estimates the whole, and a test with
error bound (1 + ERROR / sqrt(t)) abandons the candidates that are surely beyond the query's bound. The bound
starts as the distance of the query's k-th neighbour in the sample and shrinks within the list. What is left
is scored exactly, in double precision, on the original vectors.

Equal vectors are searched once and stand for their smallest ids, which is all that a top k can hold, so a
vector that fills a third of the table costs one row. Long lists are cut into blocks and queries into groups
of bounded size, which meet pair by pair.

Vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do rows
without vec_id. Repeated rows count once. Vectors of different length are never compared. A query with fewer
than k candidates gets all it can reach. Only vec_id and embedding are read. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandloom.llm.common import table
from demandloom.session import materialise, ship_package

# Columns looked at between two tests, and the test's error parameter.
STEP = 16
ERROR = 2.1
SEED = 7
ROUNDS = 8
# Candidates of one list that are scored exactly, beyond those asked for: room for ties in single precision.
ROOM = 6


class Settings(NamedTuple):
    """sample: numbers (rows times columns) in the sample. share: of the lists, how many a query probes."""
    sample: int = 1 << 20
    lists: int = 1024
    share: float = 0.7
    least: int = 8
    block: int = 4096


class Model(NamedTuple):
    """Centres, the sample, and the list of each of its rows."""
    centres: np.ndarray
    sample: np.ndarray
    lists: np.ndarray


def unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same for everyone."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d]).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def centres_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means; the first rows, whose order is random, are the first centres."""
    centres = sample[:count].copy()
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each length of vector in a list column without nulls."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
    return [(at, flat[starts[at][:, None] + np.arange(d)]) for d in np.unique(lengths) for at in [np.flatnonzero(lengths == d)]]


def scan(query: np.ndarray, bound: float, members: np.ndarray, k: int) -> np.ndarray:
    """Positions of at most ``k`` nearest members within ``bound`` (a squared distance), some abandoned early."""
    d = len(query)
    alive, partial = np.arange(len(members)), np.zeros(len(members), np.float32)
    for t in range(0, d, STEP):
        end = min(t + STEP, d)
        apart = members[alive, t:end] - query[t:end]
        partial = partial + (apart * apart).sum(1)
        limit = bound if end == d else bound * (end / d) * (1 + ERROR / np.sqrt(end)) ** 2
        keep = partial <= limit
        alive, partial = alive[keep], partial[keep]
        if not len(alive):
            break
    return alive[np.argsort(partial, kind="stable")[:k]]


def _valid(column: Column) -> Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(column) > 0) & ~bad & F.exists(column, lambda x: x != 0)


def _model(distinct: DataFrame, settings: Settings) -> tuple[dict[int, Model], int]:
    """For each length of vector in the sample, the centres and the sample itself; and the number of vectors."""
    sizes = distinct.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(16).collect()
    models, rows = {}, 0
    for d, n in sizes:
        rows += n
        some = distinct.where(F.size("embedding") == d).select("embedding").orderBy(F.xxhash64("rid"), "rid").limit(max(64, settings.sample // d))
        column = some.toArrow().column(0).combine_chunks()
        sample = unit(matrix(column)[0][1].astype(np.float64)).astype(np.float32)
        count = int(max(1, min(settings.lists, round(np.sqrt(n)), len(sample))))
        centres = centres_of(sample, count)
        models[d] = Model(centres, sample, (sample @ centres.T).argmax(1))
    return models, rows


def neighbours(vectors: DataFrame, is_query: Column, k: int, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row for which ``is_query`` holds.

    ``is_query`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    held = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).where(
        F.col("vec_id").isNotNull() & _valid(F.col("embedding")))
    # The k + 1 smallest ids of each distinct vector; the window's limit is applied before the shuffle, too.
    order = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = held.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    distinct = materialise(ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn(
        "rid", F.col("ids")[0]))
    asked = materialise(held.where(is_query).distinct().join(distinct.select("embedding", "rid"), "embedding").select("vec_id", "rid", "embedding"))
    models, _ = _model(distinct, settings)
    sent = spark.sparkContext.broadcast(models)
    ways = asked.select("rid", "embedding").dropDuplicates(["rid"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int32)
            for at, rows in matrix(batch.column(1)):
                if rows.shape[1] in sent.value:
                    found[at] = (unit(rows.astype(np.float64)).astype(np.float32) @ sent.value[rows.shape[1]].centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["rid", "embedding", "ids", "list"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The probed lists, and the squared distance that bounds the k nearest of what they hold of the sample."""
        for batch in batches:
            lists, bounds = [[0]] * batch.num_rows, np.full(batch.num_rows, np.inf)
            for at, rows in matrix(batch.column(1)):
                if model := sent.value.get(rows.shape[1]):
                    queries = unit(rows.astype(np.float64)).astype(np.float32)
                    probes = min(len(model.centres), max(settings.least, int(np.ceil(settings.share * len(model.centres)))))
                    nearest = np.argsort(-(queries @ model.centres.T), axis=1)[:, :probes]
                    for i, near in zip(at, nearest):
                        lists[i] = near.tolist()
                    if len(model.sample) > k + 1:  # the query itself may be in the sample
                        for some in np.array_split(np.arange(len(at)), max(1, len(at) // 256)):
                            probed = np.zeros((len(some), len(model.centres)), bool)
                            np.put_along_axis(probed, nearest[some], True, axis=1)
                            close = np.where(probed[:, model.lists], queries[some] @ model.sample.T, -2)
                            close = np.partition(close, -(k + 2), axis=1)[:, -(k + 2)]
                            bounds[at[some]] = np.where(close > -1.5, (2 - 2 * close) * 1.0001 + 1e-5, np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds), pa.array(lists, pa.list_(pa.int32()))], names=["rid", "embedding", "bound", "lists"])

    width = F.size("embedding").alias("d")
    members = distinct.select("rid", "embedding", "ids").mapInArrow(listed, "rid long, embedding array<float>, ids array<long>, list int")
    members = materialise(members.select("rid", "embedding", "ids", width, "list"))
    queries = ways.mapInArrow(probing, "rid long, embedding array<float>, bound double, lists array<int>").select(
        "rid", "embedding", "bound", width, F.explode("lists").alias("list"))
    # The lists' sizes: at most settings.lists rows for each length of vector.
    blocks = members.groupBy("d", "list").agg(F.ceil(F.count(F.lit(1)) / settings.block).cast("int").alias("blocks"))
    groups = queries.groupBy("d", "list").agg(F.ceil(F.count(F.lit(1)) / settings.block).cast("int").alias("groups"))
    sizes = F.broadcast(blocks.join(groups, ["d", "list"]))
    own = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None)
    left = members.join(sizes, ["d", "list"]).select(
        "d", "list", own("blocks").alias("block"), every("groups").alias("group"), "rid", "embedding", "ids", none.cast("double").alias("bound"))
    right = queries.join(sizes, ["d", "list"]).select(
        "d", "list", every("blocks").alias("block"), own("groups").alias("group"), "rid", "embedding", none.cast("array<long>").alias("ids"), "bound")
    dealt = left.unionByName(right).repartition("d", "list", "block", "group").sortWithinPartitions("d", "list", "block", "group")
    found = dealt.mapInArrow(_searching(k), "qid long, ids array<long>, score double")
    # The best k + 1 ids of each distinct query vector hold the best k of each of its rows.
    each = found.select("qid", "score", F.explode("ids").alias("vec_id"))
    best = lambda key: Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("place", F.row_number().over(best("qid"))).where(F.col("place") <= k + 1).drop("place")
    rows = asked.select(F.col("vec_id").alias("query_id"), "rid").join(top, F.col("rid") == F.col("qid")).where(F.col("vec_id") != F.col("query_id"))
    return rows.withColumn("rank", F.row_number().over(best("query_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searching(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            vectors = matrix(group.column(5))[0][1]
            bound = group.column(7).to_numpy(zero_copy_only=False)
            members, queries = np.flatnonzero(np.isnan(bound)), np.flatnonzero(~np.isnan(bound))
            if not len(members) or not len(queries):
                continue
            exact = vectors.astype(np.float64)
            turned = unit(exact).astype(np.float32) @ rotation(vectors.shape[1])
            lengths = np.sqrt((exact * exact).sum(1))
            there, rids, ids = turned[members], group.column(4).to_numpy(), group.column(6)
            out: tuple[list, list, list] = ([], [], [])
            for q in queries:
                near = members[scan(turned[q], bound[q], there, k + 1 + ROOM)]
                out[0].extend([rids[q]] * len(near))
                out[1].extend(near)
                out[2].extend(((exact[near] * exact[q]).sum(1) / (lengths[near] * lengths[q])).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), ids.take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.float64())], names=["qid", "ids", "score"])

    return search


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch for each run of rows with equal first four columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and tuple(keys[a]) != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, 5)
    return found.select("query_id", "rank", "vec_id", "score")
