"""SimHash near-duplicates with BK-trees.

A text's fingerprint has 64 bits; a bit is set if over half of its shingle hashes have it set. Documents
whose fingerprints differ in at most ``radius`` bits are linked, and components of links are classes.

Equal fingerprints are merged first, so exact copies cost one row each. Fingerprints then meet only where
some ``blocks - radius`` of ``blocks`` bit blocks agree, which holds for every pair within the radius.
Rows that agree form a group; a group is cut into shards of about ``SHARD`` fingerprints, each shard is
built into a BK-tree (children keyed by their Hamming distance to the parent) and its tree is sent to
every shard of the group, whose fingerprints follow only the edges within the radius. A task so holds two
shards at most, and writes its links as a spanning forest, not as all pairs.

Null and empty texts have fingerprint zero and are linked like any other. Rows that share a doc_id are
separate rows here. A null doc_id takes part; it never becomes a class id unless the class has no other.
Columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.common import free_name, row_groups, table, text_steps, written
from demandloom.llm.components import components
from demandloom.session import materialise, ship_package

SEED = 42
BITS = 64
# Fingerprints in a shard tree, on average.
SHARD = 2048
# Shingles whose bits are counted at a time.
STEP = 1 << 16


def fingerprint(data: bytes, width: int) -> int:
    """The unsigned fingerprint of a text's shingles of ``width`` words."""
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    over = min(width, len(words)) - 1
    starts, ends = starts[: len(words) - over].tolist(), ends[over:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), STEP):
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts[at:at + STEP], ends[at:at + STEP])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fp (a signed long with the fingerprint's bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches):
            found = np.array([fingerprint(x, width) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers in a tree whose children are keyed by their Hamming distance to the parent."""

    def __init__(self, values):
        values = iter(values)
        self.root = (next(values), {})
        for value in values:
            node = self.root
            while True:
                apart = (node[0] ^ value).bit_count()
                if not apart:
                    break
                child = node[1].get(apart)
                if child is None:
                    node[1][apart] = (value, {})
                    break
                node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        left = [self.root]
        while left:
            held, children = left.pop()
            apart = (held ^ value).bit_count()
            if apart <= radius:
                yield held
            if children:
                if len(children) <= 2 * radius:
                    left += [child for d, child in children.items() if -radius <= d - apart <= radius]
                else:
                    left += [children[d] for d in range(apart - radius, apart + radius + 1) if d in children]


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links found in each (group, shard, shard)."""
    for group in row_groups(batches, 3):
        i, j = group["i"][0], group["j"][0]
        values, shards = group["fp"].astype(np.uint64).tolist(), group["shard"]
        tree = [v for v, s in zip(values, shards) if s == i]
        asked = tree if i == j else [v for v, s in zip(values, shards) if s == j]
        if not tree or not asked:
            continue
        parent: dict[int, int] = {}

        def root(x, parent=parent):
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        held = BKTree(tree)
        for value in asked:
            for other in held.within(value, radius):
                a, b = root(value), root(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    parent.setdefault(min(a, b), min(a, b))
        yield from ((x, r) for x in parent if (r := root(x)) != x)


def _block_keys(fp: Column, radius: int) -> Column:
    """One key for each choice of blocks that must agree: the choice, and a hash-free packing of their bits.

    With radius + 2 blocks, two of them agree in any pair within the radius.
    """
    blocks = radius + 2
    width = -(-BITS // blocks)
    parts = [F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for i in range(blocks)]
    keys = []
    for n, (a, b) in enumerate(combinations(range(blocks), 2)):
        keys.append(F.struct(F.lit(n).alias("pick"), (F.shiftleft(parts[a], width).bitwiseOR(parts[b])).alias("bits")))
    return F.array(*keys)


def links(fps: DataFrame, radius: int) -> DataFrame:
    """a, b: enough links between distinct values of ``fps`` (one column, fp) to connect each class."""
    keyed = fps.select("fp", F.explode(_block_keys(F.col("fp"), radius)).alias("key"))
    keyed = keyed.select("fp", F.xxhash64("key.pick", "key.bits").alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / SHARD).cast("int")
    members = keyed.join(counts, "key").select(
        "key", "fp", shards.alias("shards"), F.pmod(F.xxhash64("fp"), shards).cast("int").alias("shard"))
    dealt = members.select("key", "fp", "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")).select(
        "key", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"), "shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = ((a - (1 << BITS) if a >> 63 else a, b - (1 << BITS) if b >> 63 else b) for a, b in _forest(batches, radius))
        yield from written([("a", pa.int64()), ("b", pa.int64())], signed)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of ``docs``."""
    ship_package(docs.sparkSession)
    marked = materialise(fingerprints(docs, width))
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """One row of ``docs`` for each class, that of the smallest doc_id, with all its columns.

    Rows that share a doc_id leave one. Rows without doc_id stay as they are.
    """
    name = free_name("kept_id", docs.columns)
    kept = classes(docs.select("doc_id", "text"), width, radius).where("doc_id = component_id")
    kept = kept.select(F.col("doc_id").alias(name)).distinct()
    # The rows that share a doc_id are dealt to one place by the join already.
    named = docs.join(kept, F.col("doc_id") == F.col(name), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
