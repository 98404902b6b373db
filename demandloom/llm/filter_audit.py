"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

The words of all documents make a sparse document-term matrix. A step of some megabytes of texts is a shard of it, in
compressed rows (CSR): row pointers, columns, counts. A shard first numbers its own distinct words; these lists,
shorter than the texts, are dealt out by word, where one dictionary of the whole table numbers them, and the numbers
go back to the shards as columns. Row sums and numbers of nonzero counts decide filters A and B; C and D are read from
the characters; E asks for the smallest doc_id with the same text (equal SHA-256). Documents are then counted by part
and set of failed filters, at most 32 rows a part, from which all 120 orders follow.

A shard is one row, of some megabytes or of one longer text. A frequent word is one row for each shard, and words are
numbered in sorted order without holding them; documents meet their copies by (text, doc_id), so that no group of
copies is dealt to one task.

Null text counts as empty, null source as the empty part. A row without doc_id has no smaller doc_id, so it never fails
E, and carries no label. Repeated rows count each time; several labels of a doc_id count as good or toxic if one says
so. An empty table gives an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.common import table, text_steps
from demandloom.llm.words import Texts, byte_set, joined, words
from demandloom.session import materialise

FILTERS = "ABCDE"
FEWEST_WORDS = 200
# Percent.
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
CAPITALS = byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SYMBOLS = byte_set("#$%&*|")

# What a shard holds besides the matrix: its documents in order.
DOCUMENT = "array<struct<doc_id:bigint,part:string,capitals:bigint,points:bigint,symbols:bigint,digest:binary>>"
DOCUMENT_TYPE = pa.struct([
    ("doc_id", pa.int64()), ("part", pa.string()), ("capitals", pa.int64()), ("points", pa.int64()), ("symbols", pa.int64()),
    ("digest", pa.binary())])


# Bytes of text in a shard: longer shards repeat fewer words in their lists.
SHARD_BYTES = 8 << 20
# Rows that a task of the dictionary holds before it sends their numbers to the shards.
HELD = 1 << 20
SHARD_FIELDS = f"documents {DOCUMENT}, pointers binary, columns binary, counts binary"


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(values: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(values), kind)


def local_shards(docs: DataFrame) -> DataFrame:
    """shard, documents, pointers, columns, counts, sizes, letters: shards whose columns number their own list of words.

    ``docs`` has doc_id, part and text. The arrays are compressed bytes: pointers 64-bit, columns and counts 32-bit; the
    list of words is their sizes, 32-bit, and all their bytes.
    """
    kinds = pa.schema([("documents", pa.list_(DOCUMENT_TYPE)), *((x, pa.binary()) for x in ("pointers", "columns", "counts", "sizes", "letters"))])

    def shard(batch: pa.RecordBatch, bodies: list[bytes]) -> tuple:
        texts = Texts.of(bodies)
        found = words(texts)
        n = max(1, len(found.values))
        keys, counts = np.unique(found.text * n + found.codes, return_counts=True)
        pointers = np.searchsorted(keys, np.arange(len(bodies) + 1) * n)
        documents = [dict(zip(("doc_id", "part", "capitals", "points", "symbols", "digest"), row)) for row in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts.sums(CAPITALS[texts.data]).tolist(),
            texts.sums(texts.points()).tolist(), texts.sums(SYMBOLS[texts.data]).tolist(), (hashlib.sha256(x).digest() for x in bodies))]
        sizes = pc.binary_length(found.values).to_numpy(zero_copy_only=False)
        return documents, *map(_packed, (
            pointers.astype(np.int64), (keys % n).astype(np.int32), counts.astype(np.int32), sizes.astype(np.int32), joined(found.values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in text_steps(batches, step=SHARD_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(shard(batch, bodies), kinds)], schema=kinds)

    found = docs.select(F.col("doc_id").cast("long"), "part", "text").mapInArrow(run, f"{SHARD_FIELDS}, sizes binary, letters binary")
    # Kept, so that a shard keeps its number when an executor is lost.
    return materialise(found.withColumn("shard", F.monotonically_increasing_id()))


def _entries(shards: DataFrame) -> DataFrame:
    """word, shard, code: the shards' lists of words, dealt out by word and sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = _unpacked(batch.column(1)[i].as_py(), np.int32)
                letters = _unpacked(batch.column(2)[i].as_py(), np.uint8)
                offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                for at in range(0, len(sizes), 1 << 16):
                    part = offsets[at:at + (1 << 16) + 1]
                    own = pa.Array.from_buffers(pa.binary(), len(part) - 1, [
                        None, pa.py_buffer((part - part[0]).astype(np.int32)), pa.py_buffer(letters[part[0]:part[-1]].tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [own, pa.array(np.full(len(own), batch.column(0)[i].as_py())), pa.array(np.arange(at, at + len(own), dtype=np.int32))],
                        names=["word", "shard", "code"])

    lists = shards.select("shard", "sizes", "letters").mapInArrow(run, "word binary, shard long, code int")
    count = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(count, "word").sortWithinPartitions("word")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Sorted batches with which rows begin a new word, and each row's number: the task's partition and the word's place in it."""
    base, count, last = TaskContext.get().partitionId() << 40, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(0)
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        new[0] = column[0].as_py() != last
        places = count + np.cumsum(new)
        count, last = int(places[-1]), column[len(column) - 1].as_py()
        yield batch, new, base + places - 1


def dictionary(shards: DataFrame) -> DataFrame:
    """word, id: every word of the shards' lists once, as bytes, with its number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, new, ids in _numbered(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(new)), pa.array(ids[new])], names=["word", "id"])

    return _entries(shards).mapInArrow(run, "word binary, id long")


def _numbers(shards: DataFrame) -> DataFrame:
    """shard, codes, ids: for each shard, the dictionary's numbers of its own, in compressed lists."""
    def lists(held: list[tuple]) -> pa.RecordBatch:
        shard, code, ids = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]]))
        groups = np.split(order, cuts[1:])
        return pa.RecordBatch.from_arrays([
            pa.array([int(shard[g[0]]) for g in groups]), pa.array([_packed(code[g]) for g in groups], pa.binary()),
            pa.array([_packed(ids[g]) for g in groups], pa.binary())], names=["shard", "codes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, _, ids in _numbered(batches):
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), ids))
            size += len(ids)
            if size >= HELD:
                yield lists(held)
                held, size = [], 0
        if held:
            yield lists(held)

    return _entries(shards).mapInArrow(run, "shard long, codes binary, ids binary")


def document_terms(docs: DataFrame) -> DataFrame:
    """shard, documents, pointers, columns, counts: the matrix, its columns numbered by the dictionary of all documents.

    Columns are 64-bit; inside a row they are in the order of the shard's own numbers.
    """
    shards = local_shards(docs)
    numbers = _numbers(shards)

    def meet(own: pa.Table, lists: pa.Table) -> pa.Table:
        codes, ids = ([_unpacked(x, kind) for x in lists.column(name).to_pylist()] for name, kind in (("codes", np.int32), ("ids", np.int64)))
        found = np.zeros(sum(map(len, codes)), np.int64)
        for code, id_ in zip(codes, ids):
            found[code] = id_
        columns = found[_unpacked(own.column("columns")[0].as_py(), np.int32)]
        return own.set_column(own.schema.get_field_index("columns"), "columns", pa.array([_packed(columns)], pa.binary()))

    kept = shards.select("shard", "documents", "pointers", "columns", "counts")
    return kept.groupBy("shard").cogroup(numbers.groupBy("shard")).applyInArrow(meet, f"shard long, {SHARD_FIELDS}")


def row_statistics(matrix: DataFrame) -> DataFrame:
    """One row per document: its sum of counts, its number of nonzero counts, and what the shard holds of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pointers = _unpacked(batch.column(1)[i].as_py(), np.int64)
                upto = np.concatenate([[0], np.cumsum(_unpacked(batch.column(2)[i].as_py(), np.int32), dtype=np.int64)])
                documents = batch.column(0).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [*(documents.field(k) for k in range(documents.type.num_fields)), pa.array(np.diff(upto[pointers])), pa.array(np.diff(pointers))],
                    names=[*(f.name for f in DOCUMENT_TYPE), "n_words", "n_distinct"])

    return matrix.select("documents", "pointers", "counts").mapInArrow(
        run, "doc_id long, part string, capitals long, points long, symbols long, digest binary, n_words long, n_distinct long")


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters that they fail, a bit each, and by label."""
    rows = row_statistics(document_terms(docs.select(
        "doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))))
    plain = sum((F.when(fails, bit(letter)).otherwise(0) for letter, fails in (
        ("A", F.col("n_words") < FEWEST_WORDS), ("B", 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words")),
        ("C", 100 * F.col("capitals") > MOST_CAPITALS * F.col("points")), ("D", F.col("symbols") > 0))), F.lit(0))
    counted = materialise(rows.groupBy("digest", "doc_id", "part", plain.alias("mask")).agg(F.count(F.lit(1)).alias("n")))
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marked = counted.join(first, ["digest", "doc_id"], "left")
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    later = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    sums = [F.sum(F.col("n") * F.coalesce(F.col(x), F.lit(0))).alias(x) for x in ("good", "toxic")]
    return marked.join(marks, "doc_id", "left").groupBy(
        "part", (F.col("mask") + F.when(later, bit("E")).otherwise(0)).alias("mask")).agg(F.sum("n").alias("n"), *sums)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with what the step's filter does there."""
    sets = failures(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))
    orders = F.lit(["".join(x) for x in itertools.permutations(FILTERS)])

    def mask(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(x)), bit(x)).otherwise(0) for x in FILTERS), F.lit(0))

    steps = sets.select("part", "sets", F.explode(orders).alias("filter_order")).select(
        "part", "sets", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")).select(
        "*", mask(F.substring("filter_order", F.col("step"), F.lit(1))).alias("own"),
        mask(F.substring("filter_order", F.lit(1), F.col("step") - 1)).alias("before"))

    def total(value) -> Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda sum_, s: sum_ + value(s))

    def where(held, column: str):
        return lambda s: F.when(held(s["mask"].bitwiseAND(F.col("own")) > 0, s["mask"].bitwiseAND(F.col("before")) > 0), s[column]).otherwise(0)

    removed = lambda own, before: own & ~before
    # Of a set of k failed filters each is the first in 120/k of the 120 orders.
    firsts = F.lit(120).cast("long")
    return steps.select(
        "part", "filter_order", "step",
        total(where(lambda own, before: ~own & ~before, "n")).alias("kept"),
        total(where(removed, "n")).alias("removed"),
        total(where(lambda own, before: own & before, "n")).alias("redundant"),
        total(lambda s: F.when(s["mask"] == F.col("own"), s["n"]).otherwise(0)).alias("unique_fails"),
        total(where(removed, "good")).alias("good_lost"),
        total(where(removed, "toxic")).alias("toxic_lost"),
        total(lambda s: F.when(
            s["mask"].bitwiseAND(F.col("own")) > 0,
            s["n"] * (firsts / F.bit_count(s["mask"])).cast("long")).otherwise(0)).alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM texts),
marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    concat(
      CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END,
      CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN s.doc_id > min(s.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM split s LEFT JOIN marks m ON s.doc_id = m.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
sets AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
applied AS (
  SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS here,
         earlier <> '' AND translate(fails, earlier, '') <> fails AS gone
  FROM sets, steps)
SELECT part, filter_order, step,
       CAST(coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (here AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (here AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (here AND NOT gone), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(sum(n) FILTER (here AND NOT gone), 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM applied GROUP BY part, filter_order, step, own
"""
