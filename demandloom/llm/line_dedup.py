"""Line deduplication by content-defined chunks. SQL functions only.

A document's lines are hashed, and the lines that occur again anywhere are found first. A chunk ends where repeated
lines meet lines that occur once. Inside such a stretch a rolling hash over the last two line hashes marks one line in
``MODULUS``, and a chunk ends at a marked line whose predecessor isn't marked, so the same run of lines is cut alike
wherever it stands and no chunk of a longer stretch has a single line. Chunks of two or more lines that occur again
anywhere are compared byte for byte; of equal ones the first by (doc_id, position) stays.

All this works on line hashes, far smaller than the texts; only documents with a repeated chunk bring their bytes to
the comparison. What is read twice is checkpointed, so a frequent line's rows are dealt anew and can be split.

``remove_runs`` cuts out every run of two or more lines that an earlier place holds, wherever it begins; the pipeline
uses it. ``report`` and ``remove`` keep to the chunks, which the oracle states.

Null text stays null; what repeats entirely becomes empty. Documents of one line, and chunks without a visible
character, are never touched. Rows that share a doc_id
count as one document, whose places are ordered by position, rows without doc_id are left as they are, columns other than
doc_id and text are passed on by ``remove`` and neither read nor returned by ``report``. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.common import free_name, let, table
from demandloom.session import materialise

# One rolling hash in MODULUS marks a line.
MODULUS = 4
FACTOR = 31


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunks(lines: Column) -> Column:
    """array<struct<start, n, key>>: the chunks of lines given as struct<h, key, solid, again>, from line 0; none without a visible character."""
    def at(i):
        return F.get(lines, i)

    def opens(i):
        """Whether a stretch begins at line i, or the text has ended before it."""
        return F.coalesce((i == 0) | (at(i)["again"] != at(i - 1)["again"]), F.lit(True))

    def marked(i):
        return (at(i)["h"] + F.when(opens(i), 0).otherwise(at(i - 1)["h"]) * FACTOR) % MODULUS == 0

    def ends(i):
        return marked(i) & ~opens(i) & ~marked(i - 1) & ~opens(i + 1) & ~opens(i + 2)

    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.when(opens(i), True).otherwise(ends(i - 1)))

    def one(found):
        return F.transform(found, lambda start, k: let(
            F.slice(lines, start + 1, F.coalesce(F.get(found, k + 1), F.size(lines)) - start),
            lambda own: F.struct(
                start.alias("start"), F.size(own).alias("n"),
                F.when(F.exists(own, lambda x: x["solid"]), F.xxhash64(F.transform(own, lambda x: x["key"]))).alias("key"))))

    return let(starts, one)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), lines (array<struct<h, key, solid, again>>) of every text; ``again``: the line occurs elsewhere."""
    def marks(line):
        return F.struct(line_hash(line).alias("h"), F.xxhash64(line).alias("key"), F.regexp_like(line, F.lit(r"\S")).alias("solid"))

    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("row"), F.transform(
        F.split("text", "\n", -1), marks).alias("lines")).dropDuplicates(["doc_id", "row"])
    each = materialise(texts.select("doc_id", "row", F.posexplode("lines").alias("k", "line")).select("doc_id", "row", "k", "line.*"))
    again = materialise(each.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("key", F.lit(True).alias("again")))
    told = each.join(again, "key", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    listed = told.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("k", "h", "key", "solid", "again"))).alias("lines"))
    return listed.select("doc_id", "row", F.transform("lines", lambda x: F.struct(*[x[c].alias(c) for c in ("h", "key", "solid", "again")])).alias("lines"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, row, start, n: every chunk of two or more lines that an earlier place holds byte for byte."""
    docs = docs.select("doc_id", "text")
    cut = hashed_lines(docs).select("doc_id", "row", F.explode(chunks(F.col("lines"))).alias("c")).select("doc_id", "row", "c.*")
    cut = materialise(cut.where("n >= 2 AND key IS NOT NULL"))
    again = cut.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("key")
    held = cut.join(materialise(again), "key").groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("wanted"))
    bodies = docs.withColumn("row", F.xxhash64("text")).join(materialise(held), ["doc_id", "row"]).select(
        "doc_id", "row", "wanted", F.split("text", "\n", -1).alias("lines")).select("doc_id", "row", F.explode(F.transform(
            "wanted", lambda x: F.struct(x["start"], x["n"], F.array_join(F.slice("lines", x["start"] + 1, x["n"]), "\n").alias("body")))).alias("c"))
    places = materialise(bodies.select(
        F.xxhash64("c.body").alias("key"), "c.body", F.struct("doc_id", F.col("c.start"), "row", F.col("c.n")).alias("place")).distinct())
    first = materialise(places.groupBy("key", "body").agg(F.min("place").alias("first")))
    return places.join(first, ["key", "body"]).where(F.col("place") != F.col("first")).select("place.doc_id", "place.row", "place.start", "place.n")


def runs_of_two(text: Column) -> Column:
    """array<struct<n, body>>: every two lines in a row."""
    return let(F.split(text, "\n", -1), lambda lines: F.when(F.size(lines) > 1, F.transform(
        F.sequence(F.lit(1), F.size(lines) - 1),
        lambda i: F.struct(F.lit(2).alias("n"), F.array_join(F.slice(lines, i, 2), "\n").alias("body")))))


def _numbered(docs: DataFrame, parts) -> DataFrame:
    """doc_id, row (a hash of the text), k, n, body of every part that may be removed."""
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("row"), F.posexplode(parts(F.col("text"))).alias("k", "chunk")
    ).select("doc_id", "row", "k", F.col("chunk.n").alias("n"), F.col("chunk.body").alias("body")).where(
        (F.col("n") >= 2) & F.regexp_like("body", F.lit(r"\S")))


def repeated_parts(docs: DataFrame, parts) -> DataFrame:
    """doc_id, row, k; first: every part that an earlier place holds byte for byte, and that place.

    Rows that share a doc_id but not their text are told apart by ``row``.
    """
    docs = docs.select("doc_id", "text")
    keys = _numbered(docs, parts).select("doc_id", "row", "k", F.xxhash64("body").alias("key"))
    # Written out first, so that the join deals both sides anew and a frequent key's rows can be split.
    again = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    held = materialise(keys.join(again, "key").groupBy("doc_id", "row").agg(F.collect_set("k").alias("ks")))
    bodies = docs.withColumn("row", F.xxhash64("text")).join(held, ["doc_id", "row"]).select(
        "doc_id", "row", "ks", parts(F.col("text")).alias("chunks")).select(
        "doc_id", "row", F.explode("ks").alias("k"), "chunks").select("doc_id", "row", "k", F.get("chunks", F.col("k"))["body"].alias("body"))
    places = materialise(bodies.select(F.xxhash64("body").alias("key"), "body", F.struct("doc_id", "k", "row").alias("place")))
    first = materialise(places.groupBy("key", "body").agg(F.min("place").alias("first")))
    again = places.join(first, ["key", "body"]).where(F.col("place") != F.col("first"))
    return again.select("place.doc_id", "place.row", "place.k", "first")


def _without(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, str]:
    """The documents without the lines of ``gone`` (doc_id, row, start, n), and the name of the column with its ranges."""
    marks, ids, rows = (free_name(name, docs.columns) for name in ("gone", "gone_id", "gone_row"))
    gone = gone.groupBy(F.col("doc_id").alias(ids), F.col("row").alias(rows)).agg(F.collect_set(F.struct("start", "n")).alias(marks))
    found = docs.join(gone, (F.col("doc_id") == F.col(ids)) & (F.xxhash64("text") == F.col(rows)), "left").drop(ids, rows)

    def left(lines):
        lost = F.flatten(F.transform(marks, lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost), lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col(marks).isNull(), F.col("text")).otherwise(let(F.split("text", "\n", -1), left))
    return found.withColumn("text", text), marks


def remove_runs(docs: DataFrame) -> DataFrame:
    """The same rows and columns, without any run of two or more lines that an earlier place holds.

    The earliest copy of every line stays. Of one line many times in a row two are left.
    """
    again = repeated_parts(docs, runs_of_two)
    beside = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.row") == F.col("row")) & (F.col("first.k") == F.col("k") - 1)
    lines = again.select("doc_id", "row", F.when(beside, F.col("k") + 1).otherwise(F.col("k")).alias("start"), F.when(beside, 1).otherwise(2).alias("n"))
    return _without(docs, lines)[0].select(*docs.columns)


def remove(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with repeated chunks cut out of ``text``."""
    return _without(docs, repeated_chunks(docs))[0].select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, what is left of the text, and how many chunks and lines went."""
    found, marks = _without(docs.select("doc_id", "text"), repeated_chunks(docs))
    lines = F.aggregate(marks, F.lit(0).cast("long"), lambda total, x: total + x["n"])
    return found.select(
        "doc_id", "text", F.when(F.col(marks).isNull(), 0).otherwise(F.size(marks)).cast("long").alias("removed_chunks"),
        F.when(F.col(marks).isNull(), 0).otherwise(lines).cast("long").alias("removed_lines"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH split_lines AS (
  SELECT doc_id, text, unnest(str_split(text, chr(10))) AS line,
         generate_subscripts(str_split(text, chr(10)), 1) AS i
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, count(*) OVER (PARTITION BY line) > 1 AS again FROM split_lines),
turned AS (
  SELECT *, again IS DISTINCT FROM lag(again) OVER (PARTITION BY doc_id ORDER BY i) AS turn FROM hashed),
stretched AS (
  SELECT *, sum(CAST(turn AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM turned),
marked AS (
  SELECT *, (h + {FACTOR} * coalesce(lag(h) OVER d, 0)) % {MODULUS} = 0 AS mark, row_number() OVER d AS j,
         count(*) OVER (PARTITION BY doc_id, s) AS lines
  FROM stretched WINDOW d AS (PARTITION BY doc_id, s ORDER BY i)),
ended AS (
  SELECT *, turn OR coalesce(lag(mark) OVER d AND NOT lag(mark, 2) OVER d AND j - 1 BETWEEN 2 AND lines - 2, false) AS starts
  FROM marked WINDOW d AS (PARTITION BY doc_id, s ORDER BY i)),
numbered AS (
  SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM ended),
parts AS (
  SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, k),
ranked AS (
  SELECT *, n >= 2 AND regexp_matches(body, '\\S')
            AND row_number() OVER (PARTITION BY body ORDER BY doc_id, k) > 1 AS gone
  FROM parts)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.body, '') END AS text,
       coalesce(x.removed_chunks, 0) AS removed_chunks, coalesce(x.removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone) AS body,
         CAST(count(*) FILTER (gone) AS BIGINT) AS removed_chunks, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS removed_lines
  FROM ranked GROUP BY doc_id) x USING (doc_id)
"""
