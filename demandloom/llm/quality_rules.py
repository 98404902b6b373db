r"""Quality rules: counts over a document's words and lines, and lines that too many documents of a host share.

Lines are normalised (A-Z lower-case, digits to 0, blanks squeezed) and hashed with their host. A line that more than
``LIMIT`` different texts of its host hold is boilerplate there. It is removed; a document that keeps less than
``LEAST_LEFT`` percent of its words is depleted and rejected, as is one that fails a rule on its own counts. Exact
copies count as one text, so that they alone make no line boilerplate; removing them is another operator's work.

The texts are read once. What is left of them, a hash and a number of words for each line, is written out and counted in
two steps, by (line, text) and by line, so that a line which a third of all documents hold is summed before it meets a
task; the join that hands the verdicts out has the documents on the side that can be split.

The host is the column ``source`` (null, or no such column: one host without a name). Null text counts as empty and has
no words; it fails the rules. Lines without a word are no lines here. Rows are judged one by one: repeated rows give
repeated results, an empty table an empty one; ``report`` reads no other columns, ``clean`` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.common import free_name, table, text_steps
from demandloom.llm.words import Texts, byte_set, dense, lines, words
from demandloom.session import materialise

# A line in more different texts of one host is boilerplate.
LIMIT = 10
# Percent of its words that a document must keep.
LEAST_LEFT = 50
FEWEST_WORDS = 50
# Percent of words in repeated three-word windows.
MOST_REPEATED = 50
SYMBOLS = byte_set("#*$%&|<>")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789\t\x0b\x0c\r"
_TO = "abcdefghijklmnopqrstuvwxyz000000000    "


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, _FROM, _TO), "  +", " "))


def host_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def text_mark(docs: DataFrame) -> Column:
    return F.xxhash64(host_of(docs), F.coalesce(F.col("text"), F.lit("")))


def line_marks(text: Column, host: Column) -> Column:
    """array<struct<key, words>>: each line's hash with its host, and its number of words; without words, null and 0."""
    def mark(line):
        blank = line == ""
        return F.struct(
            F.when(~blank, F.xxhash64(host, line)).alias("key"),
            F.when(blank, 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words"))

    return F.transform(F.transform(F.split(text, "\n", -1), normalised), mark)


def counts(bodies: list[bytes]) -> list[np.ndarray]:
    """The numbers of ``COUNTS`` of each text."""
    texts = Texts.of(bodies)
    found = words(texts)
    n = len(bodies)
    n_words = np.bincount(found.text, minlength=n)
    blank = byte_set(" \t\n\r\x0b\x0c")
    # Lines with a word, less the different ones.
    split = lines(texts)
    solid = np.fromiter((bool(x.strip()) for x in split.values.to_pylist()), bool, len(split.values))
    text, codes = split.text[solid[split.codes]], split.codes[solid[split.codes]]
    different = np.unique(text * max(1, len(split.values)) + codes) // max(1, len(split.values))
    n_dup_lines = np.bincount(text, minlength=n) - np.bincount(different, minlength=n)
    # Windows of three words of one text that occur again in it.
    repeated = np.zeros(len(found.codes), bool)
    if len(found.codes) > 2:
        at = np.flatnonzero(found.text[2:] == found.text[:-2])
        windows = dense(found.text[at], found.codes[at], found.codes[at + 1], found.codes[at + 2])
        again = at[np.bincount(windows)[windows] > 1]
        for shift in range(3):
            repeated[again + shift] = True
    n_repeat_words = np.bincount(found.text, weights=repeated, minlength=n).astype(np.int64)
    return [n_words, texts.sums(texts.points() & ~blank[texts.data]), texts.sums(SYMBOLS[texts.data]), n_dup_lines, n_repeat_words]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, row, mark (a hash of host and text), lines and the counts of each row; written out."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in text_steps(batches, 3):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(x.astype(np.int64)) for x in counts(bodies))], names=["doc_id", "mark", "lines", *COUNTS])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_mark(docs).alias("mark"), line_marks(text, host_of(docs)).alias("lines"), text.alias("text"))
    found = rows.mapInArrow(
        run, "doc_id long, mark long, lines array<struct<key:bigint,words:int>>, " + ", ".join(f"{x} long" for x in COUNTS))
    return materialise(found.withColumn("row", F.monotonically_increasing_id()))


def frequent_lines(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """key, texts: the lines that more than ``limit`` different texts of their host hold."""
    held = rows.select("mark", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key")).where("key IS NOT NULL")
    return held.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > limit)


def judged(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows, with the numbers of lines and words that go, and both verdicts."""
    gone = rows.select("row", F.explode("lines").alias("line")).select("row", "line.key", "line.words").join(
        frequent.select("key"), "key").groupBy("row").agg(F.count(F.lit(1)).alias("gone_lines"), F.sum("words").alias("gone_words"))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    found = rows.join(gone, "row", "left").withColumns({x: F.coalesce(F.col(x), F.lit(0).cast("long")) for x in ("gone_lines", "gone_words")})
    return found.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (100 * (F.col("n_words") - F.col("gone_words")) >= LEAST_LEFT * F.col("n_words")))


def report(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, the counts, the lines and words that go as boilerplate, and both verdicts."""
    rows = measured(docs)
    return judged(rows, frequent_lines(rows, limit)).select("doc_id", *COUNTS, "gone_lines", "gone_words", "base_failed", "kept")


def clean(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows that are kept, with all columns, without their boilerplate lines.

    A document meets its boilerplate by doc_id and the hash of its host and text; rows with both equal are alike.
    """
    doc_id, mark, gone = (free_name(x, docs.columns) for x in ("own_id", "own_mark", "boilerplate"))
    rows = measured(docs)
    frequent = materialise(frequent_lines(rows, limit))
    keys = rows.select("row", F.explode("lines.key").alias("key")).join(frequent.select("key"), "key").groupBy("row").agg(
        F.collect_set("key").alias(gone))
    lists = judged(rows, frequent).where("kept").join(keys, "row", "left").groupBy(
        F.col("doc_id").alias(doc_id), F.col("mark").alias(mark)).agg(F.first(gone, True).alias(gone))
    joined = docs.join(lists, F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (text_mark(docs) == F.col(mark)))
    left = F.filter(F.split("text", "\n", -1), lambda x: ~F.coalesce(
        F.array_contains(gone, F.xxhash64(host_of(docs), normalised(x))), F.lit(False)))
    return joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).select(*docs.columns)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
counted AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM texts),
windows AS (
  SELECT r, i, list_slice(ws, i, i + 2) AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM counted)),
again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeated AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
split AS (
  SELECT r, host, t, unnest(str_split(t, chr(10))) AS line FROM texts),
solid AS (
  SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM split),
dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM solid WHERE len(ws) > 0 GROUP BY r),
plain AS (
  SELECT r, host, t, len(ws) AS words,
         array_to_string(list_transform(ws, lambda x: translate(x, '{_FROM[:35]}', '{_TO[:35]}')), ' ') AS line
  FROM solid WHERE len(ws) > 0),
frequent AS (
  SELECT host, line FROM plain GROUP BY host, line HAVING count(DISTINCT t) > {LIMIT}),
gone AS (
  SELECT r, count(*) AS gone_lines, sum(words) AS gone_words FROM plain JOIN frequent USING (host, line) GROUP BY r),
counts AS (
  SELECT c.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone_lines, 0) AS gone_lines,
         CAST(coalesce(gone_words, 0) AS BIGINT) AS gone_words
  FROM counted c LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
       AND 100 * (n_words - gone_words) >= {LEAST_LEFT} * n_words AS kept
FROM counts
"""
