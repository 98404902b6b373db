"""Benchmark decontamination by templates.

Words become canonical: numbers, units and names turn into typed placeholders, other words into lower case
without punctuation at the ends. Windows of ``WINDOW`` canonical words of the documents are joined by hash and
then by text with those of the benchmark, so a question with other numbers or names still meets its source.
Matches on one diagonal (document position less item position) must fill the slots consistently: a value of the item
stands for the value of the document that it meets at most of its places there (ties: the same value, then the largest).
Windows with another value are dropped, those around them stay; a window whose slots are all filled as in the item is
a copy and always counts. A document is contaminated by an item of which the windows left cover ``COVERED`` words, or
``SHARE`` of its words if that is fewer.

The documents' windows first pass a Bloom filter of the benchmark's, whose size is fixed; where a large
benchmark fills it, it lets more through and the join decides alike. Items with equal words count as the
smallest item_id of them. An item shorter than a window is one window; one under ``SHORTEST`` words is ignored.

Null and empty texts match nothing. Rows that share a doc_id count as one document; rows without doc_id, and
items without item_id, take no part (``clean`` keeps such documents). Only doc_id, text and item_id are read;
``clean`` passes other columns on. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.common import free_name, hash_filter, passing, table, text_steps, written
from demandloom.session import materialise, ship_package

WINDOW = 8
SHORTEST = 4
COVERED = 13
SHARE = 0.6
# Bits of the filter; 2 MB, whatever the benchmark.
FILTER_BITS = 1 << 24
REMEMBERED = 500_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)

LITERAL, NUMBER, UNIT, NAME = range(4)
MARKS = ("", "<number>", "<unit>", "<name>")
# Units that a placeholder replaces; fixed values.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles g kg mg lb lbs oz ounce ounces ton tons ml l cl "
    "litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years c f k celsius fahrenheit kelvin usd eur gbp dollar dollars euro euros cent cents percent "
    "% $ € £ mph kmh w kw kwh v volt volts a amp amps hz khz mhz ghz b kb mb gb tb".split())
# Units that are common words or letters, too: they are units only after a number; fixed values.
AFTER_NUMBERS = frozenset("in a second min s m g h l c f k w v b".split())
EDGES = re.compile(r"^[^\w$€£%+-]+|[^\w$€£%]+$")
FIGURE = re.compile(r"^([$€£]?)[+-]?\d[\d.,:/]*([a-zA-Z%€$£]*)$")


def canonical(word: str) -> tuple[str, int, bool]:
    """The word's bare form, what it is inside a sentence, and whether it ends one."""
    bare = EDGES.sub("", word)
    ends = word.rstrip("\"')]}»”’").endswith((".", "!", "?", ":"))
    figure = FIGURE.match(bare)
    if figure and (not figure[2] or figure[2].lower() in UNITS or figure[2].lower() in ("st", "nd", "rd", "th")):
        return bare.lower(), NUMBER, ends
    if bare.lower() in UNITS:
        return bare.lower(), UNIT, ends
    if len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
        return bare.lower(), NAME, ends
    return bare.lower(), LITERAL, ends


class Canon:
    """Words to their numbers in growing tables, looked up once for each distinct word."""

    def __init__(self):
        self._forget()

    def _forget(self):
        self.places: dict[bytes, int] = {}
        self.bare: list[str] = []
        self.rows: list[tuple[int, int, bool, bool, bool]] = []
        self.code, self.kind, self.ends, self.void, self.common = (np.zeros(0, t) for t in (np.uint64, np.int8, bool, bool, bool))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.places) > REMEMBERED:
            self._forget()
        known = len(self.rows)
        for word in set(words).difference(self.places):
            if word.isalpha() and word.islower() and word.decode() not in UNITS:  # bytes: ASCII letters only
                bare, kind, ends = word.decode(), LITERAL, False
            else:
                bare, kind, ends = canonical(word.decode("utf-8", "replace"))
            self.places[word] = len(self.rows)
            self.bare.append(bare)
            self.rows.append((xxhash.xxh64_intdigest(bare), kind, ends, not bare, bare in AFTER_NUMBERS))
        if len(self.rows) > known:
            for name, values in zip(("code", "kind", "ends", "void", "common"), zip(*self.rows[known:])):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.array(values, old.dtype)]))
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))


SLOT_CODES = np.array([0] + [xxhash.xxh64_intdigest(m) for m in MARKS[1:]], np.uint64)


class Texts:
    """Canonical words of a step of texts, one after another."""

    def __init__(self, texts: list[bytes], canon: Canon):
        split = [x.split() for x in texts]
        self.canon = canon
        places = canon([w for one in split for w in one])
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        full = ~canon.void[places]
        self.places, self.owner = places[full], owner[full]
        n = len(self.places)
        # A capital at the start of a sentence doesn't make a name.
        opens = np.ones(n, bool)
        opens[1:] = canon.ends[self.places[:-1]] | (self.owner[1:] != self.owner[:-1])
        self.kind = canon.kind[self.places]
        self.kind = np.where(opens & (self.kind == NAME), LITERAL, self.kind)
        numbered = np.zeros(n, bool)
        numbered[1:] = (self.kind[:-1] == NUMBER) & (self.owner[1:] == self.owner[:-1])
        self.kind = np.where((self.kind == UNIT) & canon.common[self.places] & ~numbered, LITERAL, self.kind)
        self.code = np.where(self.kind == LITERAL, canon.code[self.places], SLOT_CODES[self.kind])
        self.first = np.searchsorted(self.owner, np.arange(len(texts)))
        self.lengths = np.bincount(self.owner, minlength=len(texts))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start of each window inside one text with at least half its words literal, and its hash."""
        n = len(self.code) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hashes = np.full(n, np.uint64(size))
        with np.errstate(over="ignore"):
            for k in range(size):
                hashes = hashes * FACTOR + self.code[k:k + n]
            hashes ^= hashes >> np.uint64(31)
            hashes *= FACTOR
        literal = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        good = (self.owner[:n] == self.owner[size - 1:]) & (2 * (literal[size:] - literal[:n]) >= size)
        at = np.flatnonzero(good)
        return at, hashes[at]

    def window(self, at: int, size: int) -> tuple[str, list[str], list[int]]:
        """Template, slot values, each with its kind, and their places in the window."""
        bare, kinds = self.canon.bare, self.kind[at:at + size].tolist()
        words = [bare[p] for p in self.places[at:at + size].tolist()]
        template = " ".join(MARKS[k] or w for w, k in zip(words, kinds))
        return template, [f"{k}{w}" for w, k in zip(words, kinds) if k], [i for i, k in enumerate(kinds) if k]


COLUMNS = [("id", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("template", pa.string()), ("slots", pa.list_(pa.string())), ("places", pa.list_(pa.int64()))]
SCHEMA = "id long, at long, size long, template string, slots array<string>, places array<long>"


def benchmark_windows(items: DataFrame) -> DataFrame:
    """id, at, size, template, slots, hash, words (of the whole item) of each window of the distinct items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()

        def rows():
            for batch, texts in text_steps(batches):
                ids = batch.column(0).to_pylist()
                found = Texts(texts, canon)
                for size in range(SHORTEST, WINDOW + 1):
                    at, hashes = found.windows(size)
                    for a, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
                        owner = int(found.owner[a])
                        words = int(found.lengths[owner])
                        if size == min(WINDOW, words):
                            yield ids[owner], a - int(found.first[owner]), size, *found.window(a, size), h, words

        yield from written([*COLUMNS, ("hash", pa.int64()), ("words", pa.int64())], rows())

    # Items with equal texts are one item.
    distinct = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("id"))
    found = distinct.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{SCHEMA}, hash long, words long")
    return found.dropDuplicates(["id", "at", "size", "template"])


def document_windows(docs: DataFrame, filled: np.ndarray, sizes: list[int]) -> DataFrame:
    """The documents' windows that the filter lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, held = Canon(), sent.value

        def rows():
            for batch, texts in text_steps(batches):
                ids = batch.column(0).to_pylist()
                found = Texts(texts, canon)
                for size in sizes:
                    at, hashes = found.windows(size)
                    for a in at[passing(held, hashes)].tolist():
                        owner = int(found.owner[a])
                        yield ids[owner], a - int(found.first[owner]), size, *found.window(a, size)

        yield from written(COLUMNS, rows())

    kept = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return kept.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _stands_for(pairs: Column) -> Column:
    """map<item value, document value>: what each value of the item meets most often, by distinct places."""
    def most(value):
        own = F.filter(pairs, lambda p: p["theirs"] == value)
        return F.array_max(F.transform(own, lambda p: F.struct(
            F.size(F.filter(own, lambda x: x["ours"] == p["ours"])).alias("n"), (p["ours"] == value).alias("same"), p["ours"].alias("ours"))))["ours"]

    values = F.array_distinct(F.transform(pairs, lambda p: p["theirs"]))
    return F.map_from_entries(F.transform(values, lambda v: F.struct(v.alias("value"), most(v).alias("ours"))))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, matched_words, item_words of every document and the items that contaminate it."""
    ship_package(docs.sparkSession)
    theirs = materialise(benchmark_windows(items))
    filled = hash_filter(theirs.select("hash"), FILTER_BITS)
    sizes = sorted(r[0] for r in theirs.select("size").distinct().collect())  # SHORTEST to WINDOW
    ours = document_windows(docs, filled, sizes).alias("d")
    met = ours.join(theirs.alias("b"), ["template", "size"]).select(
        F.col("d.id").alias("doc_id"), F.col("b.id").alias("item_id"), "size", "words",
        (F.col("d.at") - F.col("b.at")).alias("diagonal"), F.col("b.at").alias("at"),
        F.zip_with(
            F.arrays_zip(F.col("b.places").alias("place"), F.col("b.slots").alias("theirs")), "d.slots",
            lambda x, ours: F.struct((x["place"] + F.col("b.at")).alias("place"), x["theirs"].alias("theirs"), ours.alias("ours"))).alias("pairs"))
    # At most the item's windows meet on one diagonal.
    runs = met.groupBy("doc_id", "item_id", "diagonal").agg(
        F.max("words").alias("words"), F.collect_set(F.struct("at", "size", "pairs")).alias("windows"))
    fair = runs.withColumn("stands", _stands_for(F.array_distinct(F.flatten(F.transform("windows", lambda w: w["pairs"]))))).withColumn(
        "windows", F.filter("windows", lambda w: F.forall(w["pairs"], lambda p: p["theirs"] == p["ours"])
                            | F.forall(w["pairs"], lambda p: F.element_at("stands", p["theirs"]) == p["ours"])))
    covered = fair.select("doc_id", "item_id", "words", F.explode(F.array_distinct(F.flatten(F.transform(
        "windows", lambda w: F.sequence(w["at"], w["at"] + w["size"] - 1))))).alias("word"))
    found = covered.groupBy("doc_id", "item_id").agg(F.max("words").alias("item_words"), F.countDistinct("word").alias("matched_words"))
    enough = F.least(F.lit(COVERED).cast("double"), F.ceil(F.col("item_words") * SHARE).cast("double"))
    return found.where(F.col("matched_words") >= enough).select("doc_id", "item_id", "matched_words", "item_words")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    name = free_name("bad_id", docs.columns)
    ids = contaminated(docs, items).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(name), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
