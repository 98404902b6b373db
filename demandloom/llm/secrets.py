"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings. SQL functions only.

A candidate is a run of 20 or more token characters. Windows of ``WINDOW`` characters slide over it; the
sum of c*log2(c) over the window's character counts changes by one count that enters and one that leaves,
so a step costs two counts and no new histogram. A window whose entropy reaches its class's threshold is
suspicious; the span runs from the first such window to the last. Candidates on the allow list, and those
that touch a span of the fixed patterns, add nothing.

Matches of one kind lie in order and apart, so a candidate finds the one that it may touch by halving: the work of a text
grows with its matches, hardly more.

Null text counts as empty. Rows are scanned one by one: repeated rows give repeated results, an empty
table an empty result, and other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.common import let, table

# Fixed patterns, in the order in which spans with one start are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Bits a character, of at most log2(20) = 4.32, from which a window of the class is suspicious. Letters with symbols
# count as letters; digits with symbols alone have no class, as their 15 characters stay below 4.1 bits.
THRESHOLDS = {"hex": 3.0, "mixed": 3.6, "letters": 4.1}
# Strings that look random and are none: documented examples, alphabets, digests of published files.
ALLOWED = (
    "(?i)example|sample|dummy|placeholder|changeme|abcdefghij|0123456789|1234567890|xxxxxxxx|"
    "^sha(1|256|384|512)[-=]|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)
# Entropy sums are whole numbers of this unit, so that adding and taking away leaves no rounding.
UNIT = 1 << 20
STEPS = [0] + [round(n * math.log2(n) * UNIT) for n in range(1, WINDOW + 1)]


def most_allowed(bits: float) -> int:
    """The largest sum of c*log2(c) of a window whose entropy is at least ``bits`` a character."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * UNIT)


# Matches of a text whose positions are summed together.
TOGETHER = 256


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, body>> of the pattern's leftmost matches; start in code points from 0.

    Lengths are summed in stretches of ``TOGETHER`` matches, and these by what came before, so that no list of all
    matches is copied once for each match.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:bigint,body:string>>"
    nothing = F.array().cast(kind)
    zero = F.lit(0).cast("long")

    def walk(piece):
        """The stretch's matches, from its own start in the text."""
        def step(state, p):
            at = state["at"] + F.length(p["gap"])
            return F.struct(
                (at + F.length(p["body"])).alias("at"),
                F.concat(state["out"], F.array(F.struct(at.alias("start"), p["body"].alias("body")))).alias("out"))

        return F.aggregate(piece["own"], F.struct(piece["at"].alias("at"), nothing.alias("out")), step, lambda state: state["out"])

    def stretches(pieces):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / TOGETHER).cast("int")), lambda k: F.slice(pieces, k * TOGETHER + 1, TOGETHER))

    def placed(own):
        sizes = F.transform(own, lambda x: F.aggregate(x, zero, lambda n, p: n + F.length(p["gap"]) + F.length(p["body"])))
        upto = F.aggregate(sizes, F.array(zero), lambda held, n: F.concat(held, F.array(F.element_at(held, -1) + n)))
        return F.flatten(F.transform(F.zip_with(own, upto, lambda x, at: F.struct(x.alias("own"), at.alias("at"))), lambda x: F.when(x["own"].isNotNull(), walk(x)).otherwise(nothing)))

    pieces = F.filter(F.zip_with(found, between, lambda body, gap: F.struct(gap.alias("gap"), body.alias("body"))), lambda p: p["body"].isNotNull())
    return F.when(F.regexp_like(text, F.lit(pattern)), let(pieces, lambda x: let(stretches(x), placed))).otherwise(nothing)


def touches(held: Column, start: Column, end: Column) -> Column:
    """Whether one of the matches of one kind, in order and apart, has a character of start..end.

    The first that ends after ``start`` is found by halving.
    """
    def halve(state, _):
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        after = F.get(held, middle)["start"] + F.length(F.get(held, middle)["body"]) > start
        open_ = state["low"] < state["high"]
        return F.struct(
            F.when(open_ & ~after, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(open_ & after, middle).otherwise(state["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(held))))
    first = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(held).alias("high")), halve, lambda state: state["low"])
    return F.when(F.size(held) > 0, F.coalesce(F.get(held, first)["start"] < end, F.lit(False))).otherwise(F.lit(False))


def spans(found: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"),
        (m["start"] + F.length(m["body"])).alias("end")))


def suspicious(body: Column) -> Column:
    """struct<first, last>: character positions from 1 of the suspicious windows' outer ends; nulls if none."""
    table_ = F.array(*[F.lit(x).cast("long") for x in STEPS])
    most = (
        F.when(F.regexp_like(body, F.lit("^[0-9a-fA-F]+$")), most_allowed(THRESHOLDS["hex"]))
        .when(F.regexp_like(body, F.lit("[0-9]")) & F.regexp_like(body, F.lit("[A-Za-z]")), most_allowed(THRESHOLDS["mixed"]))
        .when(F.regexp_like(body, F.lit("[A-Za-z]")), most_allowed(THRESHOLDS["letters"]))
        .otherwise(-1).cast("long"))

    def count(window, x):
        return F.size(window) - F.size(F.array_remove(window, x))

    def walk(given):
        chars, most_, steps = given["chars"], given["most"], given["steps"]

        def step(state, i):
            full = i > WINDOW
            held = F.slice(chars, F.greatest(i - WINDOW, F.lit(1)), F.least(i - 1, F.lit(WINDOW)))
            gone = count(held, chars[F.greatest(i - WINDOW - 1, F.lit(0))])
            left = state["sum"] - F.when(full, steps[gone] - steps[gone - 1]).otherwise(F.lit(0).cast("long"))
            kept = F.when(full, F.slice(held, 2, WINDOW)).otherwise(held)
            here = count(kept, chars[i - 1])
            total = left + steps[here + 1] - steps[here]
            hit = (i >= WINDOW) & (total <= most_)
            return F.struct(
                total.alias("sum"),
                F.when(state["first"].isNull() & hit, i - WINDOW + 1).otherwise(state["first"]).alias("first"),
                F.when(hit, i).otherwise(state["last"]).alias("last"))

        zero = F.struct(
            F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), zero, step)

    chars = F.regexp_extract_all(body, F.lit("."), F.lit(0))
    return let(F.struct(chars.alias("chars"), most.alias("most"), table_.alias("steps")), walk)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, the digest of their spans, and all spans as one string."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text",
        F.filter(matches(F.col("text"), ASSIGN), lambda m: F.length(F.regexp_extract(m["body"], ASSIGN, 2)) >= 6).alias("assign"),
        matches(F.col("text"), ACCESS).alias("access"),
        matches(F.col("text"), HEX).alias("hex"),
        F.filter(matches(F.col("text"), CANDIDATE), lambda m: ~F.regexp_like(m["body"], F.lit(ALLOWED))).alias("candidates"),
    ).select(
        "doc_id", "assign", "access", "hex", "candidates",
        F.array_sort(F.concat(spans(F.col("assign"), "assign"), spans(F.col("access"), "access"), spans(F.col("hex"), "hex"))).alias("base"))
    found = F.transform(
        F.filter("candidates", lambda m: ~reduce(or_, [touches(F.col(kind), m["start"], m["start"] + F.length(m["body"])) for kind in KINDS[:3]])),
        lambda m: let(suspicious(m["body"]), lambda s: F.struct(
            (m["start"] + s["first"] - 1).alias("start"), F.lit(KINDS.index("entropy")).alias("order"),
            F.lit("entropy").alias("kind"), (m["start"] + s["last"]).alias("end"))))
    written = lambda array: F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return base.select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", F.filter(found, lambda s: s["start"].isNotNull())))).alias("spans"))


def _matches_sql(name: str, pattern: str) -> str:
    """A view of the matches of a pattern: doc, kind, start, body."""
    return f"""{name} AS (
  SELECT r, (sum(length(gap) + length(coalesce(body, ''))) OVER (PARTITION BY r ORDER BY i) - length(body))::BIGINT AS start, body
  FROM (SELECT r, unnest(string_split_regex(t, $re${pattern}$re$)) AS gap,
               unnest(list_append(regexp_extract_all(t, $re${pattern}$re$), NULL)) AS body,
               unnest(range(len(regexp_extract_all(t, $re${pattern}$re$)) + 1)) AS i FROM texts)
  QUALIFY body IS NOT NULL)"""


_CLASS = f"""CASE WHEN regexp_matches(body, '^[0-9a-fA-F]+$') THEN {most_allowed(THRESHOLDS['hex'])}
  WHEN regexp_matches(body, '[0-9]') AND regexp_matches(body, '[A-Za-z]') THEN {most_allowed(THRESHOLDS['mixed'])}
  WHEN regexp_matches(body, '[A-Za-z]') THEN {most_allowed(THRESHOLDS['letters'])} ELSE -1 END"""
ORACLE = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_matches_sql("assigned", ASSIGN)},
{_matches_sql("access", ACCESS)},
{_matches_sql("hexes", HEX)},
{_matches_sql("loose", CANDIDATE)},
base AS (
  SELECT r, start, 0 AS k, 'assign' AS kind, body FROM assigned WHERE length(regexp_extract(body, $re${ASSIGN}$re$, 2)) >= 6
  UNION ALL SELECT r, start, 1, 'access', body FROM access UNION ALL SELECT r, start, 2, 'hex', body FROM hexes),
free AS (
  SELECT *, {_CLASS} AS most FROM loose l WHERE NOT regexp_matches(body, $re${ALLOWED}$re$)
  AND NOT EXISTS (FROM base b WHERE b.r = l.r AND b.start < l.start + length(l.body) AND b.start + length(b.body) > l.start)),
windows AS (
  SELECT r, start, most, i, unnest(string_split(substr(body, i, {WINDOW}), '')) AS c
  FROM (SELECT *, unnest(range(1, length(body) - {WINDOW} + 2)) AS i FROM free)),
counts AS (SELECT r, start, most, i, c, count(*) AS n FROM windows GROUP BY ALL),
sums AS (SELECT r, start, most, i, sum({STEPS}[n + 1]) AS total FROM counts GROUP BY ALL),
found AS (
  SELECT r, start + min(i) - 1 AS start, 3 AS k, 'entropy' AS kind, start + max(i) + {WINDOW} - 1 AS finish
  FROM sums WHERE total <= most GROUP BY r, start),
every AS (SELECT r, start, k, kind, start + length(body) AS finish FROM base UNION ALL SELECT * FROM found),
listed AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, k) FILTER (k < 3) AS base,
         string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, k) AS spans
  FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (r)
"""


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
