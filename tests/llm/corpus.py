"""Small corpora and plain recomputations for the tests of the corpus operators."""

import random

DOCS = "doc_id long, text string"
# Names that operators use inside.
CLASHING = ("key", "fp", "k", "n", "body", "at", "id", "score", "words", "list", "gone", "parts", "gone_id", "kept_id", "bad_id",
            "component_id", "slots", "c", "span", "ids", "chunk", "label", "y")


def words(seed, count, low=4, high=9):
    made = random.Random(seed)
    return ["".join(made.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(made.randint(low, high))) for _ in range(count)]


def prose(seed, count, per_line=12):
    found = words(seed, count)
    return "\n".join(" ".join(found[i:i + per_line]) for i in range(0, count, per_line))


def edge_rows():
    """Nulls, empty and long texts, repeated rows, equal texts under several ids."""
    return [
        (1, prose(1, 120)), (1, prose(1, 120)), (2, prose(1, 120)), (3, None), (4, ""), (5, " \n\t "), (None, prose(2, 80)),
        (None, None), (6, "one"), (7, prose(3, 60_000)), (8, "\n" * 50), (9, "é ß 漢字 😀 ñ"), (10, "a" * 50_000), (11, prose(1, 120) + "\nx"),
    ]


def frame(spark, rows, extra=()):
    """Documents, with columns of clashing names holding nulls."""
    schema = DOCS + "".join(f", {name} string" for name in extra)
    return spark.createDataFrame([(*r, *[None] * len(extra)) for r in rows], schema)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def taken(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
