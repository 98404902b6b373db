import duckdb
import pytest
from corpus import frame, prose, taken

from demandloom.llm import line_dedup


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    return connection


def test_matches_the_oracle(spark, sf, con):
    assert taken(line_dedup.op1_line_dedup(spark, sf)) == sorted(con.execute(line_dedup.ORACLE).fetchall(), key=repr)


def cut(text, count):
    """The chunks, by the rule as stated; ``count`` has every line's occurrences."""
    import hashlib
    from itertools import groupby

    out = []
    for _, stretch in groupby(text.split("\n"), key=lambda x: count[x] > 1):
        lines = list(stretch)
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        marks = [(h + line_dedup.FACTOR * (hashes[i - 1] if i else 0)) % line_dedup.MODULUS == 0 for i, h in enumerate(hashes)]
        starts = [0, *[i + 1 for i in range(1, len(lines) - 2) if marks[i] and not marks[i - 1]]]
        out += [lines[a:b] for a, b in zip(starts, [*starts[1:], len(lines)])]
    return out


def test_chunks_follow_the_rule_and_resist_shifts(spark):
    from collections import Counter

    text = prose(5, 600, 3)
    lines = text.split("\n")
    rows = [(1, text), (2, "new first line\n" + text), (3, "a\nb"), (4, "a"), (5, "own\n" + "\n".join(lines[50:53]) + "\nown too")]
    count = Counter(x for _, t in rows for x in t.split("\n"))
    found = {r.doc_id: [(c.start, c.n) for c in r.c] for r in line_dedup.hashed_lines(frame(spark, rows)).select(
        "doc_id", line_dedup.chunks(line_dedup.F.col("lines")).alias("c")).collect()}
    for i, t in rows:
        sizes = [len(c) for c in cut(t, count)]
        assert found[i] == [(sum(sizes[:k]), n) for k, n in enumerate(sizes)]
    assert found[2][0] == (0, 1) and [(s - 1, n) for s, n in found[2][1:]] == found[1]


def test_a_run_between_own_lines_goes_wherever_it_stands(spark):
    """Two lines that many documents share, between lines that none shares."""
    rows = [(i, f"own {i}\nlicense one\nlicense two\nmore {i}\nlast {i}") for i in range(30)]
    left = dict(line_dedup.remove(frame(spark, rows)).collect())
    assert left[0] == rows[0][1] and all(left[i] == f"own {i}\nmore {i}\nlast {i}" for i in range(1, 30))


def test_first_place_stays(spark):
    shared = "\n".join(f"shared line {i}" for i in range(40))
    rows = [(i, f"own line {i}\nmore of {i}\n{shared}\nlast of {i}") for i in range(6)]
    left = dict(line_dedup.remove(frame(spark, rows)).collect())
    assert left[0] == rows[0][1]
    for i, text in rows[1:]:
        assert len(left[i]) < len(text) / 2 and f"own line {i}" in left[i] and f"last of {i}" in left[i]


def test_no_python_in_the_plan(spark, sf):
    plan = line_dedup.op1_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def kept_lines(rows):
    """What is left, by all runs of two lines."""
    first, left = {}, {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for k in range(len(lines) - 1):
            if not "".join(lines[k:k + 2]).strip():
                continue
            held = first.setdefault(tuple(lines[k:k + 2]), (i, k))
            if held != (i, k):
                gone |= {k + 1} if held == (i, k - 1) else {k, k + 1}
        left[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return left


def test_short_runs_go_wherever_they_begin(spark):
    rows = [(i, f"own {i}\nlicense one\nlicense two\nmore {i}\nlast {i}") for i in range(30)] + [(40, "x\nx\nx\nx"), (41, "\n\n\n"), (42, "license one")]
    left = dict(line_dedup.remove_runs(frame(spark, rows)).collect())
    assert left == kept_lines(rows) and left[0] == rows[0][1] and left[40] == "x\nx"
    assert all(left[i] == f"own {i}\nmore {i}\nlast {i}" for i in range(1, 30))


def test_runs_of_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").collect()]
    assert dict(line_dedup.remove_runs(frame(spark, rows)).collect()) == kept_lines(rows)


def test_rows_of_one_document_are_told_apart(spark):
    """Two rows share a doc_id; only one of them repeats what another document holds."""
    shared = "\n".join(f"shared line {i}" for i in range(60))
    own = "own first\nown second\nown third"
    rows = [(1, shared), (2, f"a\nb\n{shared}\nc\nd"), (2, own)]
    for cut_out in (line_dedup.remove, line_dedup.remove_runs):
        left = [r.text for r in cut_out(frame(spark, rows)).collect()]
        assert shared in left and own in left and rows[1][1] not in left
