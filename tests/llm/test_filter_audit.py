import itertools
from collections import Counter

import duckdb
import numpy as np
from corpus import CLASHING, edge_rows, labels, prose, taken

from demandloom.llm import filter_audit

DOCS = "doc_id long, text string, source string"
MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, 0, 1), (7, 1, None), (None, 1, 1), (11, 5, 7), (9, None, None), (404, 0, 0)]


def sourced(spark, rows, extra=()):
    schema = DOCS + "".join(f", {x} string" for x in extra)
    return spark.createDataFrame([(*r, *[None] * len(extra)) for r in rows], schema)


def edges():
    hosts = itertools.cycle(["a", "b", None, ""])
    return [(i, t, next(hosts)) for i, t in edge_rows()] + [
        (30, "WORD " * 300, "a"), (31, "WORD " * 300, "b"), (29, "WORD " * 300, "b"), (32, "x $ y", "A"), (30, "WORD " * 300, "a")]


def expected(rows, marks):
    """The audit, one document and one order at a time."""
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, x in marks if x == 1 and i is not None}
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    failed = []
    for i, t, source in rows:
        t = t or ""
        w = t.encode().split()
        failed.append((i, source or "", {x for x, fails in {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and smallest[t] < i}.items() if fails}))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in failed}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(5):
                x, before = order[step], set(order[:step])
                own = [(i, f) for i, p, f in failed if p == part]
                removed = [i for i, f in own if x in f and not f & before]
                shapley[part, x] += len(removed)
                out[part, order, step + 1] = [
                    sum(not f & (before | {x}) for _, f in own), len(removed), sum(x in f and bool(f & before) for _, f in own),
                    sum(f == {x} for _, f in own), sum(i in good for i in removed), sum(i in toxic for i in removed)]
    return sorted(((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()), key=repr)


def test_edge_rows_equal_a_plain_count(spark):
    rows = edges()
    want = expected(rows, MARKS)
    assert taken(filter_audit.audit(sourced(spark, rows), labels(spark, MARKS))) == want
    assert taken(filter_audit.audit(sourced(spark, rows, CLASHING), labels(spark, MARKS))) == want
    assert len(want) == 600 * len({r[2] or "" for r in rows})


def test_empty_tables(spark):
    assert taken(filter_audit.audit(sourced(spark, []), labels(spark, MARKS))) == []
    rows = [(1, "one two", "a"), (2, None, "a")]
    assert taken(filter_audit.audit(sourced(spark, rows), labels(spark, []))) == expected(rows, [])


def test_matches_the_oracle_on_edge_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", edges())
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", MARKS)
    assert sorted(con.execute(filter_audit.ORACLE).fetchall(), key=repr) == expected(edges(), MARKS)


def test_one_matrix_over_all_shards(spark):
    """Shards share one dictionary: the matrix, put together, holds every document's counts of words."""
    rows = [(i, prose(i % 7, 30 + i) + " shared é", "a") for i in range(40)] + [(100, "", "a"), (101, None, "b")]
    docs = sourced(spark, rows).repartition(5).selectExpr("doc_id", "source AS part", "text")
    words = {r.id: bytes(r.word).decode() for r in filter_audit.dictionary(filter_audit.local_shards(docs)).collect()}
    assert sorted(words.values()) == sorted({w for _, t, _ in rows for w in (t or "").split()})
    found = {}
    shards = filter_audit.document_terms(docs).collect()
    for s in shards:
        pointers, columns, counts = (filter_audit._unpacked(bytes(x), k) for x, k in ((s.pointers, np.int64), (s.columns, np.int64), (s.counts, np.int32)))
        for k, d in enumerate(s.documents):
            part = slice(pointers[k], pointers[k + 1])
            found[d.doc_id] = {words[c]: n for c, n in zip(columns[part].tolist(), counts[part].tolist())}
    assert len(shards) > 1 and found == {i: dict(Counter((t or "").split())) for i, t, _ in rows}
