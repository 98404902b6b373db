import duckdb
from corpus import CLASHING, edge_rows, frame, prose, taken, words

from demandloom.llm import quality_rules

DOCS = "doc_id long, text string, source string"
BLANKS = {" ", "\t", "\n", "\r", "\x0b", "\x0c"}


def sourced(spark, rows, extra=()):
    schema = DOCS + "".join(f", {x} string" for x in extra)
    return spark.createDataFrame([(*r, *[None] * len(extra)) for r in rows], schema)


def normal(line):
    made = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "0" if c in "123456789" else c for c in line)
    return " ".join(x.decode() for x in made.encode().split())


def expected(rows, limit):
    """The verdicts, line by line."""
    holders = {}
    for _, t, host in rows:
        for line in (t or "").split("\n"):
            holders.setdefault((host or "", normal(line)), set()).add(t or "")
    out = []
    for i, t, host in rows:
        t = t or ""
        w = t.encode().split()
        split = [x for x in t.split("\n") if normal(x)]
        windows = {}
        for k in range(len(w) - 2):
            windows.setdefault(tuple(w[k:k + 3]), []).append(k)
        repeated = {k + j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(3)}
        gone = [x for x in split if len(holders[host or "", normal(x)]) > limit]
        gone_words = sum(len(x.encode().split()) for x in gone)
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        out.append((i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(split) - len(set(split)),
                    len(repeated), len(gone), gone_words, failed, not failed and 2 * (len(w) - gone_words) >= len(w)))
    return sorted(out, key=repr)


def hosts():
    """A line in thirty texts of one host and in three of another; copies; edges."""
    rows = [(100 + i, f"Shared  notice {i % 9 + 1} OF the\tsite\n" * 2 + prose(50 + i, 60), "a") for i in range(30)]
    rows += [(200 + i, "shared notice 1 of the site\n" + prose(90 + i, 60), "b") for i in range(3)]
    rows += [(300 + i, prose(400, 80), "a") for i in range(30)]
    depleted = "\n".join(" ".join(words(500, 40)) for _ in range(3))
    rows += [(400 + i, f"{depleted}\n{' '.join(words(600 + i, 20))}", "c") for i in range(12)]
    return rows + [(i, t, None) for i, t in edge_rows()] + [(500, "w " * 60, ""), (501, "# * $ |<>&%", "c")]


def test_equal_a_plain_count(spark):
    rows = hosts()
    want = expected(rows, 10)
    assert taken(quality_rules.report(sourced(spark, rows))) == want
    assert taken(quality_rules.report(sourced(spark, rows, CLASHING))) == want
    verdict = {r[0]: r for r in want}
    # The notice goes in one host only; copies alone make no boilerplate; depleted documents are rejected.
    assert verdict[100][6:] == (2, 12, False, True) and verdict[200][6] == 0 and verdict[300][6:] == (0, 0, False, True)
    assert not verdict[400][8] or not verdict[400][9]


def test_matches_the_oracle_on_edge_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", hosts())
    assert sorted(con.execute(quality_rules.ORACLE).fetchall(), key=repr) == expected(hosts(), 10)


def test_empty_table_and_no_host(spark):
    assert taken(quality_rules.report(sourced(spark, []))) == []
    assert taken(quality_rules.clean(frame(spark, []))) == []
    rows = edge_rows()
    assert taken(quality_rules.report(frame(spark, rows))) == expected([(i, t, None) for i, t in rows], 10)


def test_clean_cuts_boilerplate_out(spark):
    rows = hosts()
    left = quality_rules.clean(sourced(spark, rows, ("key", "boilerplate")))
    assert left.columns == ["doc_id", "text", "source", "key", "boilerplate"]
    kept = {r[0] for r in expected(rows, 10) if r[9]}
    texts = {r.doc_id: r.text for r in left.collect()}
    assert set(texts) == kept
    assert texts[100] == rows[0][1].split("\n", 2)[2] and texts[200].startswith("shared notice") and texts[300] == prose(400, 80)


def test_a_depleted_document_goes(spark):
    shared = "\n".join(" ".join(words(700 + k, 12)) for k in range(5))
    rows = [(i, f"{shared}\n{' '.join(words(800 + i, 40))}", "a") for i in range(11)] + [(50, shared + "\n" + " ".join(words(900, 61)), "a")]
    found = {r.doc_id: (r.gone_words, r.base_failed, r.kept) for r in quality_rules.report(sourced(spark, rows)).collect()}
    assert found[0] == (60, False, False) and found[50] == (60, False, True)
    fewer = {r.doc_id: r.kept for r in quality_rules.report(sourced(spark, rows[:10])).collect()}
    assert all(fewer.values())
