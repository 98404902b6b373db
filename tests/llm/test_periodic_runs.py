import hashlib
import random
import zlib

import numpy as np
import pytest
from corpus import CLASHING, edge_rows, frame, taken

from demandloom.llm import periodic_runs
from demandloom.llm.words import Texts, words


def runs_of(w, least):
    """start, length, period of every run, period by period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def expected(doc_id, text):
    """The contract's row, word by word."""
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(runs_of(w, 12), key=lambda x: (x[0], x[2]))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    made = random.Random(seed)
    texts = []
    for _ in range(made.randint(1, 6)):
        n, letters = made.randint(0, 70), made.choice(["a", "ab", "abc", "abcdefgh"])
        w = [made.choice(letters) for _ in range(n)]
        if n and made.random() < 0.5:
            a = made.randrange(n)
            p = 1 + made.randrange((n - a) // 2 + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        texts.append(w)
    for least in (2, 4, 12):
        pieces = words(Texts.of([" ".join(w).encode() for w in texts]))
        sizes = np.bincount(pieces.text, minlength=len(texts))
        text, start, end, period = periodic_runs.runs(pieces.codes, pieces.text, sizes, least)
        start, end = start - (np.cumsum(sizes) - sizes)[text], end - (np.cumsum(sizes) - sizes)[text]
        got = [sorted(zip(start[text == k].tolist(), (end - start)[text == k].tolist(), period[text == k].tolist())) for k in range(len(texts))]
        assert got == [runs_of(w, least) for w in texts]


def test_suffix_array_and_prefixes():
    symbols = np.array([2, 1, 2, 1, 2, 0, 5, 5, 5])
    ends = np.array([6] * 6 + [9] * 3)
    order, ranks = periodic_runs.suffixes(symbols, ends)
    own = [tuple(symbols[i:ends[i]]) for i in range(9)]
    assert order.tolist() == sorted(range(9), key=lambda i: own[i])
    shared = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    lcp = periodic_runs.common_prefix(ranks, order[:-1], order[1:])
    assert lcp.tolist() == [shared(own[a], own[b]) for a, b in zip(order[:-1], order[1:])]


def test_a_long_period_and_many_questions(monkeypatch):
    """Lists of questions that are cut up give the same runs; a text of one word is one run."""
    w = [str(i % 1000) for i in range(6000)] + ["x"] * 500
    pieces = words(Texts.of([" ".join(w).encode()]))
    whole = periodic_runs.runs(pieces.codes, pieces.text, np.array([len(w)]))
    monkeypatch.setattr(periodic_runs, "QUESTIONS", 100)
    parts = periodic_runs.runs(pieces.codes, pieces.text, np.array([len(w)]))
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts] == [[0, 0], [0, 6000], [6000, 6500], [1000, 1]]


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in docs if len((t or "").split()) < 500]
    got = {r.doc_id: tuple(r) for r in periodic_runs.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    assert [got[i] for i, _ in short] == [expected(i, t) for i, t in short]
    assert any(got[i][1] for i, _ in short)


def test_edge_rows(spark, tmp_path):
    rows = [*edge_rows(), (20, "a " * 40), (20, "a " * 40), (21, "a b " * 6 + "\xa0 a b")]
    frame(spark, rows, CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    got = taken(periodic_runs.op13_periodic_runs(spark, str(tmp_path)))
    assert [r for r in got if r[0] != 7] == sorted((expected(i, t) for i, t in rows if i != 7), key=repr)
    frame(spark, [], CLASHING).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert taken(periodic_runs.op13_periodic_runs(spark, f"{tmp_path}/none")) == []


def test_collapse_leaves_one_period(spark):
    rows = [(1, "start " + "one two three " * 9 + "end"), (2, "one two one two")]
    assert taken(periodic_runs.collapse(frame(spark, rows))) == [(1, "start one two three end"), (2, "one two one two")]
