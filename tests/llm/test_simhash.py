import random

import xxhash
from corpus import frame

from demandloom.llm import simhash
from demandloom.llm.components import components


def plain(text, width):
    made = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w.decode() for w in made.encode().split()]
    parts = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, radius):
    """node to the smallest it reaches, by comparing all pairs."""
    values, up = sorted(values), {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius and root(a) != root(b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def test_fingerprints_and_classes_by_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r.doc_id: r for r in simhash.op3_simhash(spark, sf).collect()}
    prints = {i: plain(t, 3) for i, t in docs.items()}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: r.fingerprint for i, r in found.items()}
    roots = classes(set(prints.values()), 2)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert {i: least[roots[p]] for i, p in prints.items()} == {i: r.component_id for i, r in found.items()}


def test_short_texts():
    for text in ("", "  ", "One", "one two", "one two three", "one two three four", "É A\x1cB\x0bc"):
        assert simhash.fingerprint(text.encode(), 3) == plain(text, 3)


def test_trees_find_what_lies_within():
    made = random.Random(3)
    values = {made.getrandbits(16) for _ in range(800)}
    tree = simhash.BKTree(values)
    for asked in list(values)[:50]:
        assert set(tree.within(asked, 2)) == {v for v in values if (v ^ asked).bit_count() <= 2}


def test_a_large_group_over_many_shards(spark, monkeypatch):
    """Near copies of a few fingerprints; shards of 40, so that groups are cut and meet pair by pair."""
    monkeypatch.setattr(simhash, "SHARD", 40)
    made = random.Random(4)
    values = set()
    for _ in range(4):
        base = made.getrandbits(64)
        values |= {base ^ (1 << made.randrange(64)) ^ (1 << made.randrange(64)) ^ (1 << made.randrange(64)) for _ in range(150)}
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    found = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2)).collect()
    want = classes(signed, 2)
    assert {v: dict(found).get(v, v) for v in signed} == want and len(set(want.values())) > 1


def test_components_of_a_path_and_of_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(41, 42), (42, 41), (41, 42), (50, 50), (None, 3)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, 41: 41, 42: 41}


def test_copies_and_empty_texts(spark):
    rows = [(9, "a b c d"), (4, "A b  c\td"), (7, None), (8, ""), (5, "else where is")]
    found = {r.doc_id: r.component_id for r in simhash.classes(frame(spark, rows), 3, 2).collect()}
    assert found == {9: 4, 4: 4, 7: 7, 8: 7, 5: 5}
