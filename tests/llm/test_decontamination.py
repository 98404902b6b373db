import pytest
from corpus import frame

from demandloom.llm import decontamination as D

ASKED = "If Tom has 3 apples and Mary gives Tom 5 apples then how many apples does Tom have in total now"
OTHER = "If Anna has 31 apples and Jim gives Anna 7 apples then how many apples does Anna have in total now"
MIXED = "If Anna has 31 apples and Jim gives Bob 7 apples then how many apples does Carl have in total now"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def pairs(spark, docs, rows):
    return {(r.doc_id, r.item_id) for r in D.contaminated(frame(spark, docs), items(spark, rows)).collect()}


def test_other_numbers_and_names_are_caught_if_consistent(spark):
    docs = [(1, ASKED), (2, f"x y {OTHER}."), (3, MIXED), (4, " ".join(ASKED.split()[:6])), (5, "so many other words that mean nothing at all here")]
    assert pairs(spark, docs, [(9, ASKED), (10, ASKED)]) == {(1, 9), (2, 9)}


def test_two_values_for_one_drop_their_windows_only(spark):
    """Tom is three people in MIXED; a question that makes two numbers or names equal is caught."""
    same = ASKED.replace("Mary", "Tom")
    equal = ASKED.replace("3 apples", "7 apples").replace("5 apples", "7 apples")
    assert pairs(spark, [(1, same), (2, equal), (3, MIXED)], [(9, ASKED)]) == {(1, 9), (2, 9)}


LONG = "the old mill by the river that Anna and her brother bought was sold again to Anna after " \
       "nine quiet winters when the water stood so high that no wheel could turn and all the grain was lost"


def test_verbatim_words_beside_a_conflict(spark):
    """One of two equal names changed, and 13 words word for word on one side of a conflicting slot."""
    changed = LONG.replace("to Anna", "to Berta")
    assert pairs(spark, [(1, changed), (2, LONG)], [(9, LONG)]) == {(1, 9), (2, 9)}
    rest = "a boat that had been lying in a shed since the war"
    item = "one day we saw Anna and then Anna she went in " + rest
    other = "one day we saw Eva and then Rita she went in " + rest
    # Twelve words alone are too few; with the three before them, beside the conflict, they are enough.
    assert pairs(spark, [(1, other), (2, other.replace("went in", "ran out"))], [(9, item)]) == {(1, 9)}


def test_common_words_are_units_after_numbers_only(spark):
    found = D.Texts(["5 in a box in 3 a second one 2nd second".encode()], D.Canon())
    assert found.kind.tolist() == [D.NUMBER, D.UNIT, D.LITERAL, D.LITERAL, D.LITERAL, D.NUMBER, D.UNIT, D.LITERAL, D.LITERAL, D.NUMBER, D.UNIT]


def test_short_items_need_their_words_in_a_row(spark):
    docs = [(1, "aa bb cc dd ee ff"), (2, "aa bb cc x dd ee ff"), (3, "AA, bb cc dd! ee; ff")]
    assert pairs(spark, docs, [(1, "bb cc dd ee"), (2, "bb cc dd")]) == {(1, 1), (3, 1)}


def test_words_become_canonical():
    found = {w: D.canonical(w)[:2] for w in ("1,000", "$5", "5km", "km", "Tom", "TOM", "(word),", "50%", "a1", "3rd", "###")}
    assert found == {
        "1,000": ("1,000", D.NUMBER), "$5": ("$5", D.NUMBER), "5km": ("5km", D.NUMBER), "km": ("km", D.UNIT), "Tom": ("tom", D.NAME),
        "TOM": ("tom", D.LITERAL), "(word),": ("word", D.LITERAL), "50%": ("50%", D.NUMBER), "a1": ("a1", D.LITERAL), "3rd": ("3rd", D.NUMBER),
        "###": ("", D.LITERAL)}


def canonical_words(text):
    out, opens = [], True
    for word in text.split():
        bare, kind, ends = D.canonical(word)
        if not bare:
            continue
        kind = D.LITERAL if opens and kind == D.NAME else kind
        if kind == D.UNIT and bare in D.AFTER_NUMBERS and not (out and out[-1][1] == D.NUMBER):
            kind = D.LITERAL
        out.append((bare if kind == D.LITERAL else D.MARKS[kind], kind, bare))
        opens = ends
    return out


def plain(docs, rows):
    """The rule, item by item and place by place."""
    found = set()
    for d, text in docs.items():
        ours = canonical_words(text or "")
        for i, asked in rows.items():
            theirs = canonical_words(asked or "")
            size = min(D.WINDOW, len(theirs))
            if size < D.SHORTEST:
                continue
            diagonals = {}
            for b in range(len(theirs) - size + 1):
                want = [w[0] for w in theirs[b:b + size]]
                if 2 * sum(w[1] == D.LITERAL for w in theirs[b:b + size]) < size:
                    continue
                for a in range(len(ours) - size + 1):
                    if ours[a][0] == want[0] and [w[0] for w in ours[a:a + size]] == want:
                        diagonals.setdefault(a - b, []).append(b)
            covered = set()
            for shift, starts in diagonals.items():
                slot = lambda p: ((theirs[p][1], theirs[p][2]), (ours[p + shift][1], ours[p + shift][2]))
                places = {p for b in starts for p in range(b, b + size) if theirs[p][1]}
                met = {}
                for p in places:
                    met.setdefault(slot(p)[0], []).append(slot(p)[1])
                stands = {x: max(ys, key=lambda y: (ys.count(y), y == x, y)) for x, ys in met.items()}
                for b in starts:
                    own = [slot(p) for p in range(b, b + size) if theirs[p][1]]
                    if all(x == y for x, y in own) or all(stands[x] == y for x, y in own):
                        covered |= set(range(b, b + size))
            if covered and len(covered) >= min(D.COVERED, -(-len(theirs) * D.SHARE // 1)):
                found.add((d, i))
    return found


def test_given_tables_by_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in D.op10_decontamination(spark, sf).collect()}
    assert found and found == plain(docs, rows)


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_a_full_filter_changes_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(D, "FILTER_BITS", bits)
    assert pairs(spark, [(1, ASKED), (2, "if " + OTHER), (3, MIXED)], [(9, ASKED)]) == {(1, 9), (2, 9)}
