"""Periodic runs of words, found in an enhanced suffix array.

A run is a stretch of words with smallest period q, at least 2*q and ``LEAST`` words long, that can't be made longer.
Its last square, the 2*q words at its end, branches: the suffixes at its start i and at i+q share exactly q words. So
for each LCP interval, every suffix i of its smaller children asks the inverse suffix array whether i+depth or i-depth
lies in another child of the interval; each hit is the last square of a run, of period q or of a multiple. The square
is rotated to the left as far as it goes, and hits of one stretch merge into the run of their smallest period.

Many texts are worked on at once, a few megabytes a step, with a separate alphabet for each, so no interval crosses
texts. The suffix array comes from prefix doubling that sorts only what is still tied; the ranks of every round are
kept, so that longest common prefixes and the rotations are found by halving steps instead of word by word. Intervals
are pairs of array positions, found by halving over minima of the LCP array; an interval with many children is a
sequence of two-way cuts, and the smaller side of a cut is walked: n*log(n) questions in all, whatever the text. One
text is worked on as a whole, so the memory of a task grows with its longest text.

Null text counts as empty, without runs. Null doc_id is passed on. Rows are worked on one by one: repeated rows give
repeated results, an empty table an empty one, and other columns are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.common import table, text_steps
from demandloom.llm.words import Texts, dense, words

# Words of the shortest run.
LEAST = 12
# Questions to the inverse suffix array that are in memory at once, beyond those of one cut.
QUESTIONS = 1 << 19


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where a document's periodic tail begins and its period, by the document's number; None: it stays as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def suffixes(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and the ranks after comparing 1, 2, 4, ... symbols, the last of which are all distinct.

    ``symbols`` of different texts differ and are ordered by text; ``ends`` is each place's text's end.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = _ranks(symbols[order])
    ranks = [np.empty(n, np.int32 if n < 1 << 31 else np.int64)]
    ranks[0][order] = rank
    width = 1
    tied = _tied(rank)
    while len(tied):
        # Only the suffixes at these places of the array are still tied with a neighbour.
        at = order[tied]
        after = at + width
        held = ranks[-1]
        next_ = np.where(after < ends[at], held[np.minimum(after, n - 1)] + 1, 0)
        groups = rank[tied]
        sort = np.lexsort([next_, groups])
        at, next_, groups = at[sort], next_[sort], groups[sort]
        order[tied] = at
        new = np.ones(len(at), bool)
        new[1:] = (groups[1:] != groups[:-1]) | (next_[1:] != next_[:-1])
        rank[tied] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        now = held.copy()
        now[at] = rank[tied]
        ranks.append(now)
        width *= 2
        again = _tied(rank[tied])
        tied = tied[again]
    return order, ranks


def _ranks(ordered: np.ndarray) -> np.ndarray:
    """The first place of each group of equal values."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _tied(rank: np.ndarray) -> np.ndarray:
    same = np.zeros(len(rank) + 1, bool)
    same[1:-1] = rank[1:] == rank[:-1]
    return np.flatnonzero(same[1:] | same[:-1])


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` share; no two are the same suffix."""
    a, b = a.copy(), b.copy()
    n, length = len(ranks[0]), np.zeros(len(a), np.int64)
    for level in reversed(range(len(ranks) - 1)):
        held = ranks[level]
        # A suffix that has ended differs from all others.
        inside = (a < n) & (b < n)
        step = np.where(inside & (held[np.minimum(a, n - 1)] == held[np.minimum(b, n - 1)]), 1 << level, 0)
        a, b, length = a + step, b + step, length + step
    return length


def common_suffix(ranks: list[np.ndarray], starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols before ``a`` equal those before ``b``, of one text; a < b, ``starts`` is their text's start."""
    a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for level in reversed(range(len(ranks) - 1)):
        held, width = ranks[level], 1 << level
        to = np.maximum(a - width, 0)
        step = np.where((a - width >= starts) & (held[to] == held[np.maximum(b - width, 0)]), width, 0)
        a, b, length = a - step, b - step, length + step
    return length


def reaches(lcp: np.ndarray, at: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The interval around each cut ``at`` of the array: from its first place to its last, ``longest`` places at most.

    Cut k lies between places k-1 and k. To the left the interval goes on while the LCP isn't less than the cut's, to
    the right while it is greater, so that of equal cuts the later one is made first.
    """
    n = len(lcp)
    minima = [lcp]
    while 2 << (len(minima) - 1) <= min(n, longest):
        below, half = minima[-1], 1 << (len(minima) - 1)
        now = below.copy()
        now[half:] = np.minimum(below[half:], below[:-half])
        minima.append(now)
    depth, first, last = lcp[at], at.copy(), at.copy()
    # minima[j][k] is the least of the 2**j cuts that end at k; cuts 0 and n have no common prefix.
    for level in reversed(range(len(minima))):
        width, least = 1 << level, minima[level]
        to = first - 1
        first = np.where((to - width + 1 >= 0) & (least[np.maximum(to, 0)] >= depth), first - width, first)
        to = last + width
        last = np.where((to < n) & (least[np.minimum(to, n - 1)] > depth), to, last)
    return first - 1, last


def branching_squares(order: np.ndarray, lcp: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square whose two halves' suffixes share exactly the period; no text has more than ``longest`` symbols."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    cuts = np.flatnonzero(lcp)
    if not len(cuts):
        return cuts, cuts
    low, high = reaches(lcp, cuts, longest)
    left = cuts - low <= high - cuts + 1
    # The smaller side of the cut, and where the other side lies.
    first, count = np.where(left, low, cuts), np.where(left, cuts - low, high - cuts + 1)
    other = np.where(left, cuts, low), np.where(left, high, cuts - 1)
    found = []
    # Long lists are cut up, so that memory stays a few times the text's.
    upto = np.cumsum(count)
    begin = 0
    while begin < len(cuts):
        stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + QUESTIONS, "right")))
        part = slice(begin, stop)
        sizes = count[part]
        row = np.repeat(np.arange(begin, stop), sizes)
        suffix = order[np.repeat(first[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(row))]
        period = lcp[cuts[row]].astype(np.int64)
        for to, start in ((suffix + period, suffix), (suffix - period, suffix - period)):
            inside = (to >= 0) & (to < len(order))
            there = place[np.where(inside, to, 0)]
            hit = np.flatnonzero(inside & (there >= other[0][row]) & (there <= other[1][row]))
            found.append((start[hit], period[hit]))
        begin = stop
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def runs(symbols: np.ndarray, text: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Text, start, end and period of every run, in that order; start and end are places in ``symbols``.

    ``text`` numbers each symbol's text from 0, ``sizes`` are the texts' numbers of symbols.
    """
    if not len(symbols):
        return (np.zeros(0, np.int64),) * 4
    after = np.cumsum(sizes)
    ends, starts = after[text], (after - sizes)[text]
    order, ranks = suffixes(dense(text, symbols), ends)
    lcp = np.zeros(len(order), ranks[0].dtype)
    # Places of the array that never tied share nothing with the place before.
    near = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    lcp[near] = common_prefix(ranks, order[near - 1], order[near])
    at, period = branching_squares(order, lcp, int(sizes.max()))
    start = at - common_suffix(ranks, starts[at], at, at + period)
    end = at + 2 * period
    long = end - start >= least
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort([period, end, start])
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort([period, start])
    return text[start[by]], start[by], end[by], period[by]


def dropped(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs", pa.string()), ("collapsed", pa.binary())])


def find(docs: DataFrame, tail=None, least: int = LEAST) -> DataFrame:
    """doc_id; the number of runs; the longest; all as lines of start, length, period; the text without repetitions.

    ``tail(doc_id, n)`` may name a start and a period from which a text of n words is made periodic before the search.
    """
    def step(texts: list[bytes], ids: list) -> list[tuple]:
        pieces = words(Texts.of(texts))
        sizes = np.bincount(pieces.text, minlength=len(texts))
        after = np.cumsum(sizes)
        source = np.arange(len(pieces.text))
        for k, doc_id in enumerate(ids):
            n = int(sizes[k])
            made = tail(doc_id, n) if tail else None
            if made:
                begin, (a, p) = after[k] - n, made
                source[begin + a:after[k]] = begin + a + np.arange(n - a) % p
        symbols = pieces.codes[source]
        text, start, end, period = runs(symbols, pieces.text, sizes, least)
        gone = dropped(len(symbols), start, end, period)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        out = []
        for k, (doc_id, body) in enumerate(zip(ids, texts)):
            begin, stop = int(after[k] - sizes[k]), int(after[k])
            own = body.split()
            if cuts[k] == cuts[k + 1]:
                kept = own if not tail or not tail(doc_id, len(own)) else [own[i] for i in (source[begin:stop] - begin).tolist()]
                out.append((doc_id, 0, None, None, None, None, "", b" ".join(kept)))
                continue
            part = slice(cuts[k], cuts[k + 1])
            s, length, q = start[part] - begin, end[part] - start[part], period[part]
            best = np.lexsort([q, s, -length])[0]
            listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), length.tolist(), q.tolist()))
            kept = [own[i] for i in (source[begin:stop] - begin)[~gone[begin:stop]].tolist()]
            out.append((doc_id, len(s), int(s[best]), int(length[best]), int(q[best]), int(1000 * length[best] // q[best]), listed, b" ".join(kept)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_steps(batches):
            rows = step(texts, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RESULT)], schema=RESULT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed binary")


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and text, in which only the first period of every run is left."""
    return find(docs, None, least).select("doc_id", F.col("collapsed").cast("string").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), repeated_tail).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.encode("runs", "utf-8"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
