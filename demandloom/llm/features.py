"""Hashed word n-grams of a step of texts, as numpy arrays."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import xxhash

# Words remembered by a task; beyond it the memory starts anew, which changes no result.
REMEMBERED = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)
SHAPES = (
    (re.compile(r"[a-zß-öø-ÿ]+"), "x"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[0-9]+"), "9"),
    (re.compile(r"(.)\1+"), r"\1\1"),
)


def shape(word: str) -> str:
    """Runs of small letters, capitals and digits as x, X, 9; other characters as they are, runs as two."""
    for pattern, to in SHAPES:
        word = pattern.sub(to, word)
    return word


class Grams(NamedTuple):
    """Slots of n-grams: row t holds those that end at word t; ``starts`` is where each text's words begin."""
    slots: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


class Words:
    """Words to hashes of their lower case and of their shape, looked up once for each distinct word."""

    def __init__(self):
        self._forget()

    def _forget(self):
        self.places: dict[bytes, int] = {}
        self.values: list[tuple[int, int]] = []
        self.known = np.zeros((0, 2), np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Two columns of 64-bit hashes, a row for each word."""
        if len(self.places) > REMEMBERED:
            self._forget()
        places, values = self.places, self.values
        for word in set(words).difference(places):
            text = word.decode("utf-8", "replace")
            places[word] = len(values)
            values.append((xxhash.xxh64_intdigest(text.lower()), xxhash.xxh64_intdigest(shape(text), seed=1)))
        if len(self.known) < len(values):
            self.known = np.concatenate([self.known, np.array(values[len(self.known):], np.uint64)])
        return self.known[np.fromiter(map(places.__getitem__, words), np.int64, len(words))]


def word_grams(texts: list[bytes], words: Words, slots: int) -> Grams:
    """Words and pairs of words; shapes, pairs and triples of shapes. A shape knows if its word repeats the one before."""
    split = [x.split() for x in texts]
    lengths = np.array([len(x) for x in split], np.int64)
    starts = np.cumsum(lengths) - lengths
    hashes = words([word for one in split for word in one])
    n = len(hashes)
    place = np.arange(n) - np.repeat(starts, lengths)
    word, form = hashes[:, 0], hashes[:, 1].copy()
    if n > 1:
        form[1:][(word[1:] == word[:-1]) & (place[1:] > 0)] += MIX

    def before(values, k):
        """The value k words earlier in the same text; zero where the text has none."""
        out = np.zeros_like(values)
        if n > k:
            out[k:] = np.where(place[k:] >= k, values[:-k], np.uint64(0))
        return out

    with np.errstate(over="ignore"):
        pair, two = word + MIX * before(word, 1), form + MIX * before(form, 1)
        three = two + MIX * MIX * before(form, 2)
        grams = np.stack([word, pair * MIX + np.uint64(1), form, two * MIX + np.uint64(2), three * MIX + np.uint64(3)], axis=1)
        grams ^= grams >> np.uint64(29)
        grams *= MIX
    return Grams((grams >> np.uint64(40)).astype(np.int64) % slots, starts, lengths)
