"""Words and lines of many texts at once, as numpy arrays.

A step's texts are one buffer; words are maximal stretches without the bytes 0x20 and 0x09-0x0D, so every
word is a slice of the buffer and no Python object is made for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def byte_set(chars: str) -> np.ndarray:
    """A table of the bytes of ASCII characters."""
    found = np.zeros(256, bool)
    found[list(chars.encode())] = True
    return found


def counted(marks: np.ndarray) -> np.ndarray:
    """How many are marked up to each place, in as few bytes as that takes."""
    return np.cumsum(marks, dtype=np.int32 if len(marks) < 1 << 31 else np.int64)


@dataclass
class Texts:
    """The texts' bytes in one buffer, ``size`` bytes each."""
    data: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Texts:
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        return cls(np.frombuffer(b"".join(texts), np.uint8), ends)

    def sums(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        found = np.concatenate([[0], counted(marks)[self.ends - 1]]) if len(marks) else np.zeros(len(self.ends) + 1, np.int64)
        # Texts without a byte end where the one before does; before the first byte nothing is counted.
        found[1:][self.ends == 0] = 0
        return np.diff(found).astype(np.int64)

    def points(self) -> np.ndarray:
        """Which bytes begin a code point."""
        return (self.data & 0xC0) != 0x80


@dataclass
class Pieces:
    """Pieces of the texts in order: ``text`` numbers each piece's text, ``codes`` its value, of ``values``."""
    text: np.ndarray
    codes: np.ndarray
    values: pa.Array


def words(texts: Texts) -> Pieces:
    """The words. Equal words have equal codes, which number the distinct words of all the texts by first place."""
    solid = ~_BLANK[texts.data]
    # A word begins at a solid byte after a blank one or at a text's start.
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = texts.ends[:-1]
    inner = inner[inner < len(solid)]
    first[inner] |= solid[inner]
    starts = np.flatnonzero(first)
    at = counted(solid)[starts] - 1
    return _encoded(texts.data[solid], at, np.searchsorted(texts.ends, starts, "right"))


def lines(texts: Texts) -> Pieces:
    """The lines, as split at ``\\n``; a text without one is a line, an empty text an empty line."""
    breaks = np.flatnonzero(texts.data == 10)
    owner = np.searchsorted(texts.ends, breaks, "right")
    # Bytes before a line, without the breaks themselves.
    starts = np.concatenate([[0], texts.ends[:-1]]) if len(texts.ends) else texts.ends
    every = np.concatenate([starts, breaks + 1])
    text = np.concatenate([np.arange(len(starts)), owner])
    order = np.lexsort([every, text])
    every, text = every[order], text[order]
    return _encoded(texts.data[texts.data != 10], every - np.searchsorted(breaks, every, "left"), text)


def _encoded(data: np.ndarray, at: np.ndarray, text: np.ndarray) -> Pieces:
    offsets = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
    found = pa.Array.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return Pieces(text, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary)


def dense(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the rows' key tuples, from 0 in the tuples' order; equal tuples have equal numbers."""
    found = keys[0]
    for key in keys[1:]:
        found = np.unique(found, return_inverse=True)[1] * (int(key.max(initial=0)) + 1) + key
    return np.unique(found, return_inverse=True)[1]


def joined(values: pa.Array) -> np.ndarray:
    """The bytes of all values, one after the other."""
    if not len(values):
        return np.zeros(0, np.uint8)
    offsets, data = values.buffers()[1:]
    ends = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]
