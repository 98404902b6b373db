"""Packing of token sequences as vector bin packing.

A piece of a document has three sizes: its tokens, one segment, and its loss-bearing tokens. A sequence
has a limit on each. Documents are taken in blocks as they come from the scan, so no text is shuffled.
What exceeds a limit alone is cut off first. The rest is placed by the dot-product heuristic: into the
open sequence goes the piece, of those that fit, whose sizes point most into what is left of the limits.
When none fits, the longest piece left is cut to fill the sequence, as cuts are free. A sequence that
stays short of its limit is split at powers of two, which need no padding.

Null and empty texts are one closing token. Rows are packed one by one, whatever their doc_id (null or
repeated). Columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.common import table, text_steps
from demandloom.session import ship_package

CLOSING = 0
# A block ends with the document that reaches one of these.
BLOCK_TOKENS = 1 << 20
BLOCK_DOCUMENTS = 2048


class Limits(NamedTuple):
    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


class Piece(NamedTuple):
    item: int
    start: int
    length: int


class Vocabulary(NamedTuple):
    """A tokenizers file, and the same vocabulary as tiktoken ranks with its splitting pattern, if there is one."""
    path: str
    ranks: str | None = None
    pattern: str | None = None


def byte_bpe() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


# The two libraries' tables of letters, numbers and spaces agree up to here (a test goes through them all).
LATIN = re.compile("[^\x00-ɏ]")
# A longer run without a space takes the library whose merging is not quadratic.
RUN = re.compile(r"\S{2000}|\s{2000}")


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: Vocabulary) -> Callable[[str], np.ndarray]:
    """Text to ids of the tokenizers file. Plain Latin texts go the faster way through equal ranks."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary.path)
    if vocabulary.ranks is None:
        return lambda text: np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    import base64

    import tiktoken

    with open(vocabulary.ranks, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
    special = re.compile("|".join(re.escape(t.content) for t in exact.get_added_tokens_decoder().values()) or "(?!)")

    def encode(text: str) -> np.ndarray:
        if not text.isascii() and LATIN.search(text) or special.search(text) or RUN.search(text):
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    return encode


def _longest(loss: np.ndarray, start: int, tokens: int, bearing: int) -> int:
    """How many tokens from ``start`` keep within both limits. ``loss``: loss-bearing tokens before each place."""
    end = min(start + tokens, len(loss) - 1)
    if loss[end] - loss[start] > bearing:
        end = int(np.searchsorted(loss, loss[start] + bearing, side="right")) - 1
    return end - start


def place(losses: list[np.ndarray], limits: Limits = Limits()) -> list[list[Piece]]:
    """Sequences of pieces. losses[i]: for item i, the loss-bearing tokens before each of its places, and in all."""
    if min(limits) < 1:
        raise ValueError("limits are at least 1")
    sequences, at = [], np.zeros(len(losses), np.int64)
    total = np.array([len(x) - 1 for x in losses], np.int64)
    for i, loss in enumerate(losses):
        while total[i] - at[i] >= limits.tokens or loss[-1] - loss[at[i]] > limits.loss:
            length = _longest(loss, int(at[i]), limits.tokens, limits.loss)
            sequences.append([Piece(i, int(at[i]), length)])
            at[i] += length
    sizes = np.ones((len(losses), 3)) / np.array(limits)
    sizes[:, 0] = (total - at) / limits.tokens
    sizes[:, 2] = [(loss[-1] - loss[a]) / limits.loss for loss, a in zip(losses, at)]
    live = np.flatnonzero(total > at)
    sizes = sizes[live]
    slack = 1e-9
    while len(live):
        bin_, room = [], np.ones(3)
        used = np.zeros(len(live), bool)
        while True:
            score = np.where(used | (sizes > room + slack).any(1), -1.0, sizes @ room)
            best = int(score.argmax())
            if score[best] < 0:
                break
            item = int(live[best])
            bin_.append(Piece(item, int(at[item]), int(total[item] - at[item])))
            room -= sizes[best]
            used[best] = True
        tokens, bearing = round(room[0] * limits.tokens), round(room[2] * limits.loss)
        if not used.all() and tokens and len(bin_) < limits.segments:
            best = int(np.where(used, -1.0, sizes[:, 0]).argmax())
            item = int(live[best])
            length = min(_longest(losses[item], int(at[item]), tokens, bearing), int(total[item] - at[item]) - 1)
            if length:
                bin_.append(Piece(item, int(at[item]), length))
                at[item] += length
                sizes[best, 0] = (total[item] - at[item]) / limits.tokens
                sizes[best, 2] = (losses[item][-1] - losses[item][at[item]]) / limits.loss
        live, sizes = live[~used], sizes[~used]
        sequences.append(bin_)
    return [part for sequence in sequences for part in at_powers(sequence, limits.tokens)]


def at_powers(sequence: list[Piece], full: int) -> list[list[Piece]]:
    """The sequence itself if full, or its parts whose lengths are powers of two, longest first."""
    left = sum(p.length for p in sequence)
    if left == full or not left & (left - 1):
        return [sequence]
    parts, rest = [], list(reversed(sequence))
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        part = []
        while size:
            piece = rest.pop()
            taken = min(size, piece.length)
            part.append(piece._replace(length=taken))
            size -= taken
            if taken < piece.length:
                rest.append(Piece(piece.item, piece.start + taken, piece.length - taken))
        parts.append(part)
    return parts


COLUMNS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
]
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _block(docs: list, ids: list[np.ndarray], limits: Limits, first: int) -> tuple[pa.RecordBatch, int]:
    """The block's pieces as rows, and how many sequences it made. The closing token bears no loss."""
    rows: list[tuple] = []
    sequences = place([np.minimum(np.arange(len(x) + 1), len(x) - 1) for x in ids], limits)
    for n, sequence in enumerate(sequences, first):
        offset = 0
        for item, start, length in sequence:
            found = ids[item][start:start + length].tobytes()
            rows.append((docs[item], start, length, found, len(ids[item]), n, offset))
            offset += length
    arrays = [pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), COLUMNS)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in COLUMNS]), len(sequences)


def pack(docs: DataFrame, vocabulary: Vocabulary, limits: Limits = Limits()) -> DataFrame:
    """A row for each piece: its document's place, its ids (32 bits, little-endian), its place in a sequence."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        next_id = TaskContext.get().partitionId() << 40
        held, ids, size = [], [], 0
        for rows, texts in text_steps(batches):
            for doc, text in zip(rows.column(0).to_pylist(), texts):
                found = np.append(encode(text.decode("utf-8", "replace")), CLOSING).astype("<u4")
                held.append(doc)
                ids.append(found)
                size += len(found)
                if size >= BLOCK_TOKENS or len(held) >= BLOCK_DOCUMENTS:
                    batch, made = _block(held, ids, limits, next_id)
                    yield batch
                    held, ids, size, next_id = [], [], 0, next_id + made
        if held:
            yield _block(held, ids, limits, next_id)[0]

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_bpe()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
