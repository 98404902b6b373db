import collections
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from demandloom.llm import packing
from demandloom.llm.packing import Limits, Piece, at_powers, place


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(packing.byte_bpe().path)


def test_round_trip_of_the_given_documents(spark, sf, exact):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.op8_packing(spark, sf).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for i, text in texts.items():
        ids, at = np.array([*exact.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and not at & (at - 1)  # no padding at all


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 4, 20), Limits(64, 1, 64), Limits(7, 3, 1), Limits(1, 1, 1)])
def test_limits_and_wholeness(limits):
    made = np.random.default_rng(1)
    losses = [np.concatenate([[0], np.cumsum(made.random(n) < made.random())]) for n in made.integers(1, 300, 200)]
    held = collections.defaultdict(list)
    for sequence in place(losses, limits):
        assert 0 < sum(p.length for p in sequence) <= limits.tokens and len(sequence) <= limits.segments
        assert sum(losses[p.item][p.start + p.length] - losses[p.item][p.start] for p in sequence) <= limits.loss
        for p in sequence:
            held[p.item].append(p)
    for i, loss in enumerate(losses):
        at = 0
        for p in sorted(held[i]):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(loss) - 1


def test_conversations_whose_answers_bear_the_loss():
    """Prompts bear no loss: the heuristic mixes them with answers, and few sequences stay short."""
    made = np.random.default_rng(2)
    losses = []
    for _ in range(300):
        prompt, answer = int(made.integers(5, 60)), int(made.integers(5, 60))
        losses.append(np.concatenate([np.zeros(prompt + 1, int), np.arange(1, answer + 1)]))
    sequences = place(losses, Limits(256, 16, 160))
    assert sum(sum(p.length for p in s) == 256 for s in sequences) > 0.9 * sum(len(x) - 1 for x in losses) / 256


def test_short_sequences_split_at_powers():
    parts = at_powers([Piece(0, 3, 10), Piece(1, 0, 3)], 64)
    assert parts == [[Piece(0, 3, 8)], [Piece(0, 11, 2), Piece(1, 0, 2)], [Piece(1, 2, 1)]]
    assert at_powers([Piece(0, 0, 8)], 64) == [[Piece(0, 0, 8)]] and at_powers([Piece(0, 0, 63)], 63) == [[Piece(0, 0, 63)]]


def test_both_encoders_agree(exact):
    encode = packing.encoder(packing.byte_bpe())
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} x\n{chr(c)} 1{chr(c)}2  " for c in range(0x250)]
    texts += ["", " ", "漢字 ① x", "a<|endoftext|>b", "<|endoftext|>", "x" * 5000, "\n" * 3000, "don't WE'LL 12 345\t\r\n x"]
    for text in texts:
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids
