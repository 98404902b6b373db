"""Language-model scores by masked pseudo-likelihood.

A window network predicts every word from the words on both sides of it; a document's score is the sum of
the conditional log-probabilities. Words, with A-Z in
lower case, are hashed to ``SLOTS`` slots. A slot's probability is that of its
class times that of the slot within the class, both from the network: frequent slots are
a class each, the others share classes of about equal weight. A class is a binary tree of its slots, halved by weight;
each fork has a vector of its own, so the surroundings tell every slot from the others of its class. Forks start at the
counts over the whole corpus and learn in the last round, from the layer that the rounds before have found.

Texts are split and hashed once; their slots are written out, and counting, training and scoring read these. The
network is trained in numpy on every word of every document: in each round each partition continues from the
shared parameters over all its positions, and Spark averages what the partitions found, weighted by
their positions, a fork by the positions that pass it. What is counted and averaged grows with the input; what comes to the driver, the slot
counts and the parameters, has a fixed size.

Null and empty texts have no words: score 0 and no mean. Rows are scored one by one, whatever their doc_id.
Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.common import table, text_steps
from demandloom.session import materialise, ship_package

SLOTS = 1 << 18
# Slots whose counts travel together.
PART = 1 << 14
# Forks whose vectors travel together.
FORKS = 1 << 10
HEAD = 63
CLASSES = 128
# Words on each side, and width of the network.
REACH = 3
WIDTH = 16
ROUNDS = 2
# Positions in a step, and the step's size.
BATCH = 2048
PACE = 0.1
REMEMBERED = 500_000
# Positions scored at a time.
CHUNK = 2048
SAFE = 80.0
# Rows of a group that are added one by one, for all groups together.
FEW = 3
# A fork's vector as one value.
ROW = np.dtype((np.void, 4 * WIDTH))


class Lexicon(NamedTuple):
    """For each slot its class, the logarithm of its share of the class and its way through the class.

    The steps of slot s are ``steps[ends[s]:ends[s + 1]]``, twice the fork's number, and one more to the right. A fork's
    odds of the right come from its vector and its offset.
    """
    classes: np.ndarray
    shares: np.ndarray
    ends: np.ndarray
    steps: np.ndarray
    vectors: np.ndarray
    offset: np.ndarray


class SlotOf(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word) % SLOTS
        return found


def slots_of(texts: list[bytes], known: SlotOf) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words, and each text's number of words."""
    split = [x.lower().split() for x in texts]
    lengths = np.array([len(x) for x in split], np.int64)
    return np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum())), lengths


def lexicon(counts: np.ndarray) -> Lexicon:
    """Classes by falling count; unseen slots count one, so that every word has a probability."""
    weight = counts + 1.0
    order = np.lexsort((np.arange(SLOTS), -weight))
    classes = np.empty(SLOTS, np.int64)
    classes[order[:HEAD]] = np.arange(HEAD)
    tail = order[HEAD:]
    mass = np.cumsum(weight[tail])
    classes[tail] = HEAD + np.minimum((mass - weight[tail]) / mass[-1] * (CLASSES - HEAD), CLASSES - HEAD - 1).astype(np.int64)
    total = np.bincount(classes, weights=weight, minlength=CLASSES)
    ends, steps, offset = tree(classes[order], weight[order], order)
    return Lexicon(
        classes.astype(np.uint8), np.log(weight / total[classes]).astype(np.float32), ends, steps,
        np.zeros((SLOTS, WIDTH), np.float32), offset)


def tree(classes: np.ndarray, weight: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ends and steps of each slot, and the forks' offsets, from slots in ``order``: a class is one stretch of them.

    A fork cuts a stretch where the weight on both sides is most alike; its number is the place of the cut.
    """
    mass = np.concatenate([[0], np.cumsum(weight)])
    begins = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    low, high = begins, np.append(begins[1:], len(classes))
    sizes, offset, levels = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.float32), []
    while True:
        wide = high - low > 1
        low, high = low[wide], high[wide]
        if not len(low):
            break
        cut = np.clip(np.searchsorted(mass, (mass[low] + mass[high]) / 2), low + 1, high - 1)
        offset[cut] = np.log((mass[high] - mass[cut]) / (mass[cut] - mass[low]))
        lengths = high - low
        places = np.repeat(low - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        fork = np.repeat(cut, lengths)
        levels.append((order[places], sizes[places].copy(), 2 * fork + (places >= fork)))
        sizes[places] += 1
        low, high = np.stack([low, cut], axis=1).ravel(), np.stack([cut, high], axis=1).ravel()
    each = np.zeros(SLOTS, np.int64)
    each[order] = sizes
    ends = np.concatenate([[0], np.cumsum(each)])
    steps = np.zeros(int(ends[-1]), np.int32)
    for slot, depth, step in levels:
        steps[ends[slot] + depth] = step
    return ends.astype(np.int32), steps, offset


class Network(NamedTuple):
    """before and after the word, a vector for each place and class (the last: outside the text); a layer; the output."""
    inputs: np.ndarray
    bias: np.ndarray
    outputs: np.ndarray
    offset: np.ndarray


SHAPES = ((2 * REACH, CLASSES + 1, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,))
PLACES = np.arange(2 * REACH) * (CLASSES + 1)


def flat(network: Network) -> np.ndarray:
    return np.concatenate([x.ravel() for x in network])


def shaped(values: np.ndarray) -> Network:
    ends = np.cumsum([int(np.prod(s)) for s in SHAPES])
    return Network(*[part.reshape(s).astype(np.float32) for part, s in zip(np.split(values, ends[:-1]), SHAPES)])


def first_network(words: Lexicon, counts: np.ndarray) -> Network:
    """Small random weights; the output starts at the classes' own frequencies."""
    made = np.random.default_rng(5)
    mass = np.bincount(words.classes, weights=counts + 1.0, minlength=CLASSES)
    return Network(
        (made.standard_normal(SHAPES[0]) * 0.1).astype(np.float32), np.zeros(WIDTH, np.float32),
        (made.standard_normal(SHAPES[2]) * 0.1).astype(np.float32), np.log(mass / mass.sum()).astype(np.float32))


class Surroundings:
    """The classes around each word of a step of texts."""

    def __init__(self, classes: np.ndarray, lengths: np.ndarray):
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        self.places = np.arange(len(classes)) + REACH * (self.owner + 1)
        self.padded = np.full(len(classes) + REACH * (len(lengths) + 1), CLASSES, np.uint8)
        self.padded[self.places] = classes

    def __call__(self, which) -> np.ndarray:
        """A row of classes for each of the words ``which``; in memory place after place."""
        at = self.places[which]
        return np.stack([np.take(self.padded, at + k) for k in range(-REACH, REACH + 1) if k]).astype(np.int64).T


def hidden(network: Network, around: np.ndarray) -> np.ndarray:
    total = np.take(network.inputs[0], around[:, 0], axis=0)
    total += network.bias
    for place in range(1, 2 * REACH):
        total += np.take(network.inputs[place], around[:, place], axis=0)
    return np.tanh(total, out=total)


def bounded(network: Network) -> bool:
    """Whether no logit can leave the safe range: the layer is within -1 and 1. Beyond it a row's largest is taken off."""
    return np.abs(network.outputs).sum(0).max() + np.abs(network.offset).max() <= SAFE


def ways(words: Lexicon, slots: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """The forks that the words of some slots pass, depth by depth.

    The words' order by falling length of their ways; for each depth the number of words that reach it and the start and
    end of its forks; all forks, those of a depth in the words' order; for each whether the word goes right.
    """
    first = np.take(words.ends, slots)
    sizes = np.take(words.ends, slots + 1) - first
    order = np.argsort(-sizes.astype(np.int16), kind="stable")
    counts = len(slots) - np.cumsum(np.bincount(sizes))[:-1]
    bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
    levels = list(zip(counts.tolist(), bounds[:-1], bounds[1:]))
    first = np.take(first, order)
    steps = np.take(words.steps, np.concatenate([first[:0], *[first[:k] + depth for depth, (k, _, _) in enumerate(levels)]]))
    return order, levels, steps >> 1, (steps & 1).astype(np.float32)


def log_members(words: Lexicon, layer: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Log-probability of each word's slot within its class, given the layer."""
    order, levels, fork, right = ways(words, slots)
    mine, layer, total = np.take(words.vectors, fork, axis=0), np.take(layer, order, axis=0), np.zeros(len(slots))
    odds = np.take(words.offset, fork) + _dots(mine, layer, levels)
    odds *= 1 - 2 * right
    lost = np.log(1 + np.exp(-np.abs(odds)))
    lost += np.maximum(odds, 0)
    for k, start, end in levels:
        total[:k] -= lost[start:end]
    found = np.empty(len(slots))
    found[order] = total
    return found


def log_classes(network: Network, around: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log-probability of each word's class, given the classes around it."""
    return _log_classes(network, hidden(network, around), classes)


def _log_classes(network: Network, layer: np.ndarray, classes: np.ndarray) -> np.ndarray:
    logits = layer @ network.outputs
    logits += network.offset
    own = logits[np.arange(len(classes)), classes]
    if not bounded(network):
        most = logits.max(axis=1)
        return own - most - np.log(np.exp(logits - most[:, None]).sum(axis=1))
    return own - np.log(np.exp(logits, out=logits).sum(axis=1))


def _group_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of the groups of rows that begin at ``first``; most groups are one row or a few."""
    found, sizes = np.take(rows, first, axis=0), np.diff(first, append=len(rows))
    left = np.flatnonzero(sizes > 1)
    for k in range(1, FEW):
        few = left[sizes[left] <= FEW]
        at = few[sizes[few] > k]
        found[at] += np.take(rows, first[at] + k, axis=0)
    many = left[sizes[left] > FEW]
    if len(many):
        sizes = sizes[many]
        begins = np.cumsum(sizes) - sizes
        at = np.repeat(first[many] - begins, sizes) + np.arange(int(sizes.sum()))
        found[many] = np.add.reduceat(np.take(rows, at, axis=0), begins, axis=0)
    return found


def _dots(one: np.ndarray, other: np.ndarray, levels: list[tuple[int, int, int]]) -> np.ndarray:
    """Each row of ``one`` times the row of the word that passes there."""
    product = np.empty_like(one)
    for k, start, end in levels:
        np.multiply(one[start:end], other[:k], out=product[start:end])
    return product @ np.ones(WIDTH, product.dtype)


class Forks:
    """The vectors and offsets of all forks while they learn; one sum of squared gradients and a count of words each."""

    def __init__(self, words: Lexicon):
        self.words = words._replace(vectors=words.vectors.copy(), offset=words.offset.copy())
        self.sums, self.passed = np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.int64)

    def learn(self, layer: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """One step, in place; returns the layer's slopes."""
        vectors, offset = self.words.vectors, self.words.offset
        order, levels, fork, right = ways(self.words, slots)
        if not len(fork):
            return np.zeros_like(layer)
        mine, theirs = np.take(vectors, fork, axis=0), np.take(layer, order, axis=0)
        odds = np.take(offset, fork) + _dots(mine, theirs, levels)
        # Beyond the safe range the slope is nothing or all.
        wrong = (1 / (1 + np.exp(-np.clip(odds, -SAFE, SAFE))) - right) / np.float32(len(slots))
        mine *= wrong[:, None]
        sorted_ = np.zeros_like(theirs)
        for k, start, end in levels:
            sorted_[:k] += mine[start:end]
        back = np.empty_like(sorted_)
        back[order] = sorted_
        # Each fork once: sorted with their places.
        placed = np.sort((fork.astype(np.int64) << 32) | np.arange(len(fork)))
        found, place = placed >> 32, placed & 0xFFFFFFFF
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        kinds = found[first]
        # A level's forks are in the words' order.
        word = (np.arange(len(fork)) - np.repeat([start for _, start, _ in levels], [k for k, _, _ in levels]))[place]
        wrong = np.take(wrong, place)
        pulls = np.take(theirs, word, axis=0)
        pulls *= wrong[:, None]
        slope, shift = _group_sums(pulls, first), np.add.reduceat(wrong, first)
        self.passed[kinds] += np.diff(first, append=len(fork))
        total = np.take(self.sums, kinds) + (np.einsum("ij,ij->i", slope, slope) + shift * shift) / (WIDTH + 1)
        self.sums[kinds] = total
        pace = PACE / np.sqrt(total + 1e-8)
        slope *= pace[:, None]
        # A row is written as one value.
        after = np.take(vectors, kinds, axis=0)
        after -= slope
        vectors.view(ROW)[kinds] = after.view(ROW)
        offset[kinds] -= shift * pace
        return back


def learn(network: Network, sums: list[np.ndarray], around: np.ndarray, classes: np.ndarray, forks: Forks | None = None, slots: np.ndarray | None = None) -> None:
    """One step, in place; ``sums`` holds the squared gradients so far, which scale the step. The forks of ``slots`` learn too if given."""
    n, layer = len(classes), hidden(network, around)
    odds = layer @ network.outputs
    odds += network.offset
    if not bounded(network):
        odds -= odds.max(axis=1, keepdims=True)
    np.exp(odds, out=odds)
    # The slopes of the logits are these odds, less their sum at the word's own class, times each word's share.
    total = odds @ np.ones(CLASSES, np.float32)
    share = 1 / (n * total)
    odds[np.arange(n), classes] -= total
    back = (odds @ network.outputs.T) * share[:, None]
    outputs, offset = (layer * share[:, None]).T @ odds, share @ odds
    if forks is not None:
        back += forks.learn(layer, slots)
    back *= 1 - layer * layer
    # One sum over (place, class) for all the words around: sorted, each with its word.
    at = (around.T + PLACES[:, None]).reshape(-1).astype(np.int16)
    order = np.argsort(at, kind="stable")
    at = np.take(at, order)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    inputs = np.zeros((len(PLACES) * (CLASSES + 1), WIDTH))
    inputs[at[first]] = np.add.reduceat(np.take(back, order % n, axis=0), first, axis=0)
    inputs = inputs.reshape(SHAPES[0])
    for values, total, slope in zip(network, sums, (inputs, back.sum(0), outputs, offset)):
        total += slope * slope
        values -= (PACE * slope / np.sqrt(total + 1e-8)).astype(np.float32)


def slotted(docs: DataFrame) -> DataFrame:
    """doc_id, slots (32-bit numbers, as bytes) of each row; written out, as several passes read them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = SlotOf()
        for rows, texts in text_steps(batches):
            slots, lengths = slots_of(texts, known)
            ends = np.concatenate([[0], np.cumsum(4 * lengths)])
            packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(slots.astype(np.int32))])
            yield pa.RecordBatch.from_arrays([rows.column(0), packed.cast(pa.binary())], names=["doc_id", "slots"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialise(texts.mapInArrow(run, "doc_id long, slots binary"))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with all their slots and each row's number of words, some megabytes at a time."""
    for rows, held in text_steps(batches, 1):
        yield rows, np.frombuffer(b"".join(held), np.int32).astype(np.int64), np.array([len(x) // 4 for x in held], np.int64)


def slot_counts(rows: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for _, slots, _ in _steps(batches):
            counts += np.bincount(slots, minlength=SLOTS)
        parts = counts.reshape(-1, PART)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[number] = held.get(number, 0) + np.frombuffer(counts, np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "counts"])

    schema = "part long, counts binary"
    found = rows.mapInArrow(run, schema).repartition(SLOTS // PART, "part").mapInArrow(summed, schema)
    counts = np.zeros(SLOTS, np.int64)
    for row in found.collect():  # SLOTS numbers
        counts[row["part"] * PART:(row["part"] + 1) * PART] = np.frombuffer(row["counts"], np.int64)
    return counts


def train_round(rows: DataFrame, words: Lexicon, network: Network, number: int) -> Network:
    """The partitions' networks after one pass, averaged by their positions."""
    return _round(rows, words, network, number, False)[1]


def _round(rows: DataFrame, words: Lexicon, network: Network, number: int, all_: bool) -> tuple[Lexicon, Network]:
    """One pass; with ``all_`` the forks learn too, each averaged by the positions that passed it."""
    needed = words if all_ else Lexicon(words.classes, *[None] * (len(words) - 1))
    sent = rows.sparkSession.sparkContext.broadcast((needed, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon_, start = sent.value
        own, sums = Network(*[x.copy() for x in start]), [np.zeros(s) for s in SHAPES]
        forks = Forks(lexicon_) if all_ else None
        seen = 0
        chance = np.random.default_rng([number, TaskContext.get().partitionId()])
        for _, slots, lengths in _steps(batches):
            classes = lexicon_.classes[slots].astype(np.int64)
            around = Surroundings(classes, lengths)
            chosen = chance.permutation(len(classes))
            for at in np.split(chosen, range(BATCH, len(chosen), BATCH)):
                if len(at):
                    learn(own, sums, around(at), classes[at], forks, slots[at] if all_ else None)
            seen += len(chosen)
        if seen:
            yield _moved(-1, np.array([0]), np.array([seen]), flat(own)[None], np.float64)
        if seen and all_:
            for part in range(SLOTS // FORKS):
                at = part * FORKS + np.flatnonzero(forks.passed[part * FORKS:(part + 1) * FORKS])
                if len(at):
                    # What the vectors have moved by, in half precision: a step is a few hundredths of it.
                    moved = np.column_stack([forks.words.vectors[at] - lexicon_.vectors[at], forks.words.offset[at] - lexicon_.offset[at]])
                    yield _moved(part, at - part * FORKS, forks.passed[at], moved, np.float16)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, at, weight, moved in zip(*(x.to_pylist() for x in batch.columns)):
                at, weight = np.frombuffer(at, np.int32), np.frombuffer(weight, np.float64)
                moved = np.frombuffer(moved, np.float64 if part < 0 else np.float16).reshape(len(at), -1)
                count, total = held.setdefault(part, (np.zeros(1 if part < 0 else FORKS), np.zeros((1 if part < 0 else FORKS, moved.shape[1]))))
                count[at] += weight
                total[at] += weight[:, None] * moved
        for part, (count, total) in held.items():
            at = np.flatnonzero(count)
            yield _moved(part, at, count[at], total[at] / count[at, None], np.float32)

    schema = "part long, places binary, weights binary, moved binary"
    found = rows.mapInArrow(run, schema).repartition("part").mapInArrow(summed, schema)
    vectors, offset = words.vectors.copy(), words.offset.copy()
    for row in found.collect():  # the parameters, a fixed number
        at, moved = np.frombuffer(row["places"], np.int32), np.frombuffer(row["moved"], np.float32)
        if row["part"] < 0:
            network = shaped(moved)
            continue
        at, moved = row["part"] * FORKS + at, moved.reshape(len(at), -1)
        vectors[at] += moved[:, :WIDTH]
        offset[at] += moved[:, WIDTH]
    sent.destroy()
    return words._replace(vectors=vectors, offset=offset), network


def _moved(part: int, at: np.ndarray, weight: np.ndarray, values: np.ndarray, kind: type) -> pa.RecordBatch:
    columns = (at.astype(np.int32), weight.astype(np.float64), values.astype(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in columns]], names=["part", "places", "weights", "moved"])


def score_slots(slots: np.ndarray, lengths: np.ndarray, words: Lexicon, network: Network) -> np.ndarray:
    """The sum of the log-probabilities of each text's words."""
    classes = words.classes[slots].astype(np.int64)
    around = Surroundings(classes, lengths)
    found = np.empty(len(slots))
    for at in range(0, len(slots), CHUNK):
        part = np.arange(at, min(at + CHUNK, len(slots)))
        layer = hidden(network, around(part))
        found[part] = _log_classes(network, layer, classes[part]) + log_members(words, layer, slots[part])
    return np.bincount(around.owner, weights=found, minlength=len(lengths)).astype(np.float64)


def score_texts(texts: list[bytes], known: SlotOf, words: Lexicon, network: Network) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of words and the sum of their log-probabilities."""
    slots, lengths = slots_of(texts, known)
    return lengths, score_slots(slots, lengths, words, network)


def train(rows: DataFrame) -> tuple[Lexicon, Network]:
    """A model of the rows of ``slotted``."""
    counts = slot_counts(rows)
    words = lexicon(counts)
    network = first_network(words, counts)
    for number in range(ROUNDS):
        words, network = _round(rows, words, network, number, number == ROUNDS - 1)
    return words, network


def score(rows: DataFrame, words: Lexicon, network: Network) -> DataFrame:
    """doc_id, words, log_prob (their sum, natural logarithms) and mean_log_prob for each row of ``slotted``."""
    sent = rows.sparkSession.sparkContext.broadcast((words, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, slots, lengths in _steps(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(lengths), pa.array(score_slots(slots, lengths, *sent.value))], names=["doc_id", "words", "log_prob"])

    found = rows.mapInArrow(run, "doc_id long, words long, log_prob double")
    return found.withColumn("mean_log_prob", F.when(F.col("words") > 0, F.col("log_prob") / F.col("words")))


def scored(docs: DataFrame) -> DataFrame:
    """Every row's score under the model of all of them."""
    ship_package(docs.sparkSession)
    rows = slotted(docs)
    return score(rows, *train(rows))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
