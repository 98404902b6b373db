import random

import numpy as np
from corpus import frame

from demandloom.llm import lm_scoring as L


def sentences(seed, count):
    """Words in a fixed circle, so that neighbours tell the word between them."""
    made, circle = random.Random(seed), [f"w{i}" for i in range(30)]
    out = []
    for _ in range(count):
        at = made.randrange(30)
        out.append(circle[at:] + circle[:at])
    return out


def test_learns_from_both_sides(spark):
    found = sentences(1, 400)
    words, network = L.train(L.slotted(frame(spark, [(i, " ".join(x)) for i, x in enumerate(found)]).repartition(4)))
    fresh = sentences(2, 50)
    mixed = [random.Random(i).sample(x, len(x)) for i, x in enumerate(fresh)]
    score = lambda rows: L.score_texts([" ".join(x).encode() for x in rows], L.SlotOf(), words, network)[1].sum()
    assert score(fresh) > 0.8 * score(mixed) and score(fresh) > score(mixed) + 500


def test_given_documents_beat_shuffled_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    slotted = L.slotted(docs)
    words, network = L.train(slotted)
    found = {r.doc_id: r for r in L.score(slotted, words, network).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.text}
    mixed = {i: random.Random(i).sample(t.split(), len(t.split())) for i, t in rows.items()}
    again = L.score_texts([" ".join(x).encode() for x in mixed.values()], L.SlotOf(), words, network)[1].sum()
    assert sum(r.log_prob for r in found.values()) > again
    for i, text in list(rows.items())[:20]:
        n, total = L.score_texts([text.encode()], L.SlotOf(), words, network)
        assert found[i].words == n[0] == len(text.encode().split()) and np.isclose(found[i].log_prob, total[0], rtol=1e-5)


def tiny():
    counts = np.random.default_rng(1).integers(0, 50, L.SLOTS)
    words = L.lexicon(counts)
    return words, L.first_network(words, counts)


def test_probabilities_sum_to_one():
    words, network = tiny()
    shares = np.bincount(words.classes, weights=np.exp(words.shares.astype(float)), minlength=L.CLASSES)
    assert np.allclose(shares, 1, atol=1e-3)
    around = np.random.default_rng(2).integers(0, L.CLASSES + 1, (1, 2 * L.REACH))
    every = L.log_classes(network, np.repeat(around, L.CLASSES, axis=0), np.arange(L.CLASSES))
    assert np.isclose(np.exp(every.astype(float)).sum(), 1, atol=1e-4)
    large = network._replace(outputs=network.outputs * 500)
    every = L.log_classes(large, np.repeat(around, L.CLASSES, axis=0), np.arange(L.CLASSES))
    assert np.isclose(np.exp(every.astype(float)).sum(), 1, atol=1e-3)


def test_steps_follow_the_slope():
    """The first step of each parameter goes against its numerical slope."""
    _, network = tiny()
    made = np.random.default_rng(3)
    around, classes = made.integers(0, L.CLASSES + 1, (64, 2 * L.REACH)), made.integers(0, L.CLASSES, 64)
    loss = lambda n: -L.log_classes(n, around, classes).astype(float).mean()
    after = L.Network(*[x.copy() for x in network])
    L.learn(after, [np.zeros(s) for s in L.SHAPES], around, classes)
    for name, at in (("bias", (3,)), ("outputs", (2, int(classes[0]))), ("offset", (int(classes[0]),)), ("inputs", (1, int(around[0, 1]), 4))):
        up = L.Network(*[x.astype(np.float64) for x in network])
        getattr(up, name)[at] += 1e-4
        slope = (loss(up) - loss(L.Network(*[x.astype(np.float64) for x in network]))) / 1e-4
        moved = getattr(after, name)[at] - getattr(network, name)[at]
        assert slope * moved < 0


def test_a_step_equals_the_plain_sums():
    """Gradients of one step, word by word and place by place, in double precision."""
    _, network = tiny()
    made = np.random.default_rng(9)
    around, classes = made.integers(0, L.CLASSES + 1, (50, 2 * L.REACH)), made.integers(0, L.CLASSES, 50)
    after, sums = L.Network(*[x.copy() for x in network]), [np.zeros(s) for s in L.SHAPES]
    L.learn(after, sums, around, classes)
    slopes = [np.zeros(s) for s in L.SHAPES]
    for row, own in zip(around, classes):
        layer = np.tanh(network.bias.astype(float) + sum(network.inputs[p][c].astype(float) for p, c in enumerate(row)))
        logits = layer @ network.outputs.astype(float) + network.offset
        wrong = np.exp(logits - logits.max())
        wrong /= wrong.sum()
        wrong[own] -= 1
        back = (network.outputs.astype(float) @ wrong) * (1 - layer**2)
        for p, c in enumerate(row):
            slopes[0][p, c] += back / 50
        slopes[1] += back / 50
        slopes[2] += np.outer(layer, wrong) / 50
        slopes[3] += wrong / 50
    for total, slope in zip(sums, slopes):
        assert np.allclose(np.sqrt(total), np.abs(slope), atol=1e-6)
    large = network._replace(outputs=network.outputs * 500)
    L.learn(large, [np.zeros(s) for s in L.SHAPES], around, classes)
    assert all(np.isfinite(x).all() for x in large)


def test_surroundings_stay_in_their_text():
    around = L.Surroundings(np.array([1, 2, 3, 4, 5]), np.array([2, 0, 3]))
    p = L.CLASSES
    assert around(np.arange(5)).tolist() == [
        [p, p, p, 2, p, p], [p, p, 1, p, p, p], [p, p, p, 4, 5, p], [p, p, 3, 5, p, p], [p, 3, 4, p, p, p]]


def test_a_round_learns_from_every_word(spark):
    """A text of one step: the round's network is that of one step over all positions."""
    text = " ".join(f"w{k * k % 50}" for k in range(400))
    docs = L.slotted(frame(spark, [(1, text)]).coalesce(1))
    counts = L.slot_counts(docs)
    words = L.lexicon(counts)
    first = L.first_network(words, counts)
    slots, lengths = L.slots_of([text.encode()], L.SlotOf())
    classes = words.classes[slots].astype(np.int64)
    want = L.Network(*[x.copy() for x in first])
    L.learn(want, [np.zeros(s) for s in L.SHAPES], L.Surroundings(classes, lengths)(np.arange(len(classes))), classes)
    found = L.train_round(docs, words, first, 0)
    assert all(np.allclose(x, y, atol=1e-3) for x, y in zip(found, want))


def rare_pairs():
    """Pairs of equally rare words, each between neighbours of its own, among many others."""
    made, rows = random.Random(7), []
    for k in range(200):
        rows += [f"left{k % 2} rare{k} right{k % 2} left{k % 2} rare{k} right{k % 2}"] * 20
    rows += [" ".join(f"fill{made.randrange(2000)}" for _ in range(20)) for _ in range(200)]
    made.shuffle(rows)
    return rows


def test_the_context_tells_the_words_of_a_class_apart(spark):
    words, network = L.train(L.slotted(frame(spark, list(enumerate(rare_pairs()))).coalesce(2)))
    known = L.SlotOf()
    slot = {k: known[f"rare{k}".encode()] for k in range(200)}
    together = [(a, b) for a in range(0, 200, 2) for b in range(1, 200, 20) if words.classes[slot[a]] == words.classes[slot[b]]]
    assert len(together) > 50
    score = lambda text: L.score_texts([text.encode()], L.SlotOf(), words, network)[1][0]
    better = [score(f"left0 rare{a} right0") - score(f"left0 rare{b} right0") for a, b in together]
    better += [score(f"left1 rare{b} right1") - score(f"left1 rare{a} right1") for a, b in together]
    # By the counts alone they differ by nothing.
    assert np.mean(better) > 0.5, better


def test_all_slots_sum_to_one_in_every_surrounding():
    words, _ = tiny()
    made = np.random.default_rng(11)
    every = np.arange(L.SLOTS)
    assert np.allclose(L.log_members(words, np.zeros((L.SLOTS, L.WIDTH), np.float32), every), words.shares, atol=1e-4)
    words = words._replace(vectors=made.standard_normal(words.vectors.shape).astype(np.float32))
    layer = np.tile(np.tanh(made.standard_normal(L.WIDTH)).astype(np.float32), (L.SLOTS, 1))
    shares = np.bincount(words.classes, weights=np.exp(L.log_members(words, layer, every)), minlength=L.CLASSES)
    assert np.allclose(shares, 1, atol=1e-3)


def test_forks_step_by_their_slopes():
    """The layer's slopes and a step of forks are those of the log-probability, numerically."""
    words, _ = tiny()
    made = np.random.default_rng(12)
    words = words._replace(vectors=made.standard_normal(words.vectors.shape).astype(np.float32))
    layer, slots = np.tanh(made.standard_normal((30, L.WIDTH))), made.integers(0, L.SLOTS, 30)
    slots[20:] = slots[:10]
    loss = lambda w, x: -L.log_members(w._replace(vectors=w.vectors.astype(float), offset=w.offset.astype(float)), x, slots).sum() / 30
    forks = L.Forks(words)
    back = forks.learn(layer.astype(np.float32), slots)
    for row, unit in ((0, 3), (5, 0), (29, 15)):
        moved = layer.copy()
        moved[row, unit] += 1e-4
        assert np.isclose((loss(words, moved) - loss(words, layer)) / 1e-4, back[row, unit], atol=1e-4)
    _, _, passed, _ = L.ways(words, slots)
    assert np.array_equal(np.bincount(passed, minlength=L.SLOTS), forks.passed)
    assert np.array_equal(forks.words.vectors[forks.passed == 0], words.vectors[forks.passed == 0])
    for fork in np.unique(passed)[::9]:
        for unit in (1, 8):
            up = words.vectors.astype(float)
            up[fork, unit] += 1e-4
            slope = (loss(words._replace(vectors=up), layer) - loss(words, layer)) / 1e-4
            step = forks.words.vectors[fork, unit] - words.vectors[fork, unit]
            assert abs(slope) < 1e-5 or slope * step < 0
    assert loss(forks.words, layer) < loss(words, layer)


def test_group_sums_by_plain_loops():
    """Groups of one row, of a few and of many, as the forks of a step have them."""
    made = np.random.default_rng(13)
    for sizes in ([1], [1, 1, 2, 3, 4, 5, 1, 200], made.integers(1, 9, 300), [500]):
        rows = made.standard_normal((int(np.sum(sizes)), L.WIDTH)).astype(np.float32)
        first = np.cumsum(sizes) - np.array(sizes)
        plain = [part.astype(float).sum(0) for part in np.split(rows, first[1:])]
        assert np.allclose(L._group_sums(rows, first), plain, atol=1e-4)


def test_products_of_a_way_by_plain_loops():
    words, _ = tiny()
    made = np.random.default_rng(14)
    slots = made.integers(0, L.SLOTS, 40)
    layer, vectors = made.standard_normal((40, L.WIDTH)).astype(np.float32), made.standard_normal((L.SLOTS, L.WIDTH)).astype(np.float32)
    order, levels, fork, _ = L.ways(words, slots)
    plain = [vectors[f] @ layer[order[i]] for k, start, end in levels for i, f in enumerate(fork[start:end])]
    assert np.allclose(L._dots(vectors[fork], layer[order], levels), plain, atol=1e-4)
