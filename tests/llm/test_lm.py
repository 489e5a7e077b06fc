"""LM scoring: counts, the network's gradients, and scores against a plain reckoning."""

import math
from collections import Counter

import numpy as np

from meridia.llm import lm
from tests.llm.helpers import docs, prose


def test_classes_follow_the_distinct_words():
    sizes = [lm.words_for(n) for n in (0, 10**5, 10**6, 10**8, 10**10)]
    assert sizes == sorted(sizes) and sizes[0] == lm.FREQUENT and len(set(sizes)) == 5


def _network(classes, seed=1):
    rng = np.random.default_rng(seed)
    network = lm.Network.fresh(np.concatenate([[0], rng.integers(1, 50, classes)]))
    network.parts[:6] = [(p + rng.standard_normal(p.shape) * 0.2).astype(np.float32) if k != 5 else p for k, p in enumerate(network.parts[:6])]
    return network


def _plain(network, classes, k):
    """The log-probabilities of all classes at place k, one by one."""
    near, bias, groups, group_bias, members, member_bias = [p.astype(float) for p in network.parts[:6]]
    total = bias.copy()
    for j, offset in enumerate(lm.OFFSETS):
        total += near[classes[k + offset] if 0 <= k + offset < len(classes) else 0][j * lm.WIDTH : (j + 1) * lm.WIDTH]
    hidden = np.tanh(total)
    outer = groups @ hidden + group_bias
    outer -= np.log(np.exp(outer).sum())
    out = []
    for g in range(len(groups)):
        inner = members[g] @ hidden + member_bias[g]
        out += list(outer[g] + inner - np.log(np.exp(inner).sum()))
    return np.array(out)


def test_log_probs_are_a_distribution_of_both_sides():
    network, rng = _network(23), np.random.default_rng(2)
    texts = [rng.integers(1, 24, n).astype(np.int32) for n in (1, 2, 9, 40)]
    row, starts = lm.stream(texts)
    found = np.concatenate([network.log_probs(c) for c in lm.cuts(row, 7)])
    want = [_plain(network, t, k)[t[k] - 1] for t in texts for k in range(len(t))]
    assert np.allclose(found, want, atol=1e-4)
    everything = _plain(network, texts[2], 4)
    assert math.isclose(np.exp(everything).sum(), 1, rel_tol=1e-6) and np.exp(everything[23:]).sum() < 1e-12


def test_steps_follow_the_gradient(monkeypatch):
    network, rng = _network(11), np.random.default_rng(3)
    cut = lm.stream([rng.integers(1, 12, 30).astype(np.int32)])[0]
    grads = {}
    monkeypatch.setattr(lm.Network, "_change", lambda self, part, at, grad: grads.setdefault(part, []).append((at, grad)))
    network.step(cut)
    for part, changes in grads.items():
        whole = np.zeros(network.parts[part].shape)
        for at, grad in changes:
            whole[at] += grad
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in whole.shape)
            losses = []
            for sign in (1, -1):
                network.parts[part][at] += sign * 1e-2
                losses.append(-network.log_probs(cut).sum())
                network.parts[part][at] -= sign * 1e-2
            assert math.isclose((losses[0] - losses[1]) / 2e-2, whole[at], rel_tol=0.03, abs_tol=0.03), (part, at)


def test_training_lowers_the_loss_and_order_scores_higher(spark, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 64)
    pattern = " ".join(["red fox runs far away now"] * 100)
    texts = [(k, pattern) for k in range(24)] + [(100, " ".join(sorted(pattern.split()))), (200, None), (300, "")]
    table = docs(spark, texts).repartition(3)
    model = lm.fit(table)
    assert model.losses[-1] < model.losses[0] and model.losses[-1] < math.log(6) / 2
    found = {r["doc_id"]: r for r in lm.scored(table, model).collect()}
    assert found[0]["mean_log_prob"] > found[100]["mean_log_prob"]
    assert found[200]["n_tokens"] == 0 and found[200]["log_prob"] == 0 and found[200]["mean_log_prob"] is None and found[300]["mean_log_prob"] is None


def test_scores_against_a_plain_reckoning(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 8)
    monkeypatch.setattr(lm, "HEAD", 64)  # words of fewer than 1 in 64 tokens are joined
    texts = {k: " ".join(prose(k, 60, 90)) for k in range(30)} | {50: "Only-once w1 W1 ünseen", 51: "w1"}
    table = docs(spark, [*texts.items(), (50, texts[50]), (None, "w2 never w3")]).repartition(3)
    model = lm.fit(table.filter("doc_id is not null"))
    words = lambda t: t.replace("-", " ").lower().split()
    every = Counter(w for k, t in [*texts.items(), (50, texts[50])] for w in words(t))
    assert {bytes(r["word"]).decode(): r["n"] for r in model.words.collect()} == every
    classes = lm.Classes(model.scorer.frequent, model.scorer.words)
    total = Counter()
    for w, n in every.items():
        total[classes.one(w.encode())] += n

    def want(text):
        ids, out = classes.of([w.encode() for w in words(text)]), 0.0
        for k, w in enumerate(words(text)):
            out += _plain(model.scorer.network, ids, k)[ids[k] - 1]
            if ids[k] >= classes.first:
                out += math.log(every.get(w, 1) / total[ids[k]])
        return out

    found = {r["doc_id"]: r["log_prob"] for r in lm.scored(table, model).collect()}
    for doc, text in [*texts.items(), (None, "w2 never w3")]:
        assert math.isclose(found[doc], want(text), rel_tol=1e-4), doc


def test_empty_table(spark):
    table = docs(spark, [])
    assert lm.scored(table, lm.fit(table)).count() == 0


def test_texts_are_read_twice(spark):
    reads = spark.sparkContext.accumulator(0)
    rows = [(k, " ".join(prose(k, 20, 40))) for k in range(40)]

    def read(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    table = docs(spark, rows)
    table = table.mapInArrow(read, table.schema)
    model = lm.fit(table)
    found = lm.scored(table, model).collect()
    assert len(found) == 40 and reads.value == 2 * 40  # to count and to encode, not in every round
    again = {r["doc_id"]: r["log_prob"] for r in lm.scored(docs(spark, rows), model).collect()}
    assert all(math.isclose(again[r["doc_id"]], r["log_prob"], rel_tol=1e-5) for r in found)


def test_encoded_rows_keep_texts_apart():
    encoder = lm.Encoder([b"a", b"b"], 2, np.log([1.0, 5, 4, 9]), {b"a": 5, b"b": 4, b"c": 3})
    texts = [[b"a", b"c"], [], [b"x", b"b", b"x", b"y"], [b"x"], []]
    rows, shares, many, rare, times = encoder.encode(texts)
    assert [r.tolist() for r in rows] == [[1, 3], [], [3, 2, 3, 3], [3], []]
    assert np.allclose(shares, [math.log(3 / 9), 0, -3 * math.log(9), -math.log(9), 0])
    assert (many.tolist(), rare, times.tolist()) == ([0, 0, 2, 1, 0], [b"x", b"y", b"x"], [2, 1, 1])
    assert [len(x) for x in encoder.encode([])] == [0] * 5 and [len(r) for r in encoder.encode([[], []])[0]] == [0, 0]


def test_many_classes_need_wider_numbers():
    assert lm.Classes([], 1 << 15).kind is np.uint16 and lm.Classes([], 1 << 16).kind is np.int32
    for big in (9, 70000):
        order, found, first = lm._sorted(np.array([big, 3, big, 3, 0], dtype=np.int32))
        assert (order.tolist(), found.tolist(), first.tolist()) == ([4, 1, 3, 0, 2], [0, 3, big], [0, 1, 3])
    assert [x.tolist() for x in lm._sorted(np.zeros(0, dtype=np.int32))] == [[], [], []]
