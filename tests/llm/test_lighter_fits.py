"""The fits hold and send no more than they need."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from orthoflow.llm import quality, recurrent_lm


def test_columns_reach_the_driver_packed():
    columns = np.unique(np.random.default_rng(1).integers(0, quality.DIM, 1500))
    packed = quality.pack(columns)
    assert len(packed) < 0.6 * 4 * len(columns) and (quality.unpack(packed) == columns).all()
    assert len(quality.unpack(quality.pack(np.zeros(0, np.int64)))) == 0


def test_fit_holds_no_second_copy_of_its_rows():
    random = np.random.default_rng(2)
    rows = [np.unique(random.integers(0, quality.DIM, 4000)).astype(np.int32) for _ in range(1000)]
    labels = np.arange(1000) % 2
    tracemalloc.start()
    quality.fit(rows, labels, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(r.nbytes for r in rows)


def test_training_lists_no_unknown_words():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c", "", "b d"])], ["text"])
    lookup = {b"a": 1, b"b": 2}
    (_, ids, words), = recurrent_lm._token_batches([batch], lookup, unknown=False)
    assert [i.tolist() for i in ids] == [[1, 2, -1], [], [2, -1]] and words == []
    (_, _, words), = recurrent_lm._token_batches([batch], lookup)
    assert words == [[b"c"], [], [b"d"]]


def test_words_are_cut_in_pieces_of_batches(monkeypatch):
    """Words are those of bytes.lower().split(), wherever the pieces of a batch begin."""
    monkeypatch.setattr(recurrent_lm, "RUN_BYTES", 40)
    texts = ["", " A\tb\x0bC\x0c", "\u00c9t\u00c9 \u2003x \x1c\x85", "\n\n", "One two  THREE", "x" * 90, "\u00d8l Z\r"] * 9
    wanted = [t.encode().lower().split() for t in texts]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, kind), pa.array(range(len(texts)))], ["text", "doc_id"])
        (cells, ids, words), = recurrent_lm._token_batches([batch.slice(2, 50)], {b"b": 1})
        assert [c for c, in cells] == list(range(2, 52)) and [len(i) for i in ids] == [len(w) for w in wanted[2:52]]
        assert words == [[x for x in w if x != b"b"] for w in wanted[2:52]]
        counted: dict = {}
        for out in recurrent_lm._count(iter([batch.select(["text"])])):
            for word, n in zip(*(c.to_pylist() for c in out.columns)):
                counted[word] = counted.get(word, 0) + n
        assert counted == {w: sum(x.count(w) for x in wanted) for w in {w for x in wanted for w in x}}


def test_scoring_holds_less_than_its_lanes_twice():
    """A task's documents are packed once, and no word is held as an object but the unknown ones."""
    random = np.random.default_rng(4)
    tokens = [random.integers(0, 1000, 4000).astype(np.int32) for _ in range(300)]
    tracemalloc.start()
    arrays = recurrent_lm.packed(tokens, recurrent_lm.LANES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.3 * sum(a.nbytes for a in arrays)


def test_output_is_one_product_over_all_classes(monkeypatch):
    """Two softmaxes whatever the number of classes; values and gradients are those of token-by-token ones."""
    vocabulary = recurrent_lm.Vocabulary([b"%d" % k for k in range(3000)], np.arange(3000, 0, -1), 40, 4_501_540, 3001)
    start = recurrent_lm.Network.start(vocabulary)
    net, size = recurrent_lm.Network(start.vector.astype(np.float64), start.classes), recurrent_lm.CLASS_SIZE
    random = np.random.default_rng(5)
    states, targets = random.normal(size=(90, recurrent_lm.STATE)), random.integers(0, 300, 90)
    targets[::7], targets[3] = vocabulary.named(), 0  # the class of the others, and the end
    calls, softmax = [], recurrent_lm.Network._softmax
    monkeypatch.setattr(recurrent_lm.Network, "_softmax", staticmethod(lambda *a: calls.append(1) or softmax(*a)))

    def plain() -> float:
        total = 0.0
        for h, target in zip(states, targets):
            x, c = np.append(h, 1), min(target // size, net.classes)
            e = x @ net.class_w
            total += e[c] - np.log(np.exp(e).sum())
            if c < net.classes:
                e = x @ net.word_w[c]
                total += e[target % size] - np.log(np.exp(e).sum())
        return total

    logs, by_state, by_class, present, by_word = net.output(states, targets, 1.0)
    assert len(calls) == 2 and abs(logs.sum() - plain()) < 1e-9 and present.tolist() == sorted({t // size for t in targets if t < vocabulary.named()})
    for weights, at, found in ((net.class_w, (2, net.classes), by_class[2, net.classes]), (net.word_w, (present[-1], 4, 1), by_word[-1][4, 1]),
                               (net.word_w, (0, recurrent_lm.STATE, 0), by_word[0][recurrent_lm.STATE, 0]), (states, (8, 3), by_state[8, 3]), (states, (7, 0), by_state[7, 0])):
        own = weights[at]
        ends = []
        for step in (1e-5, -1e-5):
            weights[at] = own + step
            ends.append(plain())
        weights[at] = own
        assert abs((ends[0] - ends[1]) / 2e-5 - found) < 1e-6


def test_training_leaves_words_that_do_not_occur():
    vocabulary = recurrent_lm.Vocabulary([b"%d" % k for k in range(1500)], np.arange(1500, 0, -1), 40, 1_125_790, 1501)
    net = recurrent_lm.Network.start(vocabulary)
    before = recurrent_lm.Network(net.vector.copy(), net.classes)
    sums = recurrent_lm.Network(np.full(len(net.vector), 1e-3, np.float32), net.classes)
    inputs, targets, keep, doc = recurrent_lm.packed([np.array([5, 70, 5, 0], np.int32), np.array([70, 0], np.int32)], 2)
    net.learn(inputs, targets, keep, doc >= 0, np.zeros((inputs.shape[1], recurrent_lm.STATE), np.float32), sums)
    assert sorted(np.flatnonzero((net.table != before.table).any(axis=1))) == [0, 5, 70]
    assert sorted(np.flatnonzero((net.word_w != before.word_w).any(axis=(1, 2)))) == [0, 2]
    assert ((sums.vector > np.float32(1e-3)) == (net.vector != before.vector)).mean() > 0.999 and np.isfinite(net.vector).all()
