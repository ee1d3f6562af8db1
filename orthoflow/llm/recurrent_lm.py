"""Document scores of a gated recurrent language model over words, beside a unigram base score.

Tokens are words (``[^\\x20\\x09-\\x0D]+``, A-Z as a-z) and one end per document. Corpus counts are exact and
cover all training documents (crc32 of the id modulo ``FOLDS`` is not 0).

The model reads a document word by word and predicts the next token from its state:

* The most frequent words and the end are *named*: ``NAMED - 1`` (1,023) words, and as many more as it takes to hold
  ``COVER`` of the training tokens, so the vocabulary grows with the corpus (up to the ``HEAD`` counts). They are dealt
  into classes by frequency. The output is factored: a softmax over classes times a softmax inside the class.
* All other words are one further class. Inside it a word has its smoothed share of that class's
  training tokens, so every token gets a probability and the tail needs no weights.
* Training is one pass over all training documents by truncated backpropagation (windows of ``STEPS`` words,
  state carried across windows, reset between documents) with AdaGrad, in ``ROUNDS`` rounds: in a round
  every task trains from the same weights on its own documents, then the weights are averaged by tokens.
  Averages are summed on the executors; the driver sees one set of weights.
* Scoring carries the state through the whole document.

Counts of the ``HEAD`` most frequent words (of at most ``HEAD_BYTES`` bytes) go to every task; the rest, of unbounded
number, is joined by word, one row per document and word.

Null texts count as empty and are one end. A null id is in the held-out fold. Repeated rows are scored each.
Without training documents the base score uses N = V = 0 and all known counts are 0. No rows give no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import empty_text, fold_of, materialise, text_chunks

FOLDS = 10
SMOOTH = 0.1
CLASSES, CLASS_SIZE = 32, 32
NAMED = CLASSES * CLASS_SIZE  # named tokens at least; the end is token 0, the token after the named ones stands for all others
COVER = 0.475
STATE = 16
LANES = 256
STEPS = 16
SCORE_STEPS = 64
ROUNDS = 2
RATE = 0.08
HEAD = 1 << 17
HEAD_BYTES = 64
PART = 4096
BATCH_TOKENS = 1 << 22
SCORE_TOKENS = 1 << 21
RUN_BYTES = 1 << 21  # text cut into words at once
COUNT_BYTES = 1 << 23
BLOCK = 8  # tokens of one class that are multiplied at once


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of ``texts`` one after the other, where each text's words start and, last, where they end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    words, cuts = lists.values, np.asarray(lists.offsets)
    solid = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end of a text leaves an empty piece
    if not solid.all():
        words, cuts = words.filter(pa.array(solid)), np.concatenate([[0], np.cumsum(solid)])[cuts]
    return words.cast(pa.large_binary()), cuts


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches, of about ``limit`` bytes of text; copied, as Arrow 23 lower-cases a slice of large strings wrongly."""
    for batch in batches:
        for row, offsets, _ in text_chunks(batch.column("text"), limit):
            yield batch.take(pa.array(np.arange(row, row + len(offsets) - 1)))


# ---- corpus counts ------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches, COUNT_BYTES):
        words, n = text_words(run.column("text"))[0].value_counts().flatten()
        yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), n], ["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all words of ``texts``; combined in the tasks before the shuffle."""
    return texts.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words with counts; ``total`` and ``distinct`` cover all training tokens, the end too."""

    words: list[bytes]
    counts: np.ndarray
    ends: int
    total: int
    distinct: int

    def classes(self) -> int:
        """Classes that hold COVER of the training tokens, CLASSES at least."""
        covered = self.ends + np.cumsum(self.counts)
        words = min(int(np.searchsorted(covered, COVER * self.total)) + 1, len(self.counts))
        return max(CLASSES, -(-(words + 1) // CLASS_SIZE))

    def named(self) -> int:
        return self.classes() * CLASS_SIZE

    def lookup(self) -> dict[bytes, int]:
        return {w: i + 1 for i, w in enumerate(self.words)}  # 0 is the end

    def base(self) -> np.ndarray:
        """log10 of the base probability of the end and of every listed word."""
        own = np.concatenate([[self.ends], self.counts]).astype(float)
        return np.log10(own + SMOOTH) - self.base_norm()

    def base_norm(self) -> float:
        return math.log10(self.total + SMOOTH * (self.distinct + 1))

    def rest_norm(self) -> float:
        """log10 of the smoothed number of tokens outside the named ones."""
        listed = self.named() - 1
        named = int(self.counts[:listed].sum()) + self.ends
        kinds = self.distinct - min(len(self.words), listed) - (self.ends > 0)
        return math.log10(self.total - named + SMOOTH * (kinds + 1))


# ---- the network ----------------------------------------------------------------------------------

class Network:
    """A GRU with class-factored output. All weights live in one vector so that they can be averaged."""

    @staticmethod
    def shapes(classes: int) -> dict[str, tuple]:
        return {
            "table": (classes * CLASS_SIZE + 1, 3 * STATE), "u": (STATE, 3 * STATE), "bias": (3 * STATE,),
            "class_w": (STATE + 1, classes + 1), "word_w": (classes, STATE + 1, CLASS_SIZE)}  # the last row of both is the bias

    def __init__(self, vector: np.ndarray, classes: int):
        self.vector, self.classes, at = vector, classes, 0
        for name, shape in self.shapes(classes).items():
            size = int(np.prod(shape))
            setattr(self, name, vector[at:at + size].reshape(shape))
            at += size

    @classmethod
    def size(cls, classes: int) -> int:
        return sum(int(np.prod(s)) for s in cls.shapes(classes).values())

    @classmethod
    def start(cls, vocabulary: Vocabulary, seed: int = 3) -> Network:
        """Small random weights; output biases start at the unigram distribution."""
        classes, named = vocabulary.classes(), vocabulary.named()
        net = cls(np.zeros(cls.size(classes), np.float32), classes)
        random = np.random.default_rng(seed)
        net.table[:] = random.normal(0, 0.3, net.table.shape)
        net.u[:] = random.normal(0, 1 / math.sqrt(STATE), net.u.shape)
        net.class_w[:STATE] = random.normal(0, 0.05, (STATE, classes + 1))
        net.word_w[:, :STATE] = random.normal(0, 0.05, (classes, STATE, CLASS_SIZE))
        own = np.full(named, SMOOTH)
        own[0] += vocabulary.ends
        listed = vocabulary.counts[:named - 1]
        own[1:len(listed) + 1] += listed
        groups = own.reshape(classes, CLASS_SIZE)
        net.word_w[:, STATE] = np.log(groups / groups.sum(axis=1, keepdims=True))
        rest = max(vocabulary.total - own.sum(), 0) + SMOOTH
        shares = np.append(groups.sum(axis=1), rest)
        net.class_w[STATE] = np.log(shares / shares.sum())
        return net

    def run(self, tokens: np.ndarray, keep: np.ndarray, h: np.ndarray, tape: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each step of a window (steps x lanes); ``keep`` is 0 where a document starts.

        ``tape`` takes the states before each step, the two gates, the new parts and their recurrent inputs.
        """
        s, states = STATE, np.empty((len(tokens), len(h), STATE), np.float32)
        resets = set(np.flatnonzero((keep == 0).any(axis=1)).tolist())
        inputs, u = self.table.take(tokens, axis=0), self.u.copy()
        inputs += self.bias
        for part in (inputs[..., :2 * s], u[:, :2 * s]):  # exp takes the gates' negative sums
            np.negative(part, out=part)
        a, gates, n = np.empty((len(h), 3 * s), np.float32), np.empty((len(h), 2 * s), np.float32), np.empty((len(h), s), np.float32)
        with np.errstate(over="ignore"):  # exp may reach infinity: the gate is 0 then
            for t in range(len(tokens)):
                if t in resets:
                    h = h * keep[t][:, None]
                if tape is not None:
                    before, all_gates, all_n, all_a = tape
                    before[t], gates, n, a = h, all_gates[t], all_n[t], all_a[t]
                x = inputs[t]
                np.matmul(h, u, out=a)
                np.add(x[:, :2 * s], a[:, :2 * s], out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                np.multiply(gates[:, s:], a[:, 2 * s:], out=n)
                n += x[:, 2 * s:]
                np.tanh(n, out=n)
                new = np.subtract(h, n, out=states[t])
                new *= gates[:, :s]
                new += n
                h = new
        return states, h.copy()

    @staticmethod
    def _softmax(e: np.ndarray, chosen: tuple, axis: int, scale: np.ndarray | None) -> np.ndarray:
        """Log probability of the chosen logits; with ``scale`` (by token) ``e`` becomes their gradient times it."""
        logs = e[chosen]
        np.minimum(e, 60, out=e)  # logits are far below; a bound in place of a row maximum
        np.exp(e, out=e)
        total = e.sum(axis=axis)
        logs -= np.log(total)[chosen[1 - axis]]
        if scale is not None:
            e *= np.expand_dims(-scale / total, axis)
            e[chosen] += scale[chosen[1 - axis]]
        return logs

    def output(self, states: np.ndarray, targets: np.ndarray, scale: float | None = None):
        """Natural-log probability of each target; with ``scale`` also the gradients times it.

        These are those of the states, of ``class_w``, and of ``word_w`` for the classes that occur, with their numbers.
        Tokens are put in order of class, each class in blocks of ``BLOCK`` places with its own weights, so that all blocks
        are one product; places left over are empty and have no gradient.
        """
        group = np.minimum(targets // CLASS_SIZE, self.classes)
        order = np.argsort(group, kind="stable")
        x, group, targets = np.ones((len(order), STATE + 1), states.dtype), group[order], targets[order]  # the last column is for the bias
        x[:, :STATE] = states[order]
        e = self.class_w.T @ x.T
        logs = self._softmax(e, (group, np.arange(len(order))), 0, None if scale is None else np.full(len(order), scale, e.dtype))
        counts = np.bincount(group, minlength=self.classes + 1)[:self.classes]
        blocks, n = -(-counts // BLOCK), int(counts.sum())
        first = np.cumsum(blocks) - blocks
        place = np.repeat(first * BLOCK - np.cumsum(counts) + counts, counts) + np.arange(n)
        w = self.word_w.take(np.repeat(np.arange(self.classes), blocks), axis=0)
        own = np.zeros((len(w), BLOCK, STATE + 1), states.dtype)
        own.reshape(-1, STATE + 1)[place] = x[:n]
        each = np.matmul(own, w)
        flat = each.reshape(-1, CLASS_SIZE)
        real = None
        if scale is not None:
            real = np.zeros(len(flat), flat.dtype)
            real[place] = scale
        logs[:n] += self._softmax(flat, (place, targets[:n] % CLASS_SIZE), 1, real)
        out = np.empty(len(order), logs.dtype)
        out[order] = logs
        if scale is None:
            return out
        back = e.T @ self.class_w[:STATE].T
        back[:n] += np.matmul(each, w[:, :STATE].transpose(0, 2, 1)).reshape(-1, STATE)[place]
        d_states = np.empty(states.shape, states.dtype)
        d_states[order] = back
        present = np.flatnonzero(blocks)
        by_word = np.matmul(own.transpose(0, 2, 1), each)
        return out, d_states, x.T @ e.T, present, np.add.reduceat(by_word, first[present], axis=0) if len(present) else by_word

    def learn(self, tokens: np.ndarray, targets: np.ndarray, keep: np.ndarray, real: np.ndarray, h: np.ndarray, sums: Network) -> np.ndarray:
        """One window of truncated backpropagation and an AdaGrad step; returns the state to carry on.

        Words and classes that do not occur in the window have no gradient, so only the others' weights are read.
        """
        s, size = STATE, tokens.shape
        tape = tuple(np.empty((*size, k * s), np.float32) for k in (1, 2, 1, 3))
        states, last = self.run(tokens, keep, h, tape)
        flat = np.flatnonzero(real.ravel())
        if not len(flat):
            return last
        _, back, by_class, present, by_word = self.output(states.reshape(-1, s)[flat], targets.ravel()[flat], 1.0 / len(flat))
        d_states = np.zeros((states.shape[0] * states.shape[1], s), states.dtype)
        d_states[flat] = back
        d_states = d_states.reshape(states.shape)
        before, gates, n, a_n = tape
        z, r, a_n = gates[..., :s], gates[..., s:], a_n[..., 2 * s:]
        by_n = (1 - z) * (1 - n * n)
        by = np.stack([(before - n) * z * (1 - z), by_n * a_n * r * (1 - r), by_n * r], axis=2)  # by the two gates and the recurrent input
        d_a = np.empty((*states.shape[:2], 3 * s), states.dtype)
        parts, resets = d_a.reshape(by.shape), set(np.flatnonzero((keep == 0).any(axis=1)).tolist())
        d_all = np.empty_like(states)
        carried, back_u = np.zeros_like(last), np.ascontiguousarray(self.u.T)
        for t in range(len(tokens) - 1, -1, -1):
            d = np.add(d_states[t], carried, out=d_all[t])
            np.multiply(d[:, None], by[t], out=parts[t])
            carried = d_a[t] @ back_u
            carried += d * z[t]
            if t in resets:
                carried *= keep[t][:, None]
        d_a = d_a.reshape(-1, 3 * s)
        by_u = before.reshape(-1, s).T @ d_a
        d_a[:, 2 * s:] = (d_all * by_n).reshape(-1, s)  # from here on: by the inputs
        ids = tokens.ravel()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        every = slice(None)
        grads = (("u", every, by_u), ("bias", every, d_a.sum(axis=0)), ("class_w", every, by_class),
                 ("table", ids[first], np.add.reduceat(d_a[order], first, axis=0)), ("word_w", present, by_word))
        norm = max(1.0, math.sqrt(sum(float(np.vdot(g, g)) for _, _, g in grads)))
        for name, where, g in grads:
            g /= norm
            total, weights = getattr(sums, name), getattr(self, name)
            step = np.square(g)
            step += total[where]
            total[where] = step
            np.sqrt(step, out=step)
            np.divide(g, step, out=step)
            step *= RATE
            weights[where] += step
        return last


# ---- documents in lanes ----------------------------------------------------------------------------

def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first, each to the shortest lane."""
    import heapq

    heap = [(0, k) for k in range(min(lanes, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for doc in np.argsort(-lengths, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        out[k].append(doc)
        heapq.heappush(heap, (load + int(lengths[doc]), k))
    return out


def packed(tokens: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, keep, document or -1), each steps x lanes; a document's first input is the end token.

    There are fewer lanes where one document is longer than an even share, so that few lanes run empty.
    """
    lengths = np.array([len(t) for t in tokens])
    dealt = lanes_of(lengths, int(min(lanes, max(16, lengths.sum() // lengths.max()))))
    steps = max(sum(len(tokens[d]) for d in lane) for lane in dealt)
    shape = (steps, len(dealt))
    inputs, targets, keep, doc = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.ones(shape, np.float32), np.full(shape, -1, np.int32)
    for k, lane in enumerate(dealt):
        at = 0
        for d in lane:
            n = len(tokens[d])
            targets[at:at + n, k] = tokens[d]
            inputs[at + 1:at + n, k] = tokens[d][:-1]
            keep[at, k], doc[at:at + n, k] = 0, d
            at += n
    return inputs, targets, keep, doc


def _token_batches(batches: Iterator[pa.RecordBatch], lookup: dict[bytes, int], unknown: bool = True,
                   tokens: int = BATCH_TOKENS) -> Iterator[tuple[list, list[np.ndarray], list[list[bytes]]]]:
    """Runs of documents of about ``tokens`` words: (other cells, ids, words of no id where asked for); unknown words are -1."""
    listed, numbers = pa.array(list(lookup), pa.large_binary()), np.array([*lookup.values(), -1], np.int32)
    del lookup
    cells, ids, words, size = [], [], [], 0
    for batch in _runs(batches, RUN_BYTES):
        others = [batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != "text"]
        flat, cuts = text_words(batch.column("text"))
        found = numbers[pc.fill_null(pc.index_in(flat, listed), -1).to_numpy(zero_copy_only=False)]
        if unknown:
            missed = np.flatnonzero(found < 0)
            rest, ends = flat.take(pa.array(missed)).to_pylist(), np.searchsorted(missed, cuts)
        for row in range(len(batch)):
            own = found[cuts[row]:cuts[row + 1]]
            cells.append([o[row] for o in others])
            ids.append(own)
            if unknown:
                words.append(rest[ends[row]:ends[row + 1]])
            size += len(own) + 1
            if size >= tokens:
                yield cells, ids, words
                cells, ids, words, size = [], [], [], 0
    if cells:
        yield cells, ids, words


def _named(ids: np.ndarray, named: int) -> np.ndarray:
    """Model tokens of a document, the end included."""
    return np.append(np.where((ids < 0) | (ids >= named), named, ids), 0).astype(np.int32)


def _train(state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vector, classes = state.value
        net, seen = Network(vector.copy(), classes), 0
        sums = Network(np.full(len(vector), 1e-3, np.float32), classes)
        for _, ids, _ in _token_batches(batches, {w: i + 1 for i, w in enumerate(words)}, unknown=False):
            inputs, targets, keep, doc = packed([_named(x, classes * CLASS_SIZE) for x in ids], LANES)
            h = np.zeros((inputs.shape[1], STATE), np.float32)
            for a in range(0, len(inputs), STEPS):
                b = a + STEPS
                live = (doc[a:b] >= 0).any(axis=0)  # lanes that ended are left out
                h[live] = net.learn(inputs[a:b, live], targets[a:b, live], keep[a:b, live], doc[a:b, live] >= 0, h[live], sums)
            seen += int((doc >= 0).sum())
        if seen:
            parts = [(net.vector[k:k + PART].astype(np.float64) * seen).tobytes() for k in range(0, len(vector), PART)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int64()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["part", "seen", "values"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for part, seen, values in zip(*(c.to_pylist() for c in batch.columns)):
            row = np.frombuffer(values, np.float64)
            if part in sums:
                sums[part][0] += seen
                sums[part][1] += row
            else:
                sums[part] = [seen, row.copy()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int64()), pa.array([s for s, _ in sums.values()], pa.int64()), pa.array([v.tobytes() for _, v in sums.values()], pa.binary())],
        ["part", "seen", "values"])


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    """One pass over ``texts`` (doc_id, text) in ``rounds`` rounds of local training and averaging."""
    net, kind = Network.start(vocabulary), "part long, seen long, values binary"
    spark = texts.sparkSession
    for k in range(rounds):
        state = spark.sparkContext.broadcast((vocabulary.words[:vocabulary.named() - 1], net.vector, net.classes))
        own = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k)
        sums = own.select("text").mapInArrow(_train(state), kind).repartition("part").mapInArrow(_added, kind).collect()  # one set of weights
        if sums:
            rows = sorted(sums, key=lambda r: r["part"])
            net = Network(np.concatenate([np.frombuffer(r["values"], np.float64) / r["seen"] for r in rows]).astype(np.float32), net.classes)
    return net


def _score(state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, vector = state.value
        base, named = vocabulary.base(), vocabulary.named()
        net, norm = Network(vector, vocabulary.classes()), vocabulary.rest_norm()
        rest = base + vocabulary.base_norm() - norm  # listed words inside the class of the others
        known = np.concatenate([[vocabulary.ends], vocabulary.counts]) > 0
        for cells, ids, words in _token_batches(batches, vocabulary.lookup(), tokens=SCORE_TOKENS):
            inputs, targets, keep, doc = packed([_named(x, named) for x in ids], LANES)
            scores, h = np.zeros(len(ids)), np.zeros((inputs.shape[1], STATE), np.float32)
            for a in range(0, len(inputs), SCORE_STEPS):
                b = a + SCORE_STEPS
                live = (doc[a:b] >= 0).any(axis=0)
                states, h[live] = net.run(inputs[a:b, live], keep[a:b, live], h[live])
                where = doc[a:b, live].ravel()
                real = np.flatnonzero(where >= 0)
                logs = net.output(states.reshape(-1, STATE)[real], targets[a:b, live].ravel()[real])
                scores += np.bincount(where[real], logs, len(ids))
            scores /= math.log(10)
            plain, n_known = np.empty(len(ids)), np.empty(len(ids), np.int64)
            tails, cuts = [], [0]
            for k, own in enumerate(ids):
                hit = own[own >= 0]
                plain[k] = base[hit].sum() + base[0]
                scores[k] += rest[hit[hit >= named]].sum()
                n_known[k] = len(hit) + bool(known[0])
                tails += Counter(words[k]).items()
                cuts.append(len(tails))
            pairs = pa.StructArray.from_arrays(
                [pa.array([w for w, _ in tails], pa.binary()), pa.array([n for _, n in tails], pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[0] for c in cells], pa.int64()), pa.array([c[1] for c in cells], pa.int64()),
                 pa.array([len(x) + 1 for x in ids], pa.int64()), pa.array(n_known), pa.array(plain), pa.array(scores),
                 pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)],
                ["_row", "doc_id", "n_tokens", "n_known", "base", "model", "rest"])

    return run


SCORED = "_row long, doc_id long, n_tokens long, n_known long, base double, model double, rest array<struct<word:binary,n:long>>"


def lm_scores(docs: DataFrame, folds: int = FOLDS, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text"))
    learned = texts.filter(fold_of("doc_id", folds) != 0)
    counts = materialise(word_counts(learned))
    ends = learned.count()
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = counts.filter(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(head).collect()  # head rows of bounded size
    vocabulary = Vocabulary([bytes(r["word"]) for r in top], np.array([r["n"] for r in top], np.int64), ends, (whole["n"] or 0) + ends, whole["v"] + (ends > 0))
    net = train(learned, vocabulary, rounds)
    state = docs.sparkSession.sparkContext.broadcast((vocabulary, net.vector))
    scored = materialise(texts.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text").mapInArrow(_score(state), SCORED))
    tail = scored.select("_row", F.explode("rest").alias("r")).select("_row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    log = F.log10(F.coalesce(F.col("n"), F.lit(0)) + SMOOTH)
    sums = tail.join(counts, "word", "left").groupBy("_row").agg(
        F.sum("times").alias("times"), F.sum(F.col("times") * log).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("base") + zero(F.col("logs")) - zero(F.col("times")) * vocabulary.base_norm()
    model = F.col("model") + zero(F.col("logs")) - zero(F.col("times")) * vocabulary.rest_norm()
    return scored.drop("rest").join(sums, "_row", "left").select(
        "doc_id", (fold_of("doc_id", folds) == 0).alias("held_out"), "n_tokens", (F.col("n_known") + zero(F.col("known"))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), base.alias("base_score"), model.alias("score"))
