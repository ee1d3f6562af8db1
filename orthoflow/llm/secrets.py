"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds spans.

Base spans (leftmost, non-overlapping per kind): ``assign``, ``access`` and ``hex``; see ``PATTERNS``.
The field tags words (``[^\\x20\\x09-\\x0D]+``) as begin, inside or outside of a secret. Its features are the
shape and the hash of the word and its neighbours, and how the file is written (length, digits, signs).
It learns from windows of words: around base spans of any document of the corpus (found in a scan of all texts), and around other
words with digits and plain ones of the ``SAMPLE`` documents whose ids have the smallest hash; at most ``WINDOWS`` of each kind, those
with the smallest hash, and at most ``SPANS_OF_ONE`` spans of one document, chosen by hash. Training maximises the likelihood by
forward-backward; tagging is Viterbi's best path over the whole text. Words whose score for *outside* beats
the others by more than any transitions could make up are outside in every best path, so only the words
between them are decoded (an exact shortcut). Added spans never overlap base spans.

Null texts count as empty and have no spans. Any number of words or any length of a text is scanned whole.
Repeated rows are reported each; a null id stays null. Without any base span in the corpus the field adds
nothing. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import empty_text, materialise, mix, text_chunks, word_hashes, word_spans

#: Fixed patterns of the contract: kind, expression, least length of the counted group.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")
OUT, BEGIN, IN = 0, 1, 2
SLOTS = 1 << 14
TEMPLATES = 9
WIDE = 16
SAMPLE = 1 << 14
WINDOWS = 1500
SPANS_OF_ONE = 4
CLIP = 4.0
BIAS = 2.0  # windows show more secrets than whole texts do: nats against a begin
TRIM = b"\"'`,;.!?()[]{}<>|"
SPAN = "array<struct<kind:string,start:long,end:long>>"
_EDGE = np.uint64(0x51ED270B)
_CLASS = np.zeros(256, np.int64)  # per byte: counts of digits, capitals, small letters, other ASCII in 16 bits each
_CLASS[48:58] = 1
_CLASS[65:91] = 1 << 16
_CLASS[97:123] = 1 << 32
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1 << 48
_HEX = np.zeros(256, np.int64)
_HEX[[*range(48, 58), *range(97, 103), *range(65, 71)]] = 1


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int, tuple[int, int]]]:
    """(start, kind number, end, counted group) of all base spans, in order; code points."""
    low, found = raw.lower(), []
    for number, (kind, pattern, group, least) in enumerate(PATTERNS):
        if kind == "assign" and not any(k in low for k in KEYWORDS) or kind == "access" and b"AKIA" not in raw:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), number, m.end(), m.span(group)))
    found.sort()
    return found


def features(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Columns (words x TEMPLATES) into one table of TEMPLATES * SLOTS rows."""
    n = len(starts)
    if not n:
        return np.zeros((0, TEMPLATES), np.int32)
    u = np.uint64
    length = ends - starts
    counts = np.concatenate([[0], np.cumsum(np.where(_CLASS[data] == 1, 1, 0))])
    digits = counts[ends] - counts[starts]
    sums = []
    for shift in (16, 32, 48):
        running = np.concatenate([[0], np.cumsum((_CLASS[data] >> shift) == 1)])
        sums.append(running[ends] - running[starts])
    capitals, small, signs = sums
    running = np.concatenate([[0], np.cumsum(_HEX[data])])
    hexes = running[ends] - running[starts]
    foreign = length - digits - capitals - small - signs
    size = np.searchsorted([3, 6, 10, 16, 24, 36, 64], length, "right")
    level = np.searchsorted([1, 2, 4, 8, 16], digits, "right")
    marks = np.minimum(signs, 3)
    shape = ((((size * 6 + level) * 4 + marks) * 2 + (capitals > 0)) * 2 + (small > 0)) * 2 + (foreign > 0)
    shape = (shape * 2 + (hexes >= length - signs)) * 2 + ((signs == length) & (length < 4))
    shape = mix(shape.astype(u))
    words = word_hashes(data, starts, ends)

    edge_before, edge_after = first[:-1][first[:-1] < n], first[1:] - 1
    edge_after = edge_after[edge_after >= 0]

    def moved(values: np.ndarray, by: int) -> np.ndarray:
        out = values
        for _ in range(abs(by)):
            out = np.roll(out, 1 if by < 0 else -1)
            out[edge_before if by < 0 else edge_after] = _EDGE
        return out

    chars = np.maximum(1, np.diff(offsets))
    file_digits = np.diff(counts[offsets]) / chars
    running = np.concatenate([[0], np.cumsum((_CLASS[data] >> 48) == 1)])
    file_signs = np.diff(running[offsets]) / chars
    file = (np.searchsorted([0.005, 0.05], file_digits) * 3 + np.searchsorted([0.05, 0.15], file_signs)) * 3 + np.searchsorted([500, 5000], chars)
    file = np.repeat(mix(file.astype(u)), np.diff(first))
    columns = [shape, moved(shape, -1), moved(shape, 1), words, moved(words, -1), moved(words, 1), moved(words, 2), moved(shape, 2), file]
    return np.stack([(c % u(SLOTS)).astype(np.int32) + k * SLOTS for k, c in enumerate(columns)], axis=1)


@dataclass
class Field:
    weights: np.ndarray  # rows x 3
    steps: np.ndarray  # 3 x 3, from row to column
    trained: bool = True

    def gain(self) -> float:
        """No tag but OUT can win at a word whose OUT score leads by more than this."""
        t, best = self.steps, 0.0
        for y in (BEGIN, IN):
            for p in (None, 0, 1, 2):
                for q in (None, 0, 1, 2):
                    before = 0.0 if p is None else t[p, y] - t[p, OUT]
                    after = 0.0 if q is None else t[y, q] - t[OUT, q]
                    best = max(best, before + after)
        return best

    def emissions(self, columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(columns), 3), np.float32)
        for k in range(columns.shape[1]):
            out += self.weights[columns[:, k]]
        out[:, BEGIN] -= BIAS
        return out

    def paths(self, scores: np.ndarray, begin: np.ndarray, end: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Tags of all words: Viterbi's best path in every run of words ``begin`` to ``end``, outside elsewhere.

        The words around a run are outside, none where it ``opens`` or ``closes`` its text. The runs are walked side by side, the
        longest first, so those that go on are always the first ones.
        """
        t, tags = self.steps, np.full(len(scores), OUT, np.int8)
        order = np.argsort(begin - end, kind="stable")
        begin, length, opens, closes = begin[order], (end - begin)[order], opens[order], closes[order]
        best = scores[begin] + np.where(opens[:, None], 0.0, t[OUT])
        going = [int(n) for n in np.searchsorted(-length, -np.arange(1, length[0]), "left")]  # runs of more than 1, 2, .. words
        back = []
        for k, n in enumerate(going, 1):
            paths = best[:n, :, None] + t
            back.append(paths.argmax(axis=1))
            best[:n] = paths.max(axis=1) + scores[begin[:n] + k]
        tag = (best + np.where(closes[:, None], 0.0, t[:, OUT])).argmax(axis=1)
        tags[begin + length - 1] = tag
        for k, n in reversed(list(enumerate(going))):
            tag[:n] = back[k][np.arange(n), tag[:n]]
            tags[begin[:n] + k] = tag[:n]
        return tags

    def tags(self, scores: np.ndarray) -> dict[int, int]:
        """Words of one text that are not outside, with their tags."""
        tags = self.tags_of_texts(scores, np.array([0, len(scores)]))
        return {int(word): int(tags[word]) for word in np.flatnonzero(tags != OUT)}

    def tags_of_texts(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tags of the words of several texts (the first word of each, and the end): Viterbi's best path of each text."""
        doubt = np.flatnonzero(scores[:, OUT] - scores[:, 1:].max(axis=1) <= self.gain())
        if not len(doubt):
            return np.full(len(scores), OUT, np.int8)
        edge = np.zeros(len(scores) + 1, bool)
        edge[first] = True
        starts = np.concatenate(([True], (np.diff(doubt) > 1) | edge[doubt[1:]]))
        begin, end = doubt[starts], doubt[np.append(starts[1:], True)] + 1
        return self.paths(scores, begin, end, edge[begin], edge[end])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(windows: list[tuple[np.ndarray, np.ndarray]], rounds: int = 12, batch: int = 64, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Field:
    """Maximum likelihood of the tags of ``windows`` (columns, tags) by forward-backward and AdaGrad."""
    rows = TEMPLATES * SLOTS
    w, t = np.zeros((rows, 3)), np.zeros((3, 3))
    t[OUT, IN] = -CLIP
    if not any((tags != OUT).any() for _, tags in windows):
        return Field(w.astype(np.float32), t, False)
    w_sum, t_sum = np.full((rows, 3), 1e-2), np.full((3, 3), 1e-2)
    longest = max(len(tags) for _, tags in windows)
    ids = np.zeros((len(windows), longest, TEMPLATES), np.int64)
    gold = np.zeros((len(windows), longest), np.int64)
    real = np.zeros((len(windows), longest), bool)
    for i, (columns, tags) in enumerate(windows):
        ids[i, :len(tags)], gold[i, :len(tags)], real[i, :len(tags)] = columns, tags, True
    order, eye = np.random.default_rng(seed), np.eye(3)
    for _ in range(rounds):
        for part in np.array_split(order.permutation(len(windows)), max(1, len(windows) // batch)):
            x, y, on = ids[part], gold[part], real[part]
            e = w[x].sum(axis=2)
            e[~on] = (0, -1e4, -1e4)  # after a window's end all is outside
            n = x.shape[1]
            alpha, beta = np.empty_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for k in range(1, n):
                alpha[:, k] = e[:, k] + _logsum(alpha[:, k - 1, :, None] + t, 1)
            for k in range(n - 2, -1, -1):
                beta[:, k] = _logsum(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            z = _logsum(alpha[:, -1], 1)
            single = np.exp(alpha + beta - z[:, None, None])
            pairs = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
            both = on[:, 1:]
            seen = np.zeros((3, 3))
            np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
            t_grad = (seen - (pairs * both[:, :, None, None]).sum(axis=(0, 1))) / len(part)
            miss = ((eye[y] - single) * on[:, :, None])[on] / len(part)
            flat = x[on]
            w_grad = np.stack([np.bincount(flat.ravel(), np.repeat(miss[:, c], TEMPLATES), rows) for c in range(3)], axis=1) - decay * w
            w_sum += w_grad ** 2
            t_sum += t_grad ** 2
            w += rate * w_grad / np.sqrt(w_sum)
            t = np.clip(t + rate * t_grad / np.sqrt(t_sum), -CLIP, CLIP)
    return Field(w.astype(np.float32), t)


def _char_to_byte(text: str, raw: bytes, places: list[int]) -> list[int]:
    return places if len(text) == len(raw) else [len(text[:p].encode()) for p in places]


def _windows(batches: Iterator[pa.RecordBatch], secrets: bool) -> Iterator[pa.RecordBatch]:
    """Training windows: kind 0 around base spans (``secrets``), or 1 around other words with digits and 2 anywhere."""
    for batch in batches:
        out, ids = [], batch.column("doc_id").to_pylist()
        for row, offsets, data in text_chunks(batch.column("text")):
            starts, ends, first = word_spans(data, offsets)
            columns = features(data, offsets, starts, ends, first)
            digits = np.concatenate([[0], np.cumsum(_CLASS[data] == 1)])
            for k in range(len(offsets) - 1):
                a, b = int(first[k]), int(first[k + 1])
                if a == b:
                    continue
                raw = data[offsets[k]:offsets[k + 1]].tobytes()
                text = raw.decode()
                tags, spans = np.zeros(b - a, np.int8), base_spans(text, raw)
                begin, finish = starts[a:b] - offsets[k], ends[a:b] - offsets[k]
                marked = []
                for start, _, end, _ in spans:
                    s, e = _char_to_byte(text, raw, [start, end])
                    p, q = int(np.searchsorted(finish, s, "right")), int(np.searchsorted(begin, e, "left"))
                    if p < q and not tags[p:q].any():
                        tags[p:q], tags[p] = IN, BEGIN
                        marked.append(p)
                seed = mix(np.array([(ids[row + k] or 0) * 31 + 7], np.int64).view(np.uint64))[0]
                other = np.flatnonzero((digits[finish + offsets[k]] > digits[begin + offsets[k]]) & (tags == 0))
                if secrets:
                    rank = mix(np.array(marked, np.uint64) ^ seed)
                    places = [(0, marked[k]) for k in np.argsort(rank, kind="stable")[:SPANS_OF_ONE]]
                else:
                    places = [(1, int(other[int(seed) % len(other)]))] if len(other) else []
                    places += [(2, int(seed >> np.uint64(20)) % (b - a))]
                for kind, p in places:
                    lo, hi = max(0, p - WIDE), min(b - a, p + WIDE + 1)
                    key = int(mix(np.array([seed ^ np.uint64(p * 3 + kind)], np.uint64)).view(np.int64)[0])
                    out.append((kind, key, columns[a + lo:a + hi].tobytes(), tags[lo:hi].tobytes()))
        cells = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int64()), pa.array(cells[2], pa.binary()), pa.array(cells[3], pa.binary())],
            ["kind", "key", "columns", "tags"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text"))


def may_hold_secrets(text: Column) -> Column:
    """False only for texts without a base span; tested in the JVM before any text goes to Python."""
    low = F.lower(text)
    return low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key") | text.contains("AKIA") | text.rlike("[0-9a-f]{24}")


def train(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> Field:
    """Fit on windows around base spans of all documents and on other windows of ``sample`` documents, ``windows`` of each kind at most."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    plain = _texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text")
    schema = "kind int, key long, columns binary, tags binary"
    marked = _texts(docs).filter(may_hold_secrets(F.col("text"))).mapInArrow(lambda batches: _windows(batches, True), schema)
    others = materialise(plain.mapInArrow(lambda batches: _windows(batches, False), schema))
    rows = []
    for found in (marked, others.filter("kind = 1"), others.filter("kind = 2")):
        rows += found.orderBy("key", "columns", "tags").limit(windows).collect()
    return fit([(np.frombuffer(r["columns"], np.int32).reshape(-1, TEMPLATES), np.frombuffer(r["tags"], np.int8).astype(np.int64)) for r in rows])


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = model.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for _, offsets, data in text_chunks(batch.column("text")):
                starts, ends, first = word_spans(data, offsets)
                tags = field.tags_of_texts(field.emissions(features(data, offsets, starts, ends, first)), first) if field.trained else np.zeros(len(starts), np.int8)
                marked = np.flatnonzero(tags != OUT)
                shown = np.searchsorted(marked, first)
                for k in range(len(offsets) - 1):
                    raw = data[offsets[k]:offsets[k + 1]].tobytes()
                    text = raw.decode()
                    spans = [(s, n, e) for s, n, e, _ in base_spans(text, raw)]
                    own = marked[shown[k]:shown[k + 1]]
                    spans += _added(own, tags[own], raw, starts[own] - offsets[k], ends[own] - offsets[k], spans)
                    out.append([{"kind": KINDS[n], "start": s, "end": e} for s, n, e in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return run


def _added(words: np.ndarray, tags: np.ndarray, raw: bytes, begin: np.ndarray, finish: np.ndarray, base: list) -> list[tuple[int, int, int]]:
    """Spans of tagged words in code points, without signs at their ends, that no base span overlaps."""
    runs: list[list[int]] = []
    for i in range(len(words)):
        if runs and tags[i] == IN and words[i - 1] == words[i] - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    out = []
    for p, q in runs:
        s, e = int(begin[p]), int(finish[q])
        e = s + len(raw[s:e].rstrip(TRIM))
        s = e - len(raw[s:e].lstrip(TRIM))
        if s < e:
            a = len(raw[:s].decode())
            b = a + len(raw[s:e].decode())
            if not any(x < b and a < y for x, _, y in base):
                out.append((a, KINDS.index("crf"), b))
    return out


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and spans (kind, start, end) in order."""
    texts = _texts(docs)
    model = docs.sparkSession.sparkContext.broadcast(field or train(docs))
    return texts.mapInArrow(_scan(model), f"doc_id long, spans {SPAN}")
