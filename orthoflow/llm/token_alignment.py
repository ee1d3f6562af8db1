"""Alignment of two tokenizers: the smallest groups of tokens that cover the same bytes, and token links.

A is a byte-level BPE of the ``tokenizers`` library and sees space + text; B is a ``sentencepiece`` model, which adds the
space itself. Both sides' tokens are byte strings that join to the same bytes, so every token has an end offset.
An offset where a token of each side ends is a cut; cuts part the tokens into groups.

Cuts are found by divide and conquer. A document is an interval that ends in a cut. From the middle of an
interval's A tokens the nearest end that is also an end of B is located, by bisection among B's ends, within rings
around the middle that grow fourfold. It splits the interval in two halves, treated alike; an interval without a
cut inside is a leaf: a group. All intervals of a chunk of documents are halved in step, so numpy does the work.

Tokens that end together are linked; each cut gives one link, as no token is empty. How often a pair of ids is
linked is counted over the whole corpus. Of two linked tokens one is a suffix of the other, so the pairs that can occur are
listed from the two vocabularies alone (at most one per byte of all tokens, and one more per byte piece): the counts are
an array of fixed size, whatever the corpus. It is what the driver gets and what is broadcast.

Texts are cut into segments where both tokenizers part them anyway, and a worker tokenises each segment it
meets once (:class:`Segments`); the ids are those of the whole text, which tests compare.

The tokenised documents are written once to the shared folder with their links as pair numbers (4 bytes a
link); counting and scoring read that table, so texts are tokenised once and lost executors cost no more
than their tasks.

A null or empty text, or one whose joined tokens differ from space + text on either side, has no tokens: zeros and
an empty digest. Repeated rows and null ids count as documents each. No rows give no rows. A text is
tokenised whole, whatever its length. Other columns are ignored. The vocabulary files are parameters; every
executor must have them at that path.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import materialise

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_CHARS = 1 << 20
#: Between a sign that is no white space and a blank.
CUT = re.compile(r"(?<=\S)(?= )")
#: Beyond these the remembered segments of a worker are forgotten.
KNOWN_SEGMENTS = 600_000
KNOWN_IDS = 6_000_000
COUNTS = ("n_a", "n_b", "n_groups")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Side:
    """Bytes and lengths by token id."""

    tokens: list[bytes]

    def __post_init__(self):
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def join(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class Pairs:
    """Numbers of all pairs of ids of which one token is a suffix of the other."""

    def __init__(self, a: Side, b: Side):
        by_bytes: list[dict[bytes, list[int]]] = []
        for side in (a, b):
            known: dict[bytes, list[int]] = {}
            for i, token in enumerate(side.tokens):
                if token:
                    known.setdefault(token, []).append(i)
            by_bytes.append(known)
        keys = set()
        for i, token in enumerate(a.tokens):
            for k in range(len(token)):
                for j in by_bytes[1].get(token[k:], ()):
                    keys.add(i * len(b.tokens) + j)
        for j, token in enumerate(b.tokens):
            for k in range(1, len(token)):
                for i in by_bytes[0].get(token[k:], ()):
                    keys.add(i * len(b.tokens) + j)
        self.keys = np.array(sorted(keys), np.int64)
        self.b_ids = self.keys % max(1, len(b.tokens))
        self.n_b = len(b.tokens)
        # An open-addressed table: a pair's number lies in the first slot from its hash on that holds its key.
        self.bits = max(4, (4 * len(self.keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        pending, step = np.arange(len(self.keys), dtype=np.int32), 0
        while len(pending):
            at = self._slot(self.keys[pending], step)
            free = self.slots[at] < 0
            self.slots[at[free]] = pending[free]
            pending, step = pending[self.slots[at] != pending], step + 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def number(self, a_ids: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
        """Numbers of pairs that are listed."""
        keys = a_ids * self.n_b + b_ids
        out = self.slots[self._slot(keys, 0)]
        open_, step = np.flatnonzero(self.keys[out] != keys), 1
        while len(open_):
            out[open_] = self.slots[self._slot(keys[open_], step)]
            open_, step = open_[self.keys[out[open_]] != keys[open_]], step + 1
        return out


class Segments:
    """Token ids of text segments met before, as one array a side with the segments' places in it.

    Both tokenizers always part a text between a sign that is no white space and a blank, and what follows is
    tokenised alike whatever stands before; so segments cut there are tokenised once and looked up again.
    """

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.places = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.whole = np.zeros(0, bool)

    def add(self, segments: list[str], sides: tuple[list[list[int]], list[list[int]]], whole: list[bool]) -> None:
        first = len(self.numbers)
        self.numbers.update(zip(segments, range(first, first + len(segments))))
        self.whole = np.concatenate([self.whole, np.array(whole, bool)])
        for k, ids in enumerate(sides):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.ids[k] = np.concatenate([self.ids[k], np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))])
            self.places[k] = np.concatenate([self.places[k], self.places[k][-1] + np.cumsum(sizes)])

    def gather(self, k: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments one after the other, and the number of ids of each."""
        starts, stops = self.places[k][found], self.places[k][found + 1]
        return self.ids[k][_flat(starts, stops)[0]], stops - starts


class Vocabularies:
    """Both tokenizers of one worker process."""

    _loaded: dict[tuple[str, str], Vocabularies] = {}

    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a_model = Tokenizer.from_file(a_file)
        self.a_model.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a_model.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.a = Side(tokens)
        self.b_model = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [(i, self.b_model.id_to_piece(i)) for i in range(self.b_model.get_piece_size())]
        self.b = Side([bytes([int(p[3:5], 16)]) if self.b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces])
        shape = json.loads(self.a_model.to_str())
        splits = shape["pre_tokenizer"] or {}
        #: Whether both sides part texts at the places segments are cut at; else a text is one segment.
        self.cuts = (
            shape["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex", False)
            and not any("▁" in p.lstrip("▁") for _, p in pieces) and "".join(self.b_model.encode("a  b ", out_type=str)) == "▁a▁▁b▁")
        self.segments = Segments()
        self._pairs: Pairs | None = None

    @classmethod
    def load(cls, a_file: str = A_FILE, b_file: str = B_FILE) -> Vocabularies:
        if (a_file, b_file) not in cls._loaded:
            cls._loaded[a_file, b_file] = cls(a_file, b_file)
        return cls._loaded[a_file, b_file]

    @property
    def pairs(self) -> Pairs:
        if self._pairs is None:
            self._pairs = Pairs(self.a, self.b)
        return self._pairs

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that start with a blank, on both sides."""
        a = [e.ids for e in self.a_model.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b_model.encode([t[1:] for t in texts], num_threads=1)
        # A lone blank is the end of a text, where B has a piece for it; by itself B sees nothing.
        return a, [[self.b_model.piece_to_id("▁")] if t == " " else x for t, x in zip(texts, b)]

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(ids one text after the other and the number of ids of each text) for A and B, and whether each text's tokens join to it."""
        cut = [CUT.split(t) if self.cuts else [t] for t in (f" {t}" for t in texts)]
        if len(self.segments.numbers) > KNOWN_SEGMENTS or len(self.segments.ids[0]) > KNOWN_IDS:
            self.segments = Segments()
        known = self.segments.numbers
        fresh = list(dict.fromkeys(s for parts in cut for s in parts if s not in known))
        if fresh:
            sides = self.encode(fresh)
            whole = [self.a.join(a) == s.encode() == self.b.join(b) for s, a, b in zip(fresh, *sides)]
            self.segments.add(fresh, sides, whole)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        found = np.fromiter((known[s] for parts in cut for s in parts), np.int64, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        ids, counts = [], []
        for k in (0, 1):
            flat, each = self.segments.gather(k, found)
            ids.append(flat)
            counts.append(np.add.reduceat(each, first))
        whole = np.logical_and.reduceat(self.segments.whole[found], first)
        for k in np.flatnonzero(~whole):
            # Segments that differ may still join to the text, so the text itself decides.
            wanted = f" {texts[k]}".encode()
            stops = [int(c[:k + 1].sum()) for c in counts]
            whole[k] = all(side.join(x[stop - c[k]:stop]) == wanted for side, x, c, stop in zip((self.a, self.b), ids, counts, stops))
        return ids, counts, whole


def _flat(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges one after the other, and the number of each one's range."""
    sizes = np.maximum(stops - starts, 0)
    owner = np.repeat(np.arange(len(starts)), sizes)
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - first[owner] + starts[owner], owner


def nearest_cuts(a_ends: np.ndarray, b_ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Per interval of A tokens [lo, hi): the one nearest to the middle whose end is an end of B, -1 if none is."""
    middle = (lo + hi) // 2
    found = np.full(len(lo), -1, np.int64)
    open_ = np.arange(len(lo))
    inner, outer = 0, 1
    while len(open_):
        at, left, right = middle[open_], lo[open_], hi[open_]
        below, owner_below = _flat(np.maximum(left, at - outer + 1), at - max(inner, 1) + 1)
        above, owner_above = _flat(at + inner, np.minimum(right, at + outer))
        place, owner = np.concatenate([below, above]), np.concatenate([owner_below, owner_above])
        ends = a_ends[place]
        bisected = np.searchsorted(b_ends, ends)
        shared = b_ends[np.minimum(bisected, len(b_ends) - 1)] == ends
        place, owner = place[shared], owner[shared]
        order = np.lexsort((place, np.abs(place - at[owner]), owner))
        owner, first = np.unique(owner[order], return_index=True)
        found[open_[owner]] = place[order][first]
        done = (at - outer < left) & (at + outer >= right)
        done[owner] = True
        open_ = open_[~done]
        inner, outer = outer, outer * 4
    return found


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Sorted A tokens whose ends are cuts; ``firsts`` and ``lasts`` are the documents' first and last A tokens."""
    cuts = [lasts]
    lo, hi = firsts, lasts
    while True:
        inside = lo < hi
        lo, hi = lo[inside], hi[inside]
        if not len(lo):
            return np.sort(np.concatenate(cuts))
        cut = nearest_cuts(a_ends, b_ends, lo, hi)
        split = cut >= 0
        cut = cut[split]
        cuts.append(cut)
        lo, hi = np.concatenate([lo[split], cut + 1]), np.concatenate([cut, hi[split]])


def shown(ids: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each followed by its sign, as rows of bytes, and which bytes count."""
    width = len(str(int(ids.max())))
    powers = 10 ** np.arange(width - 1, -1, -1)
    digits = (ids[:, None] // powers % 10 + ord("0")).astype(np.uint8)
    used = ids[:, None] >= powers
    used[:, -1] = True
    return np.hstack([digits, sign[:, None]]), np.hstack([used, np.ones((len(ids), 1), bool)])


def align(vocabularies: Vocabularies, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, bytes]]:
    """Per text (A tokens, B tokens, groups, digest of the groups, pair numbers of the links as int32)."""
    given = [k for k, t in enumerate(texts) if t]
    ids, counts, whole = vocabularies.tokens([texts[k] for k in given]) if given else ([], [], np.zeros(0, bool))
    if not whole.any():
        yield from [(0, 0, 0, "", b"")] * len(texts)
        return
    a_ids, b_ids = (x[np.repeat(whole, c)] for x, c in zip(ids, counts))
    n_a, n_b = (c[whole] for c in counts)
    a_stops, b_stops = np.cumsum(n_a), np.cumsum(n_b)
    a_ends, b_ends = np.cumsum(vocabularies.a.lengths[a_ids]), np.cumsum(vocabularies.b.lengths[b_ids])
    cuts = shared_cuts(a_ends, b_ends, a_stops - n_a, a_stops - 1)
    partners = np.searchsorted(b_ends, a_ends[cuts])
    links = vocabularies.pairs.number(a_ids[cuts], b_ids[partners])
    # Each group is its A tokens, then its B tokens: a token's place in that order is its own number plus the other side's before it.
    signs = [np.full(len(x), ord(","), np.uint8) for x in (a_ids, b_ids)]
    signs[0][cuts], signs[1][partners] = ord("|"), ord(";")
    groups_before = [np.cumsum(s != ord(",")) - (s != ord(",")) for s in signs]
    a_place = np.arange(len(a_ids)) + np.concatenate([[0], partners + 1])[groups_before[0]]
    b_place = np.arange(len(b_ids)) + (cuts + 1)[groups_before[1]]
    both, sign = np.empty(len(a_ids) + len(b_ids), np.int64), np.empty(len(a_ids) + len(b_ids), np.uint8)
    both[a_place], both[b_place] = a_ids, b_ids
    sign[a_place], sign[b_place] = signs
    letters, used = shown(both, sign)
    text = letters[used].tobytes()
    stops = np.cumsum(used.sum(axis=1))[a_stops + b_stops - 1].tolist()
    group_stops = (np.searchsorted(cuts, a_stops - 1) + 1).tolist()
    kept = dict(zip([given[k] for k in np.flatnonzero(whole)], zip(n_a.tolist(), n_b.tolist(), stops, group_stops)))
    at = at_link = 0
    for k in range(len(texts)):
        if k not in kept:
            yield 0, 0, 0, "", b""
            continue
        a, b, stop, link_stop = kept[k]
        yield a, b, link_stop - at_link, hashlib.sha256(text[at:stop - 1]).hexdigest(), links[at_link:link_stop].tobytes()
        at, at_link = stop, link_stop


def _text_chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_CHARS:
            yield texts[start:k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield texts[start:]


def tokenised(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links) of every document; ``links`` holds pair numbers as int32."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ids = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = Vocabularies.load(a_file, b_file)
        for batch in batches:
            at = 0
            for texts in _text_chunks(batch.column("text").to_pylist()):
                n_a, n_b, groups, digests, links = zip(*align(vocabularies, texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), *[pa.array(x, pa.int64()) for x in (n_a, n_b, groups)], pa.array(digests), pa.array(links, pa.binary())],
                    ["doc_id", *COUNTS, "groups_sha256", "links"])
                at += len(texts)

    return rows.mapInArrow(run, f"doc_id {ids}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def _numbers(links: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in links.to_pylist()]


def pair_counts(written: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> np.ndarray:
    """How many links of the corpus hold each pair; as long as the list of possible pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(Vocabularies.load(a_file, b_file).pairs.keys)
        total = np.zeros(size, np.int64)
        for batch in batches:
            numbers = _numbers(batch.column("links"))
            total += np.bincount(np.concatenate(numbers), minlength=size) if numbers else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["pair", "n"])

    counts = np.zeros(len(Vocabularies.load(a_file, b_file).pairs.keys), np.int64)
    table = written.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return counts


def alignment(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    written = materialise(tokenised(docs, a_file, b_file))
    counts = docs.sparkSession.sparkContext.broadcast(pair_counts(written, a_file, b_file))
    ids = written.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = Vocabularies.load(a_file, b_file).pairs, counts.value
        highest = np.zeros(pairs.n_b, np.int64)
        np.maximum.at(highest, pairs.b_ids, n)
        best = n == highest[pairs.b_ids]
        for batch in batches:
            numbers = _numbers(batch.column("links"))
            extra = [[len(x) for x in numbers], [int(best[x].sum()) for x in numbers], [int(n[x].sum()) for x in numbers]]
            names = ["doc_id", *COUNTS]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *[pa.array(x, pa.int64()) for x in extra], batch.column("groups_sha256")],
                [*names, "n_links", "n_best", "count_sum", "groups_sha256"])

    return written.mapInArrow(run, f"doc_id {ids}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
