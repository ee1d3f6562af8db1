"""Edit-aware token counts: a segment tree of pre-token blocks for every document.

The byte-level vocabulary splits a text by a pattern before any merge. Between a sign that is no white space
and a blank the pattern always splits, and what follows is split the same whatever stands before. Leaves of
the tree are runs of about ``LEAF`` such pieces; inner nodes hold sums of characters and of tokens.

An edit replaces a range of characters. The tree finds the touched leaves by their character sums; the
new text of these leaves is encoded again, together with a neighbour where the edit changed what stands
at the border (boundary context), and the sums on the way to the root are set anew. All other leaves keep
their counts. The result equals encoding the edited text from scratch.

Trees travel as two arrays (characters and tokens per leaf) beside the text, so they can be stored and
edited later. A document's edits are one array, applied in order, each to the text the one before left;
ranges beyond the text are cut to it; null edits, or fields, change nothing (a null insert is empty).

Null texts count as empty and have no tokens. Repeated rows are counted each; null ids stay. No rows give
no rows. Other columns pass through ``apply_edits`` and ``build_trees`` untouched.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import empty_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32
CACHE = 200_000
LONG_PIECE = 256
EDIT = "array<struct<start:long,stop:long,insert:string>>"
TREE = ("leaf_chars", "leaf_tokens", "n_tokens")
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def encoder(path: str = VOCABULARY) -> tiktoken.Encoding:
    if path not in _ENCODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def counter(path: str = VOCABULARY) -> Callable[[str], int]:
    """Tokens of a piece; short pieces are remembered, up to ``CACHE`` of them."""
    encode, known = encoder(path).encode_ordinary, {}

    def count(piece: str) -> int:
        n = known.get(piece)
        if n is None:
            n = len(encode(piece))
            if len(piece) <= LONG_PIECE:
                if len(known) >= CACHE:
                    known.clear()
                known[piece] = n
        return n

    return count


def pieces(text: str) -> list[str]:
    """Cut before every blank that follows a sign other than white space."""
    parts = text.split(" ")
    out, last = [], parts[0]
    for part in parts[1:]:
        if last and not last[-1].isspace():
            out.append(last)
            last = " " + part
        else:
            last = f"{last} {part}"
    if last:
        out.append(last)
    return out


class CountTree:
    def __init__(self, texts: list[str], tokens: list[int], count: Callable[[str], int]):
        self.texts, self.count = texts, count
        self.base = 1
        while self.base < max(1, len(texts)):
            self.base *= 2
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, (text, n) in enumerate(zip(texts, tokens)):
            self.chars[self.base + i], self.tokens[self.base + i] = len(text), n
        for node in range(self.base - 1, 0, -1):
            self._sum(node)
        self.encoded = 0

    @classmethod
    def of(cls, text: str, count: Callable[[str], int]) -> CountTree:
        parts = pieces(text)
        texts = ["".join(parts[k:k + LEAF]) for k in range(0, len(parts), LEAF)] or [""]
        tokens = [sum(map(count, parts[k:k + LEAF])) for k in range(0, len(parts), LEAF)] or [0]
        return cls(texts, tokens, count)

    @classmethod
    def stored(cls, text: str, chars: list[int], tokens: list[int], count: Callable[[str], int]) -> CountTree:
        texts, at = [], 0
        for n in chars:
            texts.append(text[at:at + n])
            at += n
        return cls(texts, tokens, count)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node = self.base + leaf
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self._sum(node)

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, place in it) of a character; the end of the text is in the last leaf with characters."""
        if at >= self.chars[1]:
            leaf = max((i for i, text in enumerate(self.texts) if text), default=0)
            return leaf, len(self.texts[leaf])
        node = 1
        while node < self.base:
            node *= 2
            if at >= self.chars[node]:
                at -= self.chars[node]
                node += 1
        return node - self.base, at

    def edit(self, start: int, stop: int, insert: str) -> None:
        start = min(max(start, 0), self.chars[1])
        stop = min(max(stop, start), self.chars[1])
        first, a = self.find(start)
        last, b = self.find(stop - 1) if stop > start else (first, a - 1)
        text = self.texts[first][:a] + insert + self.texts[last][b + 1:]
        before, after = self._beside(first, -1), self._beside(last, 1)
        while True:  # context: a border must have a blank after a sign that is no white space
            if before is not None and (not text or text[0] != " " or self.texts[before][-1].isspace()):
                text, first = self.texts[before] + text, before
                before = self._beside(first, -1)
            elif after is not None and (not text or text[-1].isspace() or self.texts[after][0] != " "):
                text, last = text + self.texts[after], after
                after = self._beside(last, 1)
            else:
                break
        self.encoded += len(text)
        self._set(first, text, sum(map(self.count, pieces(text))))
        for leaf in range(first + 1, last + 1):
            self._set(leaf, "", 0)

    def _beside(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < len(self.texts):
            if self.texts[leaf]:
                return leaf
            leaf += step
        return None

    def arrays(self) -> tuple[list[int], list[int], int]:
        n = len(self.texts)
        return self.chars[self.base:self.base + n], self.tokens[self.base:self.base + n], self.tokens[1]


def _schema(frame: DataFrame, **more: str):
    for name, kind in more.items():
        frame = frame.withColumn(name, F.lit(None).cast(kind))
    return frame.schema


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, array in columns.items():
        if name in names:
            arrays[names.index(name)] = array
        else:
            names.append(name)
            arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, names)


def _trees(found: list[tuple]) -> dict[str, pa.Array]:
    kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
    return {name: pa.array([f[k] for f in found], kind) for k, (name, kind) in enumerate(zip(TREE, kinds))}


def build_trees(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``docs`` with leaf_chars, leaf_tokens and n_tokens of every text."""
    docs = docs.withColumn("text", empty_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            yield _with(batch, _trees([CountTree.of(t, count).arrays() for t in batch.column("text").to_pylist()]))

    return docs.mapInArrow(run, _schema(docs, leaf_chars="array<int>", leaf_tokens="array<int>", n_tokens="long"))


def apply_edits(trees: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``trees`` after their ``edits`` (array of start, stop, insert), with the characters encoded again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts, found, encoded = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits")))
            for text, chars, tokens, edits in rows:
                tree = CountTree.stored(text, chars, tokens, count)
                for edit in edits or ():
                    if edit is not None and edit["start"] is not None and edit["stop"] is not None:
                        tree.edit(edit["start"], edit["stop"], edit["insert"] or "")
                texts.append("".join(tree.texts))
                found.append(tree.arrays())
                encoded.append(tree.encoded)
            yield _with(batch, {"text": pa.array(texts, pa.string()), **_trees(found), "n_encoded": pa.array(encoded, pa.int64())})

    return trees.mapInArrow(run, _schema(trees, n_encoded="long"))


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with the rows of ``edits`` (doc_id, seq, start, stop, insert) as arrays in order of seq."""
    one = F.struct("seq", F.struct("start", "stop", "insert").alias("edit"))
    listed = edits.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: e["edit"]).cast(EDIT).alias("edits"))
    return trees.drop("edits").join(listed, "doc_id", "left")
