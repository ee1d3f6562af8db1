"""Reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased. Keys of at
least ``min_chars`` code points held by two or more documents lose their lines everywhere but in the
smallest doc_id that holds them. The other lines stay, joined by ``\\n``.

The index has three parts, and documents can be inserted into it and deleted from it:

* *postings*, one row per document and distinct key (128-bit BLAKE2 digest of the key),
* *counts*, per key the exact number of holding rows with the smallest and largest doc_id,
* one *cuckoo filter* per shard of the digests, holding the keys of two or more documents. Filters have a
  fixed size (``SHARDS * BUCKETS * 8`` bytes, 8 MB), so they can be broadcast at any input size. A full
  filter answers "maybe" for its shard. They only spare lookups: what passes is joined with the counts.

Counting combines before the shuffle, so a line in every document costs one row per task. The join of
passing lines has one row per key on one side and can be split on the other.

Null and empty texts are one empty line. Rows with a null id keep all lines and count for no key. Rows
that repeat a doc_id are one document. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import WHITE, empty_text, materialise

MIN_CHARS = 10
SHARDS = 64
BUCKETS = 1 << 14
SLOTS = 4
KICKS = 200


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket; once full it answers True for all."""

    def __init__(self, table: bytes | None = None, full: bool = False):
        self.table = np.frombuffer(table, np.uint16).reshape(BUCKETS, SLOTS).copy() if table else np.zeros((BUCKETS, SLOTS), np.uint16)
        self.full = full

    @staticmethod
    def _place(digest: bytes) -> tuple[int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        return mark, int.from_bytes(digest[10:14], "little") % BUCKETS

    @staticmethod
    def _other(at: int, mark: int) -> int:
        return at ^ ((mark * 0x5BD1E995) >> 7) % BUCKETS

    def add(self, digest: bytes) -> None:
        if self.full:
            return
        mark, at = self._place(digest)
        for turn in range(KICKS):
            for place in (at, self._other(at, mark)):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = mark
                    return
            slot = turn % SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = self._other(at, mark)
        self.full = True

    def remove(self, digest: bytes) -> None:
        """Only for a digest that was added."""
        mark, at = self._place(digest)
        for place in (at, self._other(at, mark)):
            held = np.flatnonzero(self.table[place] == mark)
            if len(held):
                self.table[place, held[0]] = 0
                return

    def __contains__(self, digest: bytes) -> bool:
        if self.full:
            return True
        mark, at = self._place(digest)
        return mark in self.table[at] or mark in self.table[self._other(at, mark)]

    def has(self, digests: np.ndarray) -> np.ndarray:
        """The same for rows of 16 bytes."""
        if self.full:
            return np.ones(len(digests), bool)
        marks = digests[:, 8].astype(np.int64) | digests[:, 9].astype(np.int64) << 8
        marks[marks == 0] = 1
        at = digests[:, 10:14].copy().view("<u4").ravel().astype(np.int64) % BUCKETS
        other = at ^ ((marks * 0x5BD1E995) >> 7) % BUCKETS
        return ((self.table[at] == marks[:, None]) | (self.table[other] == marks[:, None])).any(axis=1)


def shard_of(digest: bytes) -> int:
    return digest[15] % SHARDS


@dataclass
class LineIndex:
    postings: DataFrame
    counts: DataFrame
    filters: dict[int, tuple[bytes, bool]]
    min_chars: int = MIN_CHARS


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key; None if the key is too short."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _postings(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            texts = batch.column("text").cast(pa.binary())
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                own = {line_key(line, min_chars) for line in text.as_py().split(b"\n")} - {None}
                keys.extend(own)
                ids.extend([doc] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text"))


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def _shared(counts: DataFrame) -> DataFrame:
    return counts.filter("first_doc < last_doc")


def _updated(filters: dict[int, tuple[bytes, bool]], keys: DataFrame) -> dict[int, tuple[bytes, bool]]:
    """Filters after adding and removing ``keys`` (key, add), shard by shard on the executors."""
    held = keys.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, Cuckoo] = {}
        for batch in batches:
            for key, add in zip(batch.column("key").to_pylist(), batch.column("add").to_pylist()):
                shard = shard_of(key)
                own = mine.get(shard)
                if own is None:
                    own = mine[shard] = Cuckoo(*held.value.get(shard, (None, False)))
                own.add(key) if add else own.remove(key)
        for shard, own in mine.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([own.table.tobytes()], pa.binary()), pa.array([own.full])], ["shard", "bits", "full"])

    shard = F.pmod(F.conv(F.hex(F.substring("key", 16, 1)), 16, 10).cast("int"), F.lit(SHARDS))
    made = keys.withColumn("shard", shard).repartition("shard").select("key", "add").mapInArrow(run, "shard long, bits binary, full boolean")
    return {**filters, **{r["shard"]: (bytes(r["bits"]), r["full"]) for r in made.collect()}}  # SHARDS rows of a fixed size


def insert(docs: DataFrame, index: LineIndex | None = None, min_chars: int = MIN_CHARS) -> LineIndex:
    """The index with the lines of ``docs`` (doc_id, text); their ids must be new to the index."""
    min_chars = index.min_chars if index else min_chars
    fresh = materialise(_texts(docs).filter("doc_id IS NOT NULL").mapInArrow(_postings(min_chars), "key binary, doc_id long"))
    delta = _counted(fresh)
    if index is None:
        counts = materialise(delta)
        return LineIndex(fresh, counts, _updated({}, _shared(counts).select("key", F.lit(True).alias("add"))), min_chars)
    touched = materialise(delta.unionByName(index.counts.join(delta.select("key"), "key", "left_semi")).groupBy("key").agg(
        F.sum("n_rows").alias("n_rows"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc")))
    return _with(index, index.postings.unionByName(fresh), touched, touched.select("key"))


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents named in ``ids`` (doc_id)."""
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    gone = materialise(index.postings.join(ids, "doc_id", "left_semi").select("key").distinct())
    rest = materialise(index.postings.join(ids, "doc_id", "left_anti").select("key", "doc_id"))
    return _with(index, rest, materialise(_counted(rest.join(gone, "key", "left_semi"))), gone)


def _with(index: LineIndex, postings: DataFrame, touched: DataFrame, keys: DataFrame) -> LineIndex:
    """Replace the counts of ``keys`` by ``touched`` and tell the filters what became shared or ceased to be."""
    was = _shared(index.counts.join(keys, "key", "left_semi")).select("key", F.lit(True).alias("was"))
    now = _shared(touched).select("key", F.lit(True).alias("now"))
    changes = was.join(now, "key", "full").filter("was IS NULL OR now IS NULL").select("key", F.col("now").isNotNull().alias("add"))
    filters = _updated(index.filters, changes)
    counts = materialise(index.counts.join(keys, "key", "left_anti").unionByName(touched))
    return LineIndex(materialise(postings), counts, filters, index.min_chars)


def _maybe(filters, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {shard: Cuckoo(*state) for shard, state in filters.value.items()}
        for batch in batches:
            ids, keys = [], []
            texts = batch.column("text").cast(pa.binary())
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                found = {line_key(line, min_chars) for line in text.as_py().split(b"\n")} - {None}
                keys.extend(found)
                ids.extend([doc] * len(found))
            marks = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
            shards, hit = marks[:, 15] % SHARDS, np.zeros(len(keys), bool)
            for shard, cuckoo in own.items():
                at = np.flatnonzero(shards == shard)
                hit[at] = cuckoo.has(marks[at])
            chosen = np.flatnonzero(hit).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in chosen], pa.binary()), pa.array([ids[i] for i in chosen], pa.int64())], ["key", "doc_id"])

    return run


def _without(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            texts = batch.column("_text").cast(pa.binary())
            for text, drop in zip(texts, batch.column("_drop")):
                lines = text.as_py().split(b"\n")
                gone = set(drop.as_py() or ())
                stay = [line for line in lines if line_key(line, min_chars) not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("_text", "_drop")]
            names = [name for name in batch.schema.names if name not in ("_text", "_drop")]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                [*names, "n_lines", "n_dropped", "kept_text"])

    return run


def dedup_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_text under the index's counts."""
    texts = _texts(docs)
    filters = docs.sparkSession.sparkContext.broadcast(index.filters)
    maybe = texts.filter("doc_id IS NOT NULL").mapInArrow(_maybe(filters, index.min_chars), "key binary, doc_id long")
    drops = maybe.join(_shared(index.counts).select("key", "first_doc"), "key").filter("first_doc < doc_id").groupBy("doc_id").agg(
        F.collect_set("key").alias("_drop"))  # keys of one document
    return texts.withColumnRenamed("text", "_text").join(drops, "doc_id", "left").select("doc_id", "_text", "_drop").mapInArrow(
        _without(index.min_chars), "doc_id long, n_lines long, n_dropped long, kept_text string")
