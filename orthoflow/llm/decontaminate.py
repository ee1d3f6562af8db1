"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment over words.

1. The corpus counts of the benchmark's words are taken over all documents.
2. An item's *seeds* are its word ``n``-grams whose probability under those counts (words independent) is
   below ``rare``, its ``least_seeds`` rarest ones, and the rarest one of every 13 words in a row, so each verbatim
   passage of that length holds a seed. Rarity comes from single words, so a
   passage that leaked into thousands of documents stays a seed.
3. Documents that hold a seed get aligned with the item around the seed's diagonal: local alignment,
   match +2, mismatch -1, gap -1. A pair matches when the best score reaches ``ratio`` of the item's own
   score, so edited, shortened and paraphrased copies count and chance overlaps do not; or when it reaches
   ``passage``, the score of 13 matching words, so a part of a long item counts however long the item is.

The benchmark is a query set. It is taken in blocks of about ``block_bytes`` of text (a bounded
broadcast); every block meets all documents in narrow passes without a shuffle of texts.

A-Z count as a-z; words are ``[^\\x20\\x09-\\x0D]+``. Null or blank texts and items match nothing; an item
with fewer words than ``n`` has all its words as its seed. Repeated rows are reported each; other columns
are ignored. An empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import empty_text, materialise, shingles, text_chunks, word_hashes, word_spans

GRAM = 3
RARE = 1e-9
LEAST_SEEDS = 8
RATIO = 0.4
MATCH, MISMATCH, GAP = 2, -1, 1
PASSAGE = 13 * MATCH
BLOCK_BYTES = 16 << 20
FOUND = "doc_id long, item_id long, n_seeds long, score double, start_word long, end_word long"
_SLOTS = 1 << 20


def words_of(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


class Lookup:
    """Membership of 64-bit ids: one table of bits first, then a sorted array."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.unique(ids)
        self.bits = np.zeros(_SLOTS, bool)
        self.bits[self._slot(self.ids)] = True

    @staticmethod
    def _slot(ids: np.ndarray) -> np.ndarray:
        return (ids >> np.uint64(44)).astype(np.int64)

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``ids``, index of the id in the sorted array)."""
        at = np.flatnonzero(self.bits[self._slot(ids)])
        where = np.searchsorted(self.ids, ids[at])
        where[where == len(self.ids)] = 0
        good = self.ids[where] == ids[at] if len(self.ids) else np.zeros(0, bool)
        return at[good], where[good]


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[dict[int, int], int]:
    """Counts of the words of ``vocabulary`` (hashes) over all documents, and the number of all words."""
    held = docs.sparkSession.sparkContext.broadcast(np.unique(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = Lookup(held.value), 0
        counts = np.zeros(len(lookup.ids), np.int64)
        for batch in batches:
            for _, offsets, data in text_chunks(batch.column("text")):
                starts, ends, _ = word_spans(data, offsets)
                total += len(starts)
                _, where = lookup.places(word_hashes(data, starts, ends))
                counts += np.bincount(where, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], total))], ["word", "n"])

    rows = docs.select(empty_text().alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}  # at most one row per word of this block of the benchmark
    total = found.pop(-1, 0)
    ids = np.unique(vocabulary)
    return {int(ids[k]): n for k, n in found.items()}, total


def seeds_of(words: np.ndarray, counts: dict[int, int], total: int, n: int, rare: float, least: int) -> list[tuple[int, int]]:
    """(n-gram id, place) of an item's seeds."""
    width = min(n, len(words))
    if not width:
        return []
    ids = shingles(words, width)
    logs = np.array([math.log10((counts.get(int(w), 0) + 1) / (total + 1)) for w in words])
    score = np.array([logs[k:k + width].sum() for k in range(len(ids))])
    rank = np.argsort(score, kind="stable")
    chosen = set(rank[:least].tolist()) | set(np.flatnonzero(score <= math.log10(rare)).tolist())
    reach = max(1, PASSAGE // MATCH - width + 1)
    chosen |= {k + int(score[k:k + reach].argmin()) for k in range(max(1, len(ids) - reach + 1))}
    return [(int(ids[k]), k) for k in sorted(chosen)]


def local_alignment(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score and the end (exclusive) of its passage in ``window``."""
    slope = np.arange(len(window) + 1, dtype=np.int32) * GAP
    above, best, end = np.zeros(len(window) + 1, np.int32), 0, 0
    for word in item:
        row = np.maximum(above - GAP, 0)
        np.maximum(row[1:], above[:-1] + np.where(window == word, MATCH, MISMATCH).astype(np.int32), out=row[1:])
        row = np.maximum.accumulate(row + slope) - slope  # gaps along the row
        place = int(row.argmax())
        if row[place] > best:
            best, end = int(row[place]), place
        above = row
    return best, end


def aligned(item: np.ndarray, words: np.ndarray, hits: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment near the seeds' (place in text, place in item)."""
    size, slack = len(item), max(8, len(item) // 3)
    cell = max(1, size // 2)
    best = (0, 0, 0)
    for k in sorted({(d - i) // cell for d, i in hits}):
        a, b = max(0, k * cell - slack), min(len(words), k * cell + cell + size + slack)
        score, end = local_alignment(item, words[a:b])
        if score > best[0]:
            best = (score, a, a + end)
    score, a, end = best
    if score:
        _, back = local_alignment(item[::-1], words[a:end][::-1])
        return score, end - back, end
    return best


def _search(block, n: int, ratio: float, passage: int):
    """Pairs of documents and items of a block; ``block``: items' words and their seeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seeds = block.value
        by_width: dict[int, dict[int, list]] = {}
        for item_id, found in seeds.items():
            width = min(n, len(items[item_id]))
            for seed, place in found:
                by_width.setdefault(width, {}).setdefault(seed, []).append((item_id, place))
        lookups = {w: Lookup(np.array(list(known), np.uint64)) for w, known in by_width.items()}
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_seeds", pa.int64()), ("score", pa.float64()),
                            ("start_word", pa.int64()), ("end_word", pa.int64())])
        for batch in batches:
            out, docs = [], batch.column("doc_id")
            for row, offsets, data in text_chunks(batch.column("text")):
                starts, ends, first = word_spans(data, offsets)
                words = word_hashes(data, starts, ends)
                hits: dict[tuple[int, int], list] = {}
                for width, lookup in lookups.items():
                    at, where = lookup.places(shingles(words, width))
                    doc = np.searchsorted(first, at, "right") - 1
                    for a, w, d in zip(at.tolist(), where.tolist(), doc.tolist()):
                        if a + width <= first[d + 1]:
                            for item_id, place in by_width[width][int(lookup.ids[w])]:
                                hits.setdefault((d, item_id), []).append((a - int(first[d]), place))
                for (d, item_id), found in hits.items():
                    item = items[item_id]
                    score, start, end = aligned(item, words[first[d]:first[d + 1]], found)
                    share = score / (MATCH * len(item))
                    if share >= ratio or score >= passage:
                        out.append((docs[row + d].as_py(), item_id, len(found), share, start, end))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    return run


def matches(
    docs: DataFrame, benchmark: DataFrame, n: int = GRAM, rare: float = RARE, least_seeds: int = LEAST_SEEDS, ratio: float = RATIO,
    block_bytes: int = BLOCK_BYTES, passage: int = PASSAGE,
) -> DataFrame:
    """One row per matching (document, item): n_seeds, score (share of the item's own), word span in the text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), empty_text().alias("text")).filter("item_id IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    found = []
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        words = {}
        for r in block.distinct().collect():  # about block_bytes of text
            key = r["item_id"]
            words.setdefault(key, []).append(words_of(r["text"]))
        flat = {(key, i): w for key, texts in words.items() for i, w in enumerate(texts) if len(w)}
        if not flat:
            continue
        counts, total = word_counts(docs, np.concatenate(list(flat.values())))
        named = dict(enumerate(flat.values()))
        keys = [key for key, _ in flat]
        seeds = {i: seeds_of(w, counts, total, n, rare, least_seeds) for i, w in named.items()}
        names = spark.createDataFrame(list(enumerate(keys)), "at long, item_id long")
        pairs = docs.mapInArrow(_search(spark.sparkContext.broadcast((named, seeds)), n, ratio, passage), FOUND)
        found.append(pairs.withColumnRenamed("item_id", "at").join(F.broadcast(names), "at").select(
            "doc_id", "item_id", "n_seeds", "score", "start_word", "end_word"))
    if not found:
        return spark.createDataFrame([], FOUND)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (a stored table: it is read more than once) that match no item. Rows with a null id stay."""
    hit = materialise(matches(docs, benchmark, **options).select("doc_id").distinct())
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)
