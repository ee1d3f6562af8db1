"""MinHash near-duplicates with sequential Bayesian verification and exact confirmation.

Documents are linked when the Jaccard similarity of their word-shingle sets is at least
``num / den``; components of the links are numbered by their smallest doc_id.

1. *Sketch*: every text gives its shingle count, a 128-bit key of its set and a MinHash signature.
   Texts with equal sets are one *node* from here on, so exact copies cost one row.
2. *Bands*: nodes that share a band of the signature meet in a bucket. The number of bands follows from
   the threshold so that a pair at the threshold misses all bands with probability ``miss`` at most.
3. *Verification* inside a bucket: signatures are compared batch by batch; after each batch the pairs whose
   posterior probability of reaching the threshold is below ``miss`` are pruned. Survivors are decided on
   full shingle sets. Pairs that are already connected in the bucket are skipped, so a bucket yields a
   spanning forest of its links: at most one row per node, however many pairs a group has.
4. *Components*: the forests' links are contracted with star operations; they stay distributed.

Buckets with the same nodes (a group of copies shares most bands) are verified once. A bucket of more than
``tile`` shingles is dealt out by pairs of tiles, so no task holds a whole hot bucket.

Null and blank texts have no shingles, component_id = doc_id and no links; a text with fewer words than
a shingle is one shingle. Rows with a null id are linked with nothing and get a null component_id.
Rows that repeat a doc_id count as one document with the links of all of them: the different sets of one id are linked.
``one_of_each`` drops by row instead: rows of one id with different texts are judged each by its own text. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import _series, empty_text, materialise, mix, shingle_sets, unused

HASHES = 128
BAND_ROWS = 4
BATCH = 16
MISS = 1e-6
TILE = 4_000_000
BITS = 1 << 29
SEGMENTS, SEGMENT_BITS = 64, 1 << 20  # of the Bloom filter: 8 MB
SKETCH = "doc_id long, n_shingles long, _key binary, _sign binary"
_A = (_series(101, HASHES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_series(102, HASHES) >> np.uint64(32)).astype(np.uint32)


def bands_for(num: int, den: int, miss: float = MISS, rows: int = BAND_ROWS) -> int:
    """Bands needed so that a pair at the threshold shares none with probability ``miss`` at most."""
    need = math.ceil(math.log(miss) / math.log(1 - (num / den) ** rows))
    if need * rows > HASHES:
        raise ValueError(f"a similarity of {num}/{den} needs {need * rows} hashes")
    return need


def least_matches(num: int, den: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes seen, fewest matches to go on): below, P(similarity >= threshold | matches) < miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is the chance
    of at most m successes in n + 1 trials of probability t.
    """
    t, steps = num / den, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        steps.append((n, m))
    return steps


def signature(ids: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    low = (ids >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(low), 1024):
        np.minimum(best, (low[a:a + 1024, None] * _A + _B).min(axis=0), out=best)
    return best


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, signs = [], [], []
            for ids in shingle_sets(batch.column("text"), width):
                counts.append(len(ids))
                keys.append(xxhash.xxh3_128_digest(ids.tobytes()) if len(ids) else None)
                signs.append(signature(ids).tobytes() if len(ids) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())],
                ["doc_id", "n_shingles", "_key", "_sign"])

    return run


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Shingle count, set key and signature of every row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text")).mapInArrow(_sketch(width), SKETCH)


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, tuple]]]:
    """Runs of equal keys of sorted rows, as columns. Groups have a bounded number of rows here."""
    def rows():
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            for row in zip(*columns.values()):
                yield dict(zip(columns, row))

    for key, run in groupby(rows(), lambda row: tuple(row[k] for k in keys)):
        run = list(run)
        yield key, {name: tuple(row[name] for row in run) for name in run[0]}


def _passing(signs: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, num: int, den: int, steps) -> tuple:
    """Of candidate pairs, those no batch prunes, with their matches over the whole signature."""
    small, large = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    fits = small * den >= large * num  # a smaller set cannot reach the similarity
    left, right = left[fits], right[fits]
    matches = np.zeros(len(left), np.int16)
    for n, least in steps:
        if not len(left):
            break
        matches = matches + (signs[left, n - BATCH:n] == signs[right, n - BATCH:n]).sum(axis=1, dtype=np.int16)
        go = matches >= least
        left, right, matches = left[go], right[go], matches[go]
    return left, right, matches


class Sets:
    """Exact intersections of a bucket's shingle sets, as bit rows over the shingles that two or more have."""

    def __init__(self, ids: list[np.ndarray]):
        self.ids, self.bits = ids, None
        known, place, n = np.unique(np.concatenate(ids), return_inverse=True, return_counts=True)
        width = int((n > 1).sum())
        if width * len(ids) <= BITS:
            column = np.cumsum(n > 1) - 1
            row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            both = n[place] > 1
            self.bits = np.zeros((len(ids), max(1, -(-width // 64)) * 8), np.uint8)
            np.bitwise_or.at(self.bits, (row[both], column[place[both]] >> 3), np.uint8(1) << (column[place[both]] & 7).astype(np.uint8))
            self.bits = self.bits.view(np.uint64)

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[one] & self.bits[others]).sum(axis=1, dtype=np.int64)
        return np.array([len(np.intersect1d(self.ids[one], self.ids[k], assume_unique=True)) for k in others], np.int64)


def _verify(num: int, den: int, steps):
    """Per bucket (or pair of tiles): a spanning forest of the links."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), rows in _grouped(batches, ("_band", "_low", "_high")):
            nodes, tiles = np.array(rows["node"], np.int64), np.array(rows["_tile"], np.int64)
            ids = [np.frombuffer(x, np.uint64) for x in rows["_ids"]]
            sizes = np.array([len(x) for x in ids], np.int64)
            order = np.lexsort((nodes, sizes))
            nodes, tiles, sizes, ids = nodes[order], tiles[order], sizes[order], [ids[k] for k in order]
            signs = np.frombuffer(b"".join(rows["_sign"]), np.uint32).reshape(-1, HASHES)[order]
            sets, root, u, v = None, np.arange(len(nodes)), [], []
            for i in range(len(nodes)):  # rows are in order of size: partners end where sizes cannot fit
                end = int(np.searchsorted(sizes, sizes[i] * den // num, "right"))
                other = np.arange(i + 1, end)
                other = other[root[other] != root[i]]
                if low != high:
                    other = other[tiles[other] != tiles[i]]
                if not len(other):
                    continue
                _, other, _ = _passing(signs, np.full(len(other), i), other, sizes, num, den, steps)
                if not len(other):
                    continue
                sets = sets or Sets(ids)
                both = sets.common(i, other)
                for j in other[both * den >= num * (sizes[i] + sizes[other] - both)]:
                    if root[j] != root[i]:
                        root[root == root[j]] = root[i]
                        u.append(nodes[i])
                        v.append(nodes[j])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

    return run


def connected(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (u, v); label: the smallest node it reaches."""
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = materialise(
            joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # done when all are stars: every node has one label, and no label has one itself
        centres = edges.select(F.col("v").alias("u")).distinct().join(edges, "u", "left_semi")
        if centres.isEmpty() and edges.groupBy("u").count().filter("count > 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _bit_places(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, two bits in it) of every node."""
    h = mix(nodes.astype(np.int64).view(np.uint64))
    part = (h % np.uint64(SEGMENTS)).astype(np.int64)
    return part, np.stack([(h >> np.uint64(k)) % np.uint64(SEGMENT_BITS) for k in (8, 34)]).astype(np.int64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mine: dict[int, np.ndarray] = {}
    for batch in batches:
        part, bits = _bit_places(batch.column("node").to_numpy())
        for k in np.unique(part).tolist():
            mine.setdefault(k, np.zeros(SEGMENT_BITS, bool))[bits[:, part == k].ravel()] = True
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(mine), pa.int64()), pa.array([np.packbits(x).tobytes() for x in mine.values()], pa.binary())], ["part", "bits"])


def bloom(nodes: DataFrame) -> dict[int, bytes]:
    """A Bloom filter of fixed size over ``nodes`` (node), made in pieces on the executors. Full, it lets all pass."""
    made = nodes.repartition(SEGMENTS, F.pmod(F.xxhash64("node"), F.lit(SEGMENTS))).mapInArrow(_segments, "part long, bits binary")
    out: dict[int, np.ndarray] = {}
    for row in made.toLocalIterator():  # pieces of a fixed size, one after the other
        piece = np.frombuffer(row["bits"], np.uint8)
        out[row["part"]] = piece if row["part"] not in out else out[row["part"]] | piece
    return {k: v.tobytes() for k, v in out.items()}


def _set_rows(width: int, wanted):
    """Shingle sets of the texts whose node may be in the filter ``wanted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {k: np.unpackbits(np.frombuffer(v, np.uint8)).astype(bool) for k, v in wanted.value.items()}
        for batch in batches:
            part, at = _bit_places(batch.column("node").to_numpy())
            hit = np.zeros(len(part), bool)
            for k in np.unique(part).tolist():
                if k in bits:
                    own = part == k
                    hit[own] = bits[k][at[0, own]] & bits[k][at[1, own]]
            chosen = batch.take(pa.array(np.flatnonzero(hit)))
            ids = [s.tobytes() for s in shingle_sets(chosen.column("text"), width)]
            yield pa.RecordBatch.from_arrays([chosen.column("node"), pa.array(ids, pa.binary())], ["node", "_ids"])

    return run


def near_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    steps, n_bands = least_matches(num, den, miss), bands_for(num, den, miss)
    sketch = materialise(sketches(docs, width))
    full = sketch.filter("_key IS NOT NULL AND doc_id IS NOT NULL")
    # a node is a distinct set, named by the smallest doc_id that has it
    named = materialise(full.groupBy("_key").agg(F.min(F.struct("doc_id", "n_shingles", "_sign")).alias("one")).select(
        "_key", F.col("one.doc_id").alias("node"), "one.n_shingles", "one._sign"))
    signed = named.select("node", "n_shingles", "_sign")

    step = BAND_ROWS * 4
    bands = materialise(signed.select("node", "n_shingles", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(n_bands - 1)),
        lambda b: F.xxhash64(b, F.substring(F.col("_sign"), (b * step + 1).cast("int"), F.lit(step)))))).select(
        F.xxhash64("pos", "col").alias("_band"), "node", "n_shingles"))
    shared = bands.groupBy("_band").agg(
        F.count("*").alias("many"), F.sum("n_shingles").alias("_mass"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("many > 1")
    distinct = shared.groupBy("many", "x", "y").agg(F.min("_band").alias("_band"), F.max("_mass").alias("_mass"))
    members = materialise(bands.join(distinct.select("_band", "_mass"), "_band").select("_band", "node", "_mass"))
    involved = members.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), empty_text().alias("text")).filter("node IS NOT NULL")
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(involved))
    sets = texts.mapInArrow(_set_rows(width, wanted), "node long, _ids binary").join(involved, "node", "left_semi")
    known = materialise(sets.join(signed.select("node", "_sign").distinct(), "node"))

    tiles = F.ceil(F.col("_mass") / tile).cast("int")
    placed = (
        members.withColumn("_tile", F.pmod(F.xxhash64("node"), tiles).cast("int"))
        .withColumn("_with", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select("_band", F.least("_tile", "_with").alias("_low"), F.greatest("_tile", "_with").alias("_high"), "_tile", "node"))
    links = (
        placed.join(known, "node").repartition("_band", "_low", "_high").sortWithinPartitions("_band", "_low", "_high")
        .mapInArrow(_verify(num, den, steps), "u long, v long"))
    # the sets of one id are one document: their nodes are linked
    several = full.groupBy("doc_id").agg(F.min("_key").alias("low"), F.max("_key").alias("high")).filter("low <> high").select("doc_id")
    owned = full.select("doc_id", "_key").join(several, "doc_id", "left_semi").join(named.select("_key", "node"), "_key")
    same = owned.groupBy("doc_id").agg(F.min("node").alias("u")).join(owned.select("doc_id", F.col("node").alias("v")), "doc_id").select("u", "v").filter("u <> v")
    label = materialise(connected(links.unionByName(same)))
    component = named.select("_key", "node").join(label, "node", "left").select("_key", "node", F.coalesce("label", "node").alias("label"))
    rows = sketch.join(component, "_key", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return rows.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(found == F.col("doc_id"), F.lit(True)).alias("kept"))


def _told_apart(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, _own) of the rows whose id repeats with different texts; ``_text`` is a digest.

    Only these get new ids, above all others; equal rows share one.
    """
    text = F.md5(empty_text().cast("binary"))
    hashed = docs.select("doc_id", text.alias("_text"))
    several = hashed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("_text").alias("low"), F.max("_text").alias("high")).filter("low <> high")
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("long").alias("top"))
    texts = hashed.join(several.select("doc_id"), "doc_id", "left_semi").distinct()
    return materialise(texts.crossJoin(F.broadcast(top)).select("doc_id", "_text", (F.col("top") + 1 + F.monotonically_increasing_id()).alias("_own")))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` (a stored table: it is read more than once) whose document is the smallest of its component.

    Rows of one id with different texts are documents of their own here, so no text goes of which no near copy stays.
    """
    new = _told_apart(docs)
    if new.isEmpty():
        gone = near_components(docs.select("doc_id", "text"), width, num, den).filter("NOT kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    text, own = unused(docs, "_text"), unused(docs, "_own")
    keyed = docs.withColumn(text, F.md5(empty_text().cast("binary"))).join(
        new.select("doc_id", F.col("_text").alias(text), F.col("_own").alias(own)), ["doc_id", text], "left").withColumn(own, F.coalesce(own, F.col("doc_id").cast("long")))
    gone = near_components(keyed.select(F.col(own).alias("doc_id"), "text"), width, num, den).filter("NOT kept").select(F.col("doc_id").alias(own)).distinct()
    return keyed.join(gone, own, "left_anti").select(docs.columns)
