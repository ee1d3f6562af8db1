"""Product codes of vectors: integer codebooks, nearest entries by Orchard's search.

Components become integers, ``floor(4096 * x)``. A vector is cut into equal parts; each part has a codebook
of a few entries, which starts as that part of the vectors with the smallest ids. Each round assigns every
part to its nearest entry (ties to the lower index) and moves each used entry to the floor of its mean.

The nearest entry is found by Orchard's search. Each entry keeps the other entries sorted by their distance
to it. A search stands at an entry, walks that entry's list, and jumps to the list of the first one that is
nearer to the point. Entries already measured are marked and passed over. The walk ends where the listed
distance exceeds twice the distance to the point: by the triangle inequality nothing beyond is as near.
A batch of points walks in step; all distances are exact integers.

The codebooks are fitted on all kept rows. A task sends one row per used component of an entry, added up by
Spark; the driver holds the entries alone (parts x entries x width numbers). The integer vectors are written
once to the shared folder, so a round reads compact rows and survives lost executors.

Rows with a null vector, or one with a null or non-finite component, are dropped. Repeated rows, ids with two
vectors and null ids count as rows each; the first entries order equal ids by their packed vectors, null ids last.
Vectors shorter than the longest one, or than a multiple of the parts, are filled up with zeros. Fewer rows
than entries give fewer entries. No rows give no rows. Components too large for 64-bit arithmetic are
computed with unbounded integers; errors above 2^63 - 1 count as that. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import materialise
from orthoflow.llm.groups import group_key, with_group

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components up to this size keep squared distances inside 64 bits; beyond, Python integers are used.
PLAIN = 1 << 24
LARGEST = (1 << 63) - 1
LIMB = 40
BATCH_BYTES = 4 << 20


@dataclass
class Codebooks:
    """Per part an array of entries (entries x components), and the padded length of a vector."""

    parts: list[np.ndarray]
    width: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for part in self.parts for x in part.ravel()).encode()).hexdigest()


def pack(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Kept rows as (id, label, body): the integer components as little-endian doubles, or floats for float vectors.

    The floor of a float is a float, so both hold the integers exactly.
    """
    narrow = "float" in vectors.schema[vector].dataType.simpleString()
    kind = "<f4" if narrow else "<f8"
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    labels = rows.schema["label"].dataType.simpleString()
    ids = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            whole = pc.is_valid(lists)
            flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
            bad = pc.invert(pc.fill_null(pc.is_finite(flat), False))
            keep = whole.to_numpy(zero_copy_only=False).copy()
            keep[parents.to_numpy(zero_copy_only=False)[bad.to_numpy(zero_copy_only=False)]] = False
            kept = batch.filter(pa.array(keep))
            lists = kept.column("v")
            with np.errstate(over="ignore"):
                flat = np.floor(pc.list_flatten(lists).to_numpy(zero_copy_only=False) * SCALE)
            # A product beyond the largest double is exact as a Python integer, yet no double: the largest stands for it.
            body = np.clip(flat, -np.finfo("f8").max, np.finfo("f8").max)
            body = body.astype(kind) if not narrow or np.all(np.abs(body) <= np.finfo("f4").max) else body
            size = body.dtype.itemsize
            lengths = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            offsets = pa.array((lengths * size).astype(np.int32))
            bodies = pa.Array.from_buffers(pa.binary(), kept.num_rows, [None, offsets.buffers()[1], pa.py_buffer(body.tobytes())])
            sizes = pa.array(np.full(kept.num_rows, size, np.int32))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("label"), bodies, sizes], ["id", "label", "body", "size"])

    return rows.mapInArrow(run, f"id {ids}, label {labels}, body binary, size int")


def _matrix(bodies: list[bytes], sizes: list[int], width: int) -> np.ndarray:
    """Packed vectors as integers, one row each, filled up with zeros; Python integers where 64 bits may not do."""
    out = np.zeros((len(bodies), width))
    if bodies and min(sizes) == max(sizes) and all(len(b) == width * sizes[0] for b in bodies):
        out = np.frombuffer(b"".join(bodies), f"<f{sizes[0]}").reshape(len(bodies), width)
    else:
        for row, (body, size) in enumerate(zip(bodies, sizes)):
            values = np.frombuffer(body, f"<f{size}")
            out[row, :len(values)] = values
    if not out.size or np.abs(out).max() < PLAIN:
        return out.astype(np.int64)
    exact = np.empty(out.shape, object)
    exact[...] = [[int(x) for x in row] for row in out]
    return exact


def orchard(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of every point; ties go to the lower index."""
    n, k = len(points), len(entries)
    gap = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    lists = np.array([[e for e in sorted(range(k), key=lambda e: (gap[c, e], e)) if e != c] for c in range(k)], np.int64).reshape(k, k - 1)
    listed = np.take_along_axis(gap, lists, axis=1)
    at = np.zeros(n, np.int64)
    place = np.zeros(n, np.int64)
    best = ((points - entries[0]) ** 2).sum(axis=1)
    marked = np.zeros((n, k), bool)
    marked[:, 0] = True
    walking = np.arange(n if k > 1 else 0)
    while len(walking):
        here, step = at[walking], place[walking]
        walking = walking[(listed[here, step] <= 4 * best[walking]).astype(bool)]
        if not len(walking):
            break
        entry = lists[at[walking], place[walking]]
        place[walking] += 1
        fresh = ~marked[walking, entry]
        who, entry = walking[fresh], entry[fresh]
        marked[who, entry] = True
        distance = ((points[who] - entries[entry]) ** 2).sum(axis=1)
        nearer = ((distance < best[who]) | ((distance == best[who]) & (entry < at[who]))).astype(bool)
        jump = who[nearer]
        at[jump], best[jump], place[jump] = entry[nearer], distance[nearer], 0
        walking = walking[place[walking] < k - 1]
    return at, best


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, BATCH_BYTES // max(1, 8 * width))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, _matrix(part.column("body").to_pylist(), part.column("size").to_pylist(), width)


def _limbs(value: int) -> Iterator[int]:
    """Digits of a whole number in base 2^40, the last one signed; sums of digits stay far inside 64 bits."""
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield value & ((1 << LIMB) - 1)
        value >>= LIMB
    yield value


def _round(packed: DataFrame, books: Codebooks) -> Codebooks:
    """Assign every part, move every used entry to the floor of its mean."""
    width, share = books.width, books.width // len(books.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = {}, {}
        for _, matrix in _chunks(batches, width):
            for p, entries in enumerate(books.parts):
                points = matrix[:, p * share:(p + 1) * share]
                code, _ = orchard(points, entries)
                for e in np.unique(code):
                    mine = points[code == e]
                    sums[p, e] = sums.get((p, e), 0) + mine.sum(axis=0).astype(object)
                    counts[p, e] = counts.get((p, e), 0) + len(mine)
        rows = [(p, int(e), -1, 0, counts[p, e]) for p, e in sums]
        rows += [(p, int(e), i, limb, digit) for (p, e), total in sums.items() for i, x in enumerate(total) for limb, digit in enumerate(_limbs(int(x)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * 5, [pa.int32()] * 4 + [pa.int64()])],
            ["part", "entry", "place", "limb", "value"])

    moved = packed.select("body", "size").mapInArrow(run, "part int, entry int, place int, limb int, value long")
    totals: dict[tuple[int, int], dict[int, int]] = {}
    for r in moved.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect():
        entry = totals.setdefault((r["part"], r["entry"]), {})
        entry[r["place"]] = entry.get(r["place"], 0) + (r["value"] << (LIMB * r["limb"]))
    parts = [[list(row) for row in part] for part in books.parts]
    for (p, e), total in totals.items():
        parts[p][e] = [total[i] // total[-1] for i in range(share)]
    return Codebooks([_entries(part, share) for part in parts], width)


def _entries(rows: list[list[int]], share: int) -> np.ndarray:
    rows = [[int(x) for x in row] for row in rows]
    plain = all(abs(x) < PLAIN for row in rows for x in row)
    out = np.empty((len(rows), share), np.int64 if plain else object)
    if rows:
        out[...] = rows
    return out


def fit(packed: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of a written table of packed vectors."""
    longest = packed.agg(F.max(F.length("body") / F.col("size"))).first()[0] or 0
    width = -(-int(longest) // parts) * parts
    share = width // parts
    first = packed.orderBy(F.col("id").asc_nulls_last(), "body").limit(entries).collect()
    matrix = _matrix([bytes(r["body"]) for r in first], [r["size"] for r in first], width)
    books = Codebooks([_entries([list(row) for row in matrix[:, p * share:(p + 1) * share]], share) for p in range(parts)], width)
    for _ in range(rounds if first and width else 0):
        books = _round(packed, books)
    return books


def encode(packed: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error): two hex digits per part, and the squared distances summed over the parts."""
    width, share = books.width, books.width // len(books.parts)
    ids, labels = packed.schema["id"].dataType.simpleString(), packed.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{e:02x}" for e in range(256)], object)
        for part, matrix in _chunks(batches, width):
            code, error = np.full(part.num_rows, "", object), np.zeros(part.num_rows, matrix.dtype)
            for p, entries in enumerate(books.parts):
                at, distance = orchard(matrix[:, p * share:(p + 1) * share], entries)
                code, error = code + digits[at], error + distance
            error = [min(int(x), LARGEST) for x in error]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return packed.mapInArrow(run, f"id {ids}, label {labels}, code string, error long")


def vector_codes(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row: id, code, error, label_error (error summed over the label's rows) and codebooks_sha256.

    At most 256 entries, as a code has two hex digits a part.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    packed = materialise(pack(vectors, id_column, vector, label))
    books = fit(packed, parts, entries, rounds)
    codes = materialise(encode(packed, books).withColumn("key", group_key("label")))
    largest = F.lit(LARGEST).cast("decimal(38,0)")
    labels = materialise(codes.groupBy("key").agg(
        F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), largest).cast("long").alias("label_error"), F.count("*").alias("n")))
    return with_group(codes, labels, "key", "n", F.xxhash64("id", "code")).select(
        F.col("id").alias(id_column), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
