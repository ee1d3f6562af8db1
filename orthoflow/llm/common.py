"""Helpers shared by the corpus operators: shared-folder tables, byte-level words, hashing.

Texts are handled as UTF-8 bytes. ``bytes.split()`` cuts exactly at ``[\\x20\\x09-\\x0D]`` and
``bytes.lower()`` changes exactly A-Z, which is what the operators' contracts ask for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.session import CHECKPOINT_SETTING, ensure_checkpoint_dir

WHITE = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 1 << 20
_U64 = np.uint64


def read_table(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{folder}/{table}.parquet")
    return frame.select(*columns) if columns else frame


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one all executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialise(frame: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, prunes columns.

    The shuffle files of the plan just written are not needed again; Spark removes them once the driver's
    JVM has collected the plan, so it is asked to.
    """
    spark = frame.sparkSession
    folder = shared_folder(spark)
    frame.write.parquet(folder)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(frame.schema).parquet(folder)


def empty_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def _series(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(seed))


_BYTE = _series(11, 256)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WHITE)] = True
_BASE = _U64(0x9DDFEA08EB382D69)
_POWERS = np.ones(1, _U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 4096)
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, _U64), np.full(size - 1, _BASE, _U64)]))
    return _POWERS


def text_chunks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: (first row, offsets from 0, bytes); nulls are empty."""
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, offsets[row:end + 1] - offsets[row], data[offsets[row]:offsets[end]]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, index of each text's first word); words never cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_IS_SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[:-1]
    before[inner[inner < len(data)]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word; A-Z count as a-z with ``lower``."""
    if not len(starts):
        return np.zeros(0, _U64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    letters = data[np.repeat(starts, lengths) + place]
    with np.errstate(over="ignore"):
        values = (_LOWER_BYTE if lower else _BYTE)[letters] * _powers(int(lengths.max()))[place]
        return mix(np.add.reduceat(values, first))


def hash_of(word: bytes) -> int:
    """The hash that :func:`word_hashes` gives this word."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(word)]))[0])


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit ids of all runs of ``width`` consecutive words (also across texts: the caller cuts)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U64)
    weights = _series(23, width)
    with np.errstate(over="ignore"):
        total = hashes[:n] * weights[0]
        for k in range(1, width):
            total = total + hashes[k:k + n] * weights[k]
        return mix(total)


def short_shingle(hashes: np.ndarray, width: int) -> np.ndarray:
    """The id of a whole sequence shorter than ``width`` words."""
    with np.errstate(over="ignore"):
        return mix(np.array([np.sum(hashes * _series(23, width)[: len(hashes)], dtype=_U64) + _U64(len(hashes))], _U64))


def shingle_sets(array: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct shingle ids; too few words give one id, no words none."""
    for _, offsets, data in text_chunks(array):
        starts, ends, first = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends)
        ids = shingles(hashes, width)
        for k in range(len(offsets) - 1):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= width:
                yield np.unique(ids[a:b - width + 1])
            elif b > a:
                yield short_shingle(hashes[a:b], width)
            else:
                yield np.zeros(0, _U64)


def unused(frame: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``frame`` has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
