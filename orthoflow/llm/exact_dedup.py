"""Exact deduplication by an extendible-hash index kept in the shared folder.

Rows whose texts are identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one space form a group;
the row with the smallest doc_id stays.

* Map tasks normalise and hash. Copies of a text inside one map task become one *entry* that carries
  the text, so a group of copies sends a task's share as one row, however large the group.
* The *directory* starts with one bucket. A bucket with more than ``bucket_rows`` entries splits by the
  next bit of the hash; when a bucket is as deep as the directory, the directory doubles. Only counts
  per hash prefix reach the driver (``2 ** max_depth`` at most).
* *Owner tasks* get whole buckets (key ranges), sorted by key. Entries with one key form chains; an
  entry joins a chain only when its bytes are equal. Buckets that cannot split any further are longer,
  nothing is left out.
* The chained entries are written as index files; sizes and smallest rows are summed per entry first,
  so no join or aggregate sees a large group.

Null texts count as empty. Null ids sort last, so such a row stays only if its group has no other.
Of equal rows with the same smallest id exactly one stays. No rows give no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthoflow.llm.common import empty_text, materialise

BUCKET_ROWS = 8192
MAX_DEPTH = 16


def normalised(column: str = "text"):
    return F.regexp_replace(empty_text(column), "[\\x20\\x09-\\x0D]+", " ")


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the entry of each row: the first row of this map task with its text. Later copies drop ``_text``."""
    first: dict[str, int] = {}
    for batch in batches:
        rows, shas = batch.column("_row").to_pylist(), batch.column("_sha").to_pylist()
        entries = [first.setdefault(sha, row) for sha, row in zip(shas, rows)]
        columns, names = list(batch.columns), list(batch.schema.names)
        if "_text" in names:
            own = pa.array([e == r for e, r in zip(entries, rows)], pa.bool_())
            place = names.index("_text")
            columns[place] = pc.if_else(own, columns[place], pa.scalar(None, columns[place].type))
        yield pa.RecordBatch.from_arrays([*columns, pa.array(entries, pa.int64())], [*names, "_entry"])


def directory(counts: dict[int, int], bucket_rows: int, max_depth: int) -> tuple[int, dict[int, int]]:
    """Global depth and, for every prefix of that many bits, its bucket.

    ``counts`` has the entries of each prefix of ``max_depth`` bits. Buckets are named by their first
    full prefix.
    """
    levels = [dict(counts)]
    for _ in range(max_depth):
        above: dict[int, int] = {}
        for prefix, n in levels[-1].items():
            above[prefix >> 1] = above.get(prefix >> 1, 0) + n
        levels.append(above)
    levels.reverse()
    depth, full, buckets = 0, [(0, 0)], []
    while full:
        prefix, local = full.pop()
        if levels[local].get(prefix, 0) > bucket_rows and local < max_depth:
            depth = max(depth, local + 1)  # the directory doubles when a bucket outgrows it
            full += [(prefix * 2, local + 1), (prefix * 2 + 1, local + 1)]
        else:
            buckets.append((prefix, local))
    table = {}
    for prefix, local in buckets:
        low = prefix << (depth - local)
        for slot in range(low, (prefix + 1) << (depth - local)):
            table[slot] = low
    return depth, table


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk entries in key order: each joins the chain of its key with equal bytes, named by its first entry."""
    key, chains = None, []
    for batch in batches:
        keys, entries = batch.column("_key").to_pylist(), batch.column("_entry").to_pylist()
        texts = batch.column("_text").cast(pa.large_binary())
        classes = []
        for i, (k, entry) in enumerate(zip(keys, entries)):
            if k != key:
                key, chains = k, []
            text = texts[i].as_buffer()
            for known, name in chains:
                if known.equals(text):
                    break
            else:
                name = entry
                chains.append((text, name))
            classes.append(name)
        yield pa.RecordBatch.from_arrays([batch.column("_entry"), pa.array(classes, pa.int64())], ["_entry", "_class"])


def _resolved(docs: DataFrame, bucket_rows: int, max_depth: int, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with their entry, entries with their group); ``whole`` keeps the given rows in ``_doc``."""
    spark = docs.sparkSession
    text = normalised()
    kept = F.struct(*[F.col(c) for c in docs.columns]).alias("_doc") if whole else text.alias("_text")
    hashed = docs.select(
        F.xxhash64(text).alias("_key"), F.sha2(text, 256).alias("_sha"), F.monotonically_increasing_id().alias("_row"),
        F.col("doc_id").cast("long").alias("doc_id"), kept)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in hashed.schema]).add("_entry", "long")
    rows = materialise(hashed.mapInArrow(_combine, schema))
    entries = rows.filter("_row = _entry")
    if whole:
        entries = entries.withColumn("text", F.col("_doc.text")).withColumn("_text", normalised())
    counts = {r[0]: r[1] for r in entries.groupBy(
        F.shiftrightunsigned("_key", 64 - max_depth).alias("prefix")).count().collect()}  # 2 ** max_depth rows at most
    depth, table = directory(counts, bucket_rows, max_depth)
    slots = spark.createDataFrame(sorted(table.items()), "_slot long, _bucket long")
    slot = F.shiftrightunsigned("_key", 64 - depth) if depth else F.lit(0).cast("long")
    owned = (
        entries.select("_key", "_entry", "_text", slot.alias("_slot")).join(F.broadcast(slots), "_slot")
        .repartition("_bucket").sortWithinPartitions("_bucket", "_key", "_entry").select("_key", "_entry", "_text"))
    chained = materialise(owned.mapInArrow(_owner, "_entry long, _class long"))
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    sizes = rows.groupBy("_entry").agg(F.count("*").alias("n"), smallest.alias("low"))
    groups = chained.join(sizes, "_entry").groupBy("_class").agg(F.sum("n").alias("group_size"), F.min("low").alias("low"))
    index = chained.join(groups, "_class").select(
        "_entry", F.col("low.id").alias("keep_id"), F.col("low.row").alias("_keep_row"), "group_size")
    return rows, index


def exact_groups(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows, index = _resolved(docs, bucket_rows, max_depth)
    return rows.select("_entry", "_row", "doc_id", "_sha").join(index, "_entry").select(
        "doc_id", "keep_id", "group_size", (F.col("_row") == F.col("_keep_row")).alias("kept"), F.col("_sha").alias("text_sha256"))


def keep_first(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, index = _resolved(docs, bucket_rows, max_depth, whole=True)
    kept = rows.select("_entry", "_row").join(index, "_entry").filter("_row = _keep_row").select("_row")
    return rows.join(kept.hint("merge"), "_row", "left_semi").select("_doc.*")
