"""A keyed log in a shared folder: one folder per micro-batch, compacted now and then, split by buckets of the key.

A micro-batch writes only its own rows, under its number, so a replayed batch replaces what it wrote and
changes nothing. A base holds all batches up to its number in merged form; readers take the newest base and the
batches after it. Only folders that Spark has marked as complete count. Rows carry ``bucket``, a hash of the
leading key column, as a partition column, so a batch can read the buckets it touches and no others.

No state is kept between batches but these folders: memory depends on a batch, not on what came before.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = re.compile(r"(delta|base)-([0-9]+)$")


class KeyedLog:
    def __init__(self, spark: SparkSession, path: str, bucket_key: str, merge: Callable[[DataFrame], DataFrame], buckets: int = 64, compact_every: int = 16):
        """``merge`` turns the rows of several folders into those of one (distinct rows, sums by key)."""
        if buckets < 1 or compact_every < 1:
            raise ValueError("buckets and compact_every must be positive")
        self.spark, self.path, self.bucket_key, self.merge = spark, path.rstrip("/"), bucket_key, merge
        self.buckets, self.compact_every = buckets, compact_every

    def _store(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folders(self) -> list[tuple[str, int]]:
        """(kind, number) of the complete folders."""
        at, store = self._store()
        if not store.exists(at):
            return []
        found = []
        for status in store.listStatus(at):
            name = FOLDER.fullmatch(status.getPath().getName())
            if name and store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append((name[1], int(name[2])))
        return sorted(found)

    def live(self, upto: int | None = None) -> list[str]:
        """The folders a reader takes: the newest base up to a batch, and the batches after it."""
        found = [(kind, n) for kind, n in self.folders() if upto is None or n <= upto]
        base = max((n for kind, n in found if kind == "base"), default=-1)
        return [f"{self.path}/{kind}-{n}" for kind, n in found if (kind == "base" and n == base) or (kind == "delta" and n > base)]

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.bucket_key), F.lit(self.buckets)).cast("int"))

    def raw(self, schema, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the live folders as written, with their bucket; pruned to ``buckets`` if given. ``schema`` is that of the log's rows."""
        whole = self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(0)).schema
        folders = self.live(upto)
        if not folders:
            return self.spark.createDataFrame([], whole)
        # One read per folder: they share no base path, and each finds its own partition column.
        frames = [self.spark.read.schema(whole).parquet(folder) for folder in folders]
        rows = frames[0]
        for more in frames[1:]:
            rows = rows.unionByName(more)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def read(self, schema, upto: int | None = None) -> DataFrame:
        return self.merge(self.raw(schema, upto).drop("bucket"))

    def write(self, rows: DataFrame, number: int) -> None:
        """The rows of one batch, in place of what the same batch wrote before; then a compaction when it is due."""
        self._put(rows, f"delta-{number}")
        if (number + 1) % self.compact_every == 0:
            self.compact(rows.schema, number)

    def compact(self, schema, number: int) -> None:
        """One base for all batches up to ``number``."""
        self._put(self.read(schema, number), f"base-{number}")

    def vacuum(self) -> int:
        """Remove folders that neither the newest base nor the one before it needs; returns how many."""
        found = self.folders()
        bases = sorted(n for kind, n in found if kind == "base")
        if len(bases) < 2:
            return 0
        _, store = self._store()
        old = [(kind, n) for kind, n in found if n < bases[-2] or (kind == "delta" and n == bases[-2])]
        for kind, n in old:
            store.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-{n}"), True)
        return len(old)

    def _put(self, rows: DataFrame, name: str) -> None:
        self.bucketed(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
