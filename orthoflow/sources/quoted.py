"""Delimited files whose quoted cells may hold line breaks, read as Spark splits them.

Whether a line starts inside a quoted cell depends on all lines before it. A line is a function from the state before it
to the state after it, and functions compose: one narrow pass runs through each split for both possible states
at its start, a table with one row per split composes the splits of a file, and each line then knows its state.
Lines are shuffled only where a record has several of them.

A record is numbered by the physical line that ends it; ``first_line_no`` is the one that starts it. Line breaks in cells
stay as they are, ``\\r\\n`` included; the ``\\r`` before a record's end is dropped, and a byte order mark at the start.
A lone ``\\r`` ends no line. A file that ends inside a quoted cell gives the fault ``unclosed_quote`` for its last record,
whose text is the record's first line, so a stray quote never gathers a file in one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orthoflow.sources.text_tables import table_cells, table_rows

SPLIT = ["source_id", "block"]


def state_tests(sep: str) -> tuple[str, str]:
    """Patterns of lines that end inside a quoted cell: those that start outside one, those that start inside.

    After a closing quote a cell runs on to its separator, as lenient readers take it; the record's own check
    finds such cells malformed. All repetitions are possessive: a line is read once.
    """
    inside, sep = r'[^"]*+(?:""[^"]*+)*+', re.escape(sep)
    rest = rf"(?:(?:\"{inside}\"[^{sep}]*+|[^\"{sep}][^{sep}]*+|){sep})*+\"{inside}\z"
    return rf"^{rest}", rf"^{inside}(?:\z|\"[^{sep}]*+{sep}{rest})"


def _states(opens: np.ndarray, stays: np.ndarray, before: bool) -> np.ndarray:
    """States after each line from the state before the first: the last constant line decides, swaps after it count."""
    constant, swap = opens == stays, opens & ~stays
    swaps = np.cumsum(swap)
    index = np.maximum.accumulate(np.where(constant, np.arange(len(opens)), -1))
    base = np.where(index >= 0, opens[index], before)
    since = swaps - np.where(index >= 0, swaps[index], 0)
    return base ^ (since % 2 == 1)


class _Run:
    """The running state of one split for one state at its start."""

    def __init__(self, inside: bool):
        self.inside, self.start = inside, -1

    def feed(self, opens: np.ndarray, stays: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state before, state after, place of the record's first line or -1 if it lies in an earlier split) per line."""
        after = _states(opens, stays, self.inside)
        before = np.concatenate([[self.inside], after[:-1]])
        start = np.maximum.accumulate(np.concatenate([[self.start], np.where(before, -1, np.arange(first, first + len(before)))]))[1:]
        self.inside, self.start = bool(after[-1]), int(start[-1])
        return before, after, start


_SCAN = "source_id string, block long, line string, place long, " + ", ".join(f"before{k} boolean, after{k} boolean, start{k} long" for k in (0, 1))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, runs, place = None, [], 0
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        sources = batch.column("source_id").dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(sources) != 0)) + 1
        for start, stop in zip([0, *edges], [*edges, batch.num_rows]):
            if stop == start:
                continue
            part = batch.slice(start, stop - start)
            mine = (part.column("source_id")[0].as_py(), int(blocks[start]))
            if mine != key:
                key, runs, place = mine, [_Run(False), _Run(True)], 0
            opens, stays = (part.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("opens", "stays"))
            columns = [part.column("source_id"), part.column("block"), part.column("line"), pa.array(np.arange(place, place + len(opens)))]
            for run in runs:
                columns += [pa.array(x) for x in run.feed(opens, stays, place)]
            place += len(opens)
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SCAN.split(", ")])


def _composed(splits: DataFrame) -> DataFrame:
    """Per split: lines before it, state at its start, and the first line of the record open there.

    ``splits`` has one row per split; only these rows are ordered per file.
    """
    before = W.partitionBy("source_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("source_id").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("source_id").orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    swap = F.when(F.col("after0") & ~F.col("after1"), 1).otherwise(0)
    odd = splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "parity", F.sum(swap).over(upto) % 2 == 1).withColumn("earlier", F.coalesce(F.lag("parity").over(W.partitionBy("source_id").orderBy("block")), F.lit(False)))
    # A constant split fixes the state; kept free of the swaps before it, it can be carried on past later ones.
    fixed = F.when(F.col("after0") == F.col("after1"), F.col("after0") != F.col("parity"))
    stated = odd.withColumn("fixed", fixed).withColumn(
        "inside", F.coalesce(F.last("fixed", True).over(before), F.lit(False)) != F.col("earlier"))
    chosen = F.when(F.col("inside"), F.col("start1")).otherwise(F.col("start0"))
    opened = stated.withColumn("opened", F.when(chosen >= 0, F.col("offset") + chosen + 1))
    ends = F.when(F.col("inside"), F.col("after1")).otherwise(F.col("after0"))
    current = opened.withColumns({"carried": F.last("opened", True).over(before), "current": F.last("opened", True).over(upto)})
    return current.select(*SPLIT, "offset", "inside", "carried", F.last(F.when(ends, F.col("current")).otherwise(F.lit(0))).over(whole).alias("unclosed"))


def numbered_lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Every physical line with its number, the first line of its record, whether it ends the record, and whether none does."""
    line = F.col("line")
    opens, stays = state_tests(sep)
    quoted = line.contains('"')
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    tested = text.select(*SPLIT, "line", (quoted & line.rlike(opens)).alias("opens"), (~quoted | line.rlike(stays)).alias("stays"))
    scanned = tested.mapInArrow(_scan, _SCAN)
    last = F.max(F.struct("place", "after0", "after1", "start0", "start1"))
    splits = scanned.groupBy(*SPLIT).agg(last.alias("l")).select(
        *SPLIT, (F.col("l.place") + 1).alias("n"), *[F.col(f"l.{c}") for c in ("after0", "after1", "start0", "start1")])
    joined = scanned.join(_composed(splits), SPLIT)

    def known(name: str) -> Column:
        return F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    first = F.when(known("start") >= 0, F.col("offset") + known("start") + 1).otherwise(F.col("carried"))
    return joined.select(
        "source_id", (F.col("offset") + F.col("place") + 1).alias("line_no"), first.alias("first_line_no"),
        (~known("after")).alias("ends"), (first == F.col("unclosed")).alias("unclosed"), "line")


def read_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Records as (source_id, line_no, first_line_no, line, fault); the line is the record's text, line breaks and all."""
    lines = numbered_lines(spark, path, sep)
    single = lines.filter(F.col("ends") & (F.col("line_no") == F.col("first_line_no"))).select("source_id", "line_no", "first_line_no", "line", F.lit(None).cast("string").alias("fault"))
    several = lines.filter(~(F.col("ends") & (F.col("line_no") == F.col("first_line_no"))) & ~F.col("unclosed"))
    gathered = several.groupBy("source_id", "first_line_no").agg(
        F.max("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines")).select(
        "source_id", "line_no", "first_line_no", F.array_join(F.transform("lines", lambda l: l["line"]), "\n").alias("line"), F.lit(None).cast("string").alias("fault"))
    broken = lines.filter("unclosed").groupBy("source_id", "first_line_no").agg(
        F.max("line_no").alias("line_no"), F.min_by("line", "line_no").alias("line")).select(
        "source_id", "line_no", "first_line_no", "line", F.lit("unclosed_quote").alias("fault"))
    clean = F.regexp_replace(F.when(F.col("first_line_no") == 1, F.regexp_replace("line", "^\\ufeff", "")).otherwise(F.col("line")), "\r\\z", "")
    return single.unionByName(gathered).unionByName(broken).withColumn("line", clean)


def read_table(spark: SparkSession, path: str, sep: str = ",") -> tuple[list[str], DataFrame, DataFrame]:
    """(header, cells, faults) of files with one common header record; blank records are left out.

    ``cells`` goes to ``table_rows``, ``ragged_rows`` and ``malformed_rows``; ``faults`` are records without an end.
    """
    records = read_records(spark, path, sep)
    headers = records.groupBy("source_id").agg(F.min_by("line", "line_no").alias("line")).select("line").distinct()
    first = table_cells(headers, sep).limit(2).collect()
    if len(first) != 1 or first[0]["cells"] is None:
        raise ValueError("the files need one common, well-formed header")
    header = list(first[0]["cells"])
    body = records.filter((F.col("first_line_no") > 1) & (F.col("line") != ""))
    return header, table_cells(body.filter("fault is null").drop("fault"), sep), body.filter("fault is not null")


def read_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows with exactly the header's cells, numbered by the line that ends them."""
    header, cells, _ = read_table(spark, path, sep)
    return table_rows(cells, header)
