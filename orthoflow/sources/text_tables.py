"""Line-oriented text sources: plain lists, delimited tables, pairs, candidates, directories, facts.

Readers return lines with the file and a line number. Parsers take such lines (``source_id, line_no,
line``) and split them into rows and a quarantine with a reason, so bad input stays visible.
"""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orthoflow.functions import identifiers as I
from orthoflow.functions import policies as P
from orthoflow.functions.staging import computed
from orthoflow.functions.text import is_blank, split_lines, strip

# Bounds and patterns of the text forms.
MAX_PAIR_CHARACTERS = 256
MAX_MATCH_CHARACTERS = 10_000
INFO_RELEASE = r"(?:^|\s)Release\s+(\S.*?)\s*$"
INFO_COUNT = r"^(?:([a-z][a-z0-9_-]{0,31})\s+)?([0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)\s+entries$"
INFO_LINKED_START = r"^linked db\s+([a-z][a-z0-9_-]{0,31}|<org>)\s*$"
INFO_LINKED_MORE = r"^\s+([a-z][a-z0-9_-]{0,31}|<org>)\s*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of text files, however they are split between tasks.

    A line's number is its place in its split plus the lines of the file's earlier splits; only a
    table with one row per split is ordered per file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    blocks = lines.groupBy("source_id", "block").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("source_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select("source_id", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(offsets, ["source_id", "block"]).select(
        "source_id", (F.col("seq") - F.col("first") + F.col("offset") + 1).alias("line_no"), "line")


def lines_of(texts: DataFrame) -> DataFrame:
    """Lines of small whole texts (``source_id, text``); blank lines keep their numbers."""
    return texts.select("source_id", F.posexplode(split_lines(F.col("text"))).alias("p", "line")).select(
        "source_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


def text_faults(lines: DataFrame, max_field: int) -> DataFrame:
    """Lines that hold NUL characters, undecodable bytes (read as U+FFFD) or an over-long field."""
    line = F.col("line")
    fault = (
        F.when(line.contains("\0"), F.lit("nul_character"))
        .when(line.contains("\ufffd"), F.lit("invalid_utf8"))
        .when(F.length(line) > max_field, F.lit("field_too_long")))
    return lines.withColumn("fault", fault).filter("fault is not null")


def plain_ko_records(lines: DataFrame) -> DataFrame:
    """One record per non-blank line; invalid ones are kept and marked."""
    raw = F.col("line")
    staged = lines.filter(~is_blank(raw)).withColumn("ko_id", I.normalize_ko(raw))
    out = P.policy_for("user_supplied", "plain_ko").classify(P.no_evidence(raw, F.col("ko_id")))
    return staged.select("source_id", F.col("line_no").alias("row_number"), raw.alias("raw_ko"), "ko_id",
                         out["status"].alias("status"), out["reason"].alias("reason"))


PLAIN_DUPLICATE_KEY = ("source_id", "ko_id", "invalid_text")


def plain_duplicate_key(records: DataFrame) -> DataFrame:
    """Plain lists compare by KO, or by the trimmed text of an invalid line."""
    return records.withColumn("invalid_text", F.when(F.col("ko_id").isNull(), strip(F.col("raw_ko"))))


# --- delimited tables --------------------------------------------------------------------------

def _cell(sep: str) -> str:
    """A quoted cell that is closed, or a cell that does not start with a quote, or an empty one."""
    sep = re.escape(sep)
    return rf'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{sep}][^{sep}]*+|)'


def strict_line(sep: str) -> str:
    """Lines whose quoted cells are closed and end where the cell ends."""
    return rf"^{_cell(sep)}(?:{re.escape(sep)}{_cell(sep)})*+\z"


def table_cells(lines: DataFrame, sep: str) -> DataFrame:
    """Cells of each line as an array; NULL for a line with malformed quoting.

    A line costs by its own length: cells are cut by one pattern, so no line sets a width for the others.
    """
    line = F.col("line")
    raw = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f"{re.escape(sep)}({_cell(sep)})"), F.lit(1))
    opened = F.transform(raw, lambda c: F.when(
        c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return computed(lines, cells=F.when(~line.contains('"'), F.split("line", re.escape(sep))).when(line.rlike(strict_line(sep)), opened))


def malformed_rows(cells: DataFrame) -> DataFrame:
    """Lines with malformed quoting, whole, for the quarantine."""
    return cells.filter("cells is null").drop("cells").withColumn("fault", F.lit("malformed_quoting"))


def ragged_rows(cells: DataFrame, header: list[str]) -> DataFrame:
    """Rows whose cell count differs from the header, as named evidence.

    Surplus cells are ``_extra_n``; where the header has that name, ``_extra_n_m`` with the first free m.
    """
    names = F.array(*[F.lit(name) for name in header])
    used, renamed = set(header), {}
    for taken in header:
        number = taken.removeprefix("_extra_")
        if taken.startswith("_extra_") and number.isdigit() and str(int(number)) == number:
            m = next(k for k in count(1) if f"{taken}_{k}" not in used)
            renamed[taken] = f"{taken}_{m}"
            used.add(renamed[taken])
    other = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair]) if renamed else None

    def name(i: Column) -> Column:
        extra = F.concat(F.lit("_extra_"), (i - len(header) + 1).cast("string"))
        return F.coalesce(F.get(names, i), extra if other is None else F.coalesce(F.element_at(other, extra), extra))

    evidence = F.transform("cells", lambda value, i: F.struct(name(i).alias("name"), value.alias("value")))
    return cells.filter(F.size("cells") != len(header)).select(
        *[c for c in cells.columns if c != "cells"], F.size("cells").alias("actual_columns"), evidence.alias("evidence"))


def table_rows(cells: DataFrame, header: list[str]) -> DataFrame:
    """Rows with exactly the header's cells, as columns named by it."""
    problems = [n for n in header if not n.strip()]
    if problems or len(set(header)) != len(header):
        raise ValueError("headers must be non-empty and unique")
    return cells.filter(F.size("cells") == len(header)).select(
        *[c for c in cells.columns if c not in ("cells", "line")], *[F.col("cells")[i].alias(n) for i, n in enumerate(header)])


def read_table(spark: SparkSession, path: str, sep: str, columns: list[str], line_breaks: bool = False) -> DataFrame:
    """A delimited file with a header through the CSV reader, all cells as text.

    Files split between tasks, unless ``line_breaks`` says that quoted cells may hold line breaks.
    """
    schema = ", ".join(f"`{name}` string" for name in columns)
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", line_breaks).csv(path)


# --- two-column forms --------------------------------------------------------------------------

def _two_columns(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_blank(F.col("line"))).withColumn("parts", F.split("line", "\t")).select(
        *lines.columns, F.size("parts").alias("n"), F.get("parts", F.lit(0)).alias("first"), F.get("parts", F.lit(1)).alias("second"))


def pairs(lines: DataFrame, limit: int | None = MAX_PAIR_CHARACTERS) -> DataFrame:
    """source/target rows in order with repeats; ``fault`` marks the unusable ones.

    A token has at most ``limit`` characters (None: any number).
    """
    token = r"^[\x21-\x7E]{1,%s}$" % ("" if limit is None else limit)
    fault = F.when(F.col("n") != 2, F.lit("expected_two_columns")).when(
        ~F.col("first").rlike(token) | ~F.col("second").rlike(token), F.lit("invalid_identifier"))
    return _two_columns(lines).select("source_id", "line_no", F.col("first").alias("pair_source"), F.col("second").alias("pair_target"), fault.alias("fault"))


def candidate_rows(lines: DataFrame, database: str | Column, limit: int | None = MAX_MATCH_CHARACTERS) -> DataFrame:
    """identifier/text rows whose identifier fits the database and whose text has at most ``limit`` characters (None: any)."""
    long = F.length("second") > limit if limit is not None else F.lit(False)
    kind = F.lit(database) if isinstance(database, str) else database
    fault = (
        F.when(F.col("n") != 2, F.lit("expected_two_columns"))
        .when(~I.valid_identifier(kind, F.col("first")), F.lit("unexpected_identifier"))
        .when(is_blank(F.col("second")) | long, F.lit("invalid_matched_text")))
    return _two_columns(lines).select("source_id", "line_no", F.col("first").alias("identifier"), F.col("second").alias("matched_text"), fault.alias("fault"))


def organism_pathways(lines: DataFrame) -> DataFrame:
    """Directory rows of the organism named by ``source_id``: ids of its own, unique, with names."""
    own = F.col("first").startswith(F.col("source_id")) & (F.regexp_replace("first", r"[0-9]{5}$", "") == F.col("source_id"))
    rows = _two_columns(lines).withColumn("fault", F.when(F.col("n") != 2, F.lit("expected_two_columns")).when(
        ~own, F.lit("unexpected_identifier")).when(is_blank(F.col("second")), F.lit("invalid_name")))
    firsts = rows.filter("fault is null").groupBy("source_id", "first").agg(F.min("line_no").alias("first_line"))
    marked = rows.join(firsts, ["source_id", "first"], "left")
    repeated = F.when(F.col("line_no") > F.col("first_line"), F.lit("duplicate_identifier"))
    return marked.select(F.col("source_id").alias("organism"), "line_no", F.concat(F.lit("path:"), F.col("first")).alias("pathway_id"),
                         F.col("second").alias("name"), F.coalesce("fault", repeated).alias("fault"))


def database_info(texts: DataFrame) -> DataFrame:
    """Release, entry count and linked databases of each info text; conflicts are flagged.

    ``source_id`` is the database name. A linked-database list continues on indented lines.
    """
    lines = F.filter(split_lines(F.col("text")), lambda line: ~is_blank(line))
    staged = computed(texts, lines=lines)
    releases = F.array_distinct(F.filter(F.transform("lines", lambda l: F.regexp_extract(l, INFO_RELEASE, 1)), lambda r: r != ""))
    count_lines = F.filter(F.transform("lines", strip), lambda l: l.rlike(INFO_COUNT) & F.regexp_extract(l, INFO_COUNT, 1).isin("") | (
        l.rlike(INFO_COUNT) & (F.regexp_extract(l, INFO_COUNT, 1) == F.col("source_id"))))
    counts = F.array_distinct(F.transform(count_lines, lambda l: F.replace(F.regexp_extract(l, INFO_COUNT, 2), F.lit(","), F.lit("")).cast("bigint")))
    nothing = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, line: Column) -> Column:
        starts = line.rlike(INFO_LINKED_START)
        inside = starts | (state["open"] & line.rlike(INFO_LINKED_MORE))
        name = F.regexp_extract(F.regexp_replace(line, r"^linked db", "  "), INFO_LINKED_MORE, 1)
        return F.struct(inside.alias("open"), F.when(inside & (name != ""), F.array_append(state["found"], name)).otherwise(state["found"]).alias("found"))

    linked = F.aggregate("lines", nothing, step)["found"]
    named = computed(staged, releases=releases, counts=counts, linked=F.array_distinct(linked))
    header = F.regexp_extract(F.get("lines", F.lit(0)), r"^(\S+)", 1) == F.col("source_id")
    return named.select(
        F.col("source_id").alias("database"), F.get("releases", F.lit(0)).alias("release"), F.get("counts", F.lit(0)).alias("entry_count"),
        F.col("linked").alias("linked_databases"),
        F.when(~F.coalesce(header, F.lit(False)), F.lit("unexpected_database_header")).when(F.size("releases") > 1, F.lit("conflicting_release_lines"))
        .when(F.size("counts") > 1, F.lit("conflicting_entry_counts")).alias("fault"))
