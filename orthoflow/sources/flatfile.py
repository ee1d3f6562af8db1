"""Flat-file records: 12-column labels, continuation lines, ``///`` terminators.

Files are read by lines, however they split between tasks; each record becomes one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orthoflow.functions.staging import computed
from orthoflow.functions.text import strip

# Terminator, label width, field names, entry ids.
TERMINATOR = r"^///[ \t]*$"
LABEL_WIDTH = 12
FIELD_LABEL = r"^(?:|  )([A-Z][A-Z0-9_]*) *$"
ENTRY_IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9:._-]{0,99}$"


def read_flat_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per record text: source_id, record_no (from 1), text, terminated.

    Files are read by line, so LF, CRLF and blanks after a terminator make no difference and a data line
    that ends in ``///`` stays whole. A record's number is one more than the terminators before it: those of
    its split, counted in the split, plus those of earlier splits from a table with one row per split.
    Text after the last terminator is a record of its own with ``terminated = false``.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", r"\r$", "").alias("line"))
    lines = lines.withColumn("ends", F.col("line").rlike(TERMINATOR))
    splits = lines.groupBy("source_id", "block").agg(F.count_if("ends").alias("n"))
    before = W.partitionBy("source_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("source_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = W.partitionBy("source_id", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    numbered = lines.withColumn("own", F.coalesce(F.count_if("ends").over(inside), F.lit(0))).join(offsets, ["source_id", "block"])
    records = numbered.groupBy("source_id", (F.col("own") + F.col("earlier") + 1).alias("record_no")).agg(
        F.array_sort(F.collect_list(F.when(~F.col("ends"), F.struct("block", "seq", "line")))).alias("parts"), F.bool_or("ends").alias("terminated"))
    texts = records.withColumn("text", F.array_join(F.transform("parts", lambda p: p["line"]), "\n"))
    return texts.filter((strip(F.col("text")) != "") | F.col("terminated")).select("source_id", "record_no", "text", "terminated")


def unterminated(records: DataFrame) -> DataFrame:
    """Entries without a terminator, as faults."""
    return records.filter(~F.col("terminated")).select("source_id", "record_no", F.lit("unterminated_entry").alias("fault"))


def record_lines(text: Column) -> Column:
    """Lines before the terminator, without leading blank lines."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?m)^///[ \t]*\r?$[\s\S]*", ""), r"^(?:[ \t]*\r?\n)+", "")
    return F.filter(F.split(body, r"\r?\n"), lambda line: line != "")


def line_fault(lines: Column) -> Column:
    """First structural fault of a record, or NULL."""
    label = lambda line: F.substring(line, 1, LABEL_WIDTH)
    blank = " " * LABEL_WIDTH
    return (
        F.when(F.size(lines) == 0, F.lit("terminator_without_entry"))
        .when(F.exists(lines, lambda line: F.length(line) < LABEL_WIDTH), F.lit("invalid_field_columns"))
        .when(label(lines[0]) == blank, F.lit("continuation_without_field"))
        .when(F.exists(lines, lambda line: (label(line) != blank) & ~label(line).rlike(FIELD_LABEL)), F.lit("invalid_field_name"))
        .when(F.exists(lines, lambda line: label(line).rlike(r"^  ENTRY *$")), F.lit("invalid_entry_field_indent"))
    )


def parse_entries(records: DataFrame) -> DataFrame:
    """Add ``fields`` (ordered struct<name, indent, lines>), ``identifier`` and ``fault`` to record texts.

    Continuation lines attach to the last label before them: a line's field is the number of labels
    up to it.
    """
    with_lines = computed(records, record_lines=record_lines(F.col("text")))
    is_label = F.transform("record_lines", lambda line: F.substring(line, 1, LABEL_WIDTH) != " " * LABEL_WIDTH)
    numbers = F.transform(is_label, lambda flag, i: F.when(flag, i + 1))
    labelled = computed(with_lines, fault=line_fault(F.col("record_lines")), starts=F.array_compact(numbers))

    def field(start: Column, k: Column) -> Column:
        head = F.get(F.col("record_lines"), start - 1)
        stop = F.coalesce(F.get(F.col("starts"), k + 1), F.size("record_lines") + 1)
        body = F.slice(F.col("record_lines"), start, stop - start)
        return F.struct(
            F.trim(F.substring(head, 1, LABEL_WIDTH)).alias("name"),
            F.when(head.startswith("  "), F.lit(2)).otherwise(F.lit(0)).alias("indent"),
            F.transform(body, lambda line: F.substr(line, F.lit(LABEL_WIDTH + 1))).alias("lines"),
            start.alias("start_line"), (stop - 1).alias("end_line"))

    parsed = computed(labelled, fields=F.when(F.col("fault").isNull(), F.transform("starts", field)))
    found = computed(parsed, entries=F.filter(F.col("fields"), lambda f: (f["name"] == "ENTRY") & (f["indent"] == 0)))
    tokens = F.split(strip(F.get(F.get("entries", F.lit(0))["lines"], F.lit(0))), r"\s+")
    first = computed(found, tokens=tokens)
    identifier = F.when((F.size("tokens") >= 2) & (F.col("tokens")[0] == "EC"), F.get("tokens", F.lit(1))).otherwise(F.get("tokens", F.lit(0)))
    named = computed(first, identifier=identifier)
    return computed(named, fault=F.coalesce(
        F.col("fault"),
        F.when(F.size("entries") == 0, F.lit("missing_entry_field")).when(F.size("entries") > 1, F.lit("duplicate_entry_field")),
        F.when(~F.col("identifier").rlike(ENTRY_IDENTIFIER), F.lit("invalid_entry_identifier")),
    )).drop("record_lines", "starts", "entries", "tokens")


def entry_fields(entries: DataFrame, *keys: str) -> DataFrame:
    """One row per field of the well-formed entries."""
    return entries.filter("fault is null").select(*keys, "identifier", F.posexplode("fields").alias("field_no", "f")).select(
        *keys, "identifier", "field_no", "f.name", "f.indent", "f.lines", "f.start_line", "f.end_line")


def module_definitions(entries: DataFrame) -> DataFrame:
    """(module_id, module_name, definition): exactly one each of ENTRY, NAME and DEFINITION.

    ``fault`` names the first field that is missing, repeated or malformed.
    """
    def one(name: str) -> Column:
        found = F.filter(F.col("fields"), lambda f: (f["name"] == name) & (f["indent"] == 0))
        lines = F.transform(F.get(found, F.lit(0))["lines"], strip)
        usable = (F.size(found) == 1) & ~F.exists(lines, lambda line: line == "")
        if name == "ENTRY":
            usable = usable & (F.size(lines) == 1)
        return F.when(usable, F.array_join(lines, " "))

    parts = computed(entries.filter("fault is null").select(F.col("identifier").alias("module_id"), "fields"),
                     entry=one("ENTRY"), module_name=one("NAME"), definition=one("DEFINITION")).drop("fields")
    first_token = F.regexp_extract(F.col("entry"), r"^(\S+)", 1)
    return parts.withColumn("fault", F.when(F.col("entry").isNull() | (first_token != F.col("module_id")), F.lit("ENTRY"))
                            .when(F.col("module_name").isNull(), F.lit("NAME"))
                            .when(F.col("definition").isNull(), F.lit("DEFINITION"))).drop("entry")
