"""Protein sequence files and the check of annotation output against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Residue alphabet, longest identifier.
PROTEIN_ALPHABET = "ACDEFGHIKLMNPQRSTVWYBXZJUO*"
MAX_IDENTIFIER = 256


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One record text per row, split at header lines."""
    return spark.read.option("lineSep", "\n>").text(path).filter("value <> ''").select(
        F.regexp_replace("value", r"^>", "").alias("record"))


def sequences(records: DataFrame, max_identifier: int | None = MAX_IDENTIFIER) -> DataFrame:
    """(sequence_id, residues, length, fault) of record texts (header line, then residue lines).

    Identifiers beyond ``max_identifier`` characters are a fault; None allows any length.
    """
    header = F.substring_index("record", "\n", 1)
    body = F.regexp_replace(F.col("record"), r"^[^\n]*\n?", "")
    residues = F.upper(F.replace(F.replace(body, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")))
    parsed = records.withColumns({
        "header": F.regexp_replace(header, r"\r$", ""), "residues": residues}).withColumn(
        "sequence_id", F.regexp_extract("header", r"^\s*(\S+)", 1))
    fault = (
        F.when((F.col("header") == "") | F.col("header").rlike(r"[\x00-\x08\x0A-\x1F\x7F]"), F.lit("invalid_header"))
        .when(F.col("sequence_id") == "", F.lit("missing_identifier"))
        .when(F.length("sequence_id") > max_identifier if max_identifier is not None else F.lit(False), F.lit("identifier_too_long"))
        .when(F.col("residues") == "", F.lit("no_residues"))
        .when(F.translate("residues", PROTEIN_ALPHABET, "") != "", F.lit("invalid_residue")))
    return parsed.withColumn("fault", fault).withColumn("length", F.length("residues").cast("bigint"))


def duplicate_identifiers(parsed: DataFrame, *by: str) -> DataFrame:
    return parsed.groupBy(*by, "sequence_id").agg(F.count("*").alias("n")).filter("n > 1")


def fasta_summary(parsed: DataFrame, *by: str) -> DataFrame:
    return parsed.filter("fault is null").groupBy(*by).agg(
        F.count("*").alias("sequences"), F.sum("length").alias("total_residues"), F.max("length").alias("max_length"))


def reconcile(inputs: DataFrame, outputs: DataFrame, top_k: int | None = None) -> DataFrame:
    """Per sequence id: expected or not, rows, and the first rule it breaks (or NULL).

    ``top_k`` is the exact row count of single-domain output; NULL allows several rows.
    """
    expected = inputs.select("sequence_id").distinct().withColumn("expected", F.lit(True))
    rows = outputs.groupBy("sequence_id").agg(F.count("*").alias("rows"))
    joined = expected.join(rows, "sequence_id", "full").na.fill(0, ["rows"]).withColumn("expected", F.coalesce("expected", F.lit(False)))
    wrong = (F.col("rows") != top_k) if top_k is not None else F.lit(False)
    return joined.withColumn("violation", F.when(~F.col("expected"), F.lit("unexpected")).when(
        F.col("rows") == 0, F.lit("missing")).when(wrong, F.lit("wrong_row_count")))


def output_coverage(reconciled: DataFrame) -> DataFrame:
    return reconciled.agg(
        F.count_if("expected").alias("input_ids"), F.sum("rows").alias("output_rows"),
        F.count_if(F.col("rows") > 0).alias("distinct_output_ids"),
        F.count_if(F.col("violation") == "missing").alias("missing_ids"),
        F.count_if(F.col("violation") == "unexpected").alias("unexpected_ids"))
