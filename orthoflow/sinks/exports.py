"""Input files for external web tools: rule checks, lines and a manifest.

Every export splits its rows into valid lines and violations with a rule name. Uniqueness rules are
grouped counts, so repeated rows never have to be held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.functions import identifiers as I
from orthoflow.functions.text import WHITESPACE, is_blank

# Cell rules and per-target formats.
FORBIDDEN_CELL = r"[\x00-\x1F\x7F-\x9F\u2028\u2029]"
MAX_TOKEN, MAX_ATTRIBUTE = 128, 1000
SEARCH_REFERENCE_ID = r"^(?:K|R|RC|C|G|D|H)[0-9]{5}$"
COLOR_REFERENCE_ID = r"^(?:K|R|C|G|D)[0-9]{5}$"
ORGANISM_ID = r"^(?:K|C|G|D)[0-9]{5}$"
JOIN_ID = r"^(?:C|G|R|D|H)[0-9]{5}$"
FORMULA = r"^(?:[A-Z][a-z]?(?:[1-9][0-9]*)?)+$"
EXACT_MASS = r"^(?:0|[1-9][0-9]{0,19})(?:\.[0-9]{1,12})?$"
COLOR = r"^#[0-9A-Fa-f]{6}$|^[A-Za-z]{3,20}$"
DUPLICATE_RULES = {
    "color": "exact_rows_rejected_repeated_identifier_colors_preserved",
    "join": "exact_rows_rejected_repeated_identifier_attributes_preserved",
    "ko_sequence": "gene_ids_unique_repeated_ko_ids_preserved",
}


def cell_violation(col: Column, limit: int | None = MAX_TOKEN) -> Column:
    """Rule a cell breaks, or NULL; ``limit`` is the longest cell a target takes (None: any)."""
    return (F.when(is_blank(col), F.lit("blank")).when(col.rlike(FORBIDDEN_CELL), F.lit("control_character"))
            .when(F.length(col) > limit if limit is not None else F.lit(False), F.lit("too_long")))


def token_violation(col: Column) -> Column:
    spaced = F.translate(col, WHITESPACE, "") != col
    return F.coalesce(cell_violation(col), F.when(spaced, F.lit("whitespace")))


def _is_ec(col: Column) -> Column:
    return I.is_ec_number(F.regexp_replace(col, "^ec:", ""))


def _scoped(col: Column, scope: str, organism: str | None, reference: Column) -> Column:
    if scope == "reference":
        return reference
    prefix = "hsa" if scope == "hsa" else organism
    if prefix is None:
        raise ValueError("organism scope needs an organism code")
    return col.rlike(ORGANISM_ID) | _is_ec(col) | (I.is_gene(col) & (F.substring_index(col, ":", 1) == prefix))


def _checked(rows: DataFrame, violation: Column, line: Column, unique: tuple[str, ...]) -> DataFrame:
    """Add ``violation`` and ``line``; rows whose unique key repeats are violations as well."""
    counts = rows.groupBy(*unique).agg(F.count("*").alias("copies"))
    keyed = rows.join(counts.select(*[F.col(c).alias(f"k_{c}") for c in unique], "copies"),
                      on=[F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in unique]).drop(*[f"k_{c}" for c in unique])
    rule = F.coalesce(violation, F.when(F.col("copies") > 1, F.lit("duplicate")))
    return keyed.withColumn("violation", rule).withColumn("line", F.when(F.col("violation").isNull(), line)).drop("copies")


def reconstruct(rows: DataFrame) -> DataFrame:
    """``[user_id TAB] KO``; an id may not start with ``#``."""
    user, ko = F.col("user_id"), F.col("ko_id")
    rule = F.coalesce(F.when(~ko.rlike(I.KO_PATTERN), F.lit("invalid_ko")),
                      F.when(user.isNotNull(), F.coalesce(token_violation(user), F.when(user.startswith("#"), F.lit("comment_prefix")))))
    return _checked(rows, rule, F.concat_ws("\t", user, ko), ("user_id", "ko_id"))


def search(rows: DataFrame, scope: str = "reference", organism: str | None = None) -> DataFrame:
    col = F.col("identifier")
    fits = _scoped(col, scope, organism, col.rlike(SEARCH_REFERENCE_ID) | _is_ec(col) | I.is_organism_code(col))
    return _checked(rows, F.coalesce(token_violation(col), F.when(~fits, F.lit("scope_mismatch"))), col, ("identifier",))


def color(rows: DataFrame, scope: str = "reference", organism: str | None = None) -> DataFrame:
    """identifier and ``background[,foreground]``; at least one color."""
    col, back, front = F.col("identifier"), F.col("background_color"), F.col("foreground_color")
    fits = _scoped(col, scope, organism, col.rlike(COLOR_REFERENCE_ID) | _is_ec(col))
    bad = F.coalesce(~back.rlike(COLOR), F.lit(False)) | F.coalesce(~front.rlike(COLOR), F.lit(False))
    rule = F.coalesce(token_violation(col), F.when(back.isNull() & front.isNull(), F.lit("no_color")),
                      F.when(bad, F.lit("invalid_color")), F.when(~fits, F.lit("scope_mismatch")))
    spec = F.when(front.isNull(), back).otherwise(F.concat(F.coalesce(back, F.lit("")), F.lit(","), front))
    return _checked(rows, rule, F.concat_ws("\t", col, spec), ("identifier", "background_color", "foreground_color"))


def join_attributes(rows: DataFrame, mode: str) -> DataFrame:
    col, attribute = F.col("identifier"), F.col("attribute")
    fits = col.rlike(I.KO_PATTERN) if mode == "ko" else col.rlike(JOIN_ID) | I.is_organism_code(col)
    rule = F.coalesce(token_violation(col), cell_violation(attribute, MAX_ATTRIBUTE), F.when(~fits, F.lit("mode_mismatch")))
    return _checked(rows, rule, F.concat_ws("\t", col, attribute), ("identifier", "attribute"))


def mwsearch(rows: DataFrame, mode: str) -> DataFrame:
    """One homogeneous list: formulas, positive exact masses or compound ids."""
    col = F.col("value")
    fits = {"formula": col.rlike(FORMULA), "c_number": col.rlike(r"^C[0-9]{5}$"),
            "exact_mass": col.rlike(EXACT_MASS) & (col.try_cast("decimal(33,12)") > 0)}[mode]
    return _checked(rows, F.coalesce(token_violation(col), F.when(~F.coalesce(fits, F.lit(False)), F.lit("mode_mismatch"))), col, ("value",))


def ko_composition(rows: DataFrame, unique: tuple[str, ...] = ("ko_id",)) -> DataFrame:
    """KO ids; ``unique`` names what may not repeat (with a sample's name for many samples at once)."""
    col = F.col("ko_id")
    return _checked(rows, F.when(~col.rlike(I.KO_PATTERN), F.lit("invalid_ko")), col, unique)


def ko_sequence(rows: DataFrame) -> DataFrame:
    """gene and KO in the given order (``genome_id, position``); genes unique, repeated KOs kept."""
    gene, ko = F.col("gene_id"), F.col("ko_id")
    rule = F.coalesce(token_violation(gene), F.when(~ko.rlike(I.KO_PATTERN), F.lit("invalid_ko")))
    return _checked(rows, rule, F.concat_ws("\t", gene, ko), ("genome_id", "gene_id"))


def violations(checked: DataFrame, target: str, *keys: str) -> DataFrame:
    return checked.filter("violation is not null").select(F.lit(target).alias("target"), *keys, "violation")


def manifest(checked: DataFrame, target: str, delimiter: str, ordered: bool = False) -> DataFrame:
    """One row of facts about an export; ``ordered`` is what ``write_lines`` was told (it returns that)."""
    return checked.agg(F.count_if(F.col("violation").isNull()).alias("item_count"), F.count_if(F.col("violation").isNotNull()).alias("rejected")).select(
        F.lit(target).alias("target"), "item_count", "rejected", F.lit(False).alias("header"), F.lit(delimiter).alias("delimiter"),
        F.lit(ordered).alias("order_preserved"), F.lit(DUPLICATE_RULES.get(target, "duplicates_rejected")).alias("duplicate_semantics"))


def write_lines(checked: DataFrame, path: str, partition_by: str | None = None, order: str | None = None) -> bool:
    """Text files of the valid lines, with ``partition_by`` one folder per genome; returns whether they are in order.

    With ``order`` (a position column) rows are range-partitioned by it, so the files in name order hold the
    caller's order and a large genome is split over tasks. Without it no order is promised.
    """
    valid = checked.filter("violation is null")
    keys = [c for c in (partition_by, order) if c is not None]
    placed = valid.repartitionByRange(*keys).sortWithinPartitions(*keys) if order else valid
    writer = placed.select(*([partition_by] if partition_by else []), "line").write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).text(path)
    return order is not None
