"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed at both ends of a cell.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line breaks of a plain list.
LINE_BREAKS = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]"
# First characters a spreadsheet would read as a formula.
FORMULA_PREFIXES = ("=", "+", "-", "@", "\t", "\r", "\n", "'")
MAX_LABEL_CHARACTERS = 256


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def split_lines(col: Column) -> Column:
    return F.split(col, LINE_BREAKS)


def has_control(col: Column) -> Column:
    return col.rlike(r"[\x00-\x1F\x7F]")


def valid_label(col: Column, limit: int | None = MAX_LABEL_CHARACTERS) -> Column:
    """Trimmed, non-blank, free of control characters and at most ``limit`` characters (None: any length)."""
    return strip(col).rlike(r"^[^\x00-\x1F\x7F]{1,%s}$" % ("" if limit is None else limit))


def escape_formula(col: Column) -> Column:
    return F.when(F.substring(col, 1, 1).isin(*FORMULA_PREFIXES), F.concat(F.lit("'"), col)).otherwise(col)


def unique_items(col: Column) -> Column:
    """Trimmed non-blank items in first-seen order."""
    return F.array_distinct(F.filter(F.transform(col, strip), lambda item: item != ""))


def preview(col: Column, size: int) -> Column:
    return F.slice(col, 1, size)


def table_cell(col: Column) -> Column:
    """Cell text of a written table: NULL becomes an empty cell."""
    return F.coalesce(col.cast("string"), F.lit(""))
