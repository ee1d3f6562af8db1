"""Numeric cells as Column expressions: NULL plus a separate validity flag, never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orthoflow.functions.text import is_blank, strip

# Accepted decimal text and the longest accepted integer text.
DECIMAL_PATTERN = (
    r"^[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)"
    r"(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$"
)
POSITIVE_INT_PATTERN = r"^0*[1-9][0-9]{0,17}$"


def decimal_value(text: Column) -> Column:
    """Double of already stripped text (may be infinite); NULL unless it is decimal text."""
    return F.when(text.rlike(DECIMAL_PATTERN), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def int_value(text: Column) -> Column:
    """Positive integer of already stripped text; NULL otherwise."""
    return F.when(text.rlike(POSITIVE_INT_PATTERN), text.try_cast("bigint"))


def finite(value: Column) -> Column:
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def parse_finite_double(col: Column) -> Column:
    """Finite double, or NULL for blank, malformed, NaN or infinite text."""
    return finite(decimal_value(strip(col)))


def finite_double_invalid(col: Column) -> Column:
    return ~is_blank(col) & parse_finite_double(col).isNull()


def constrain_probability(value: Column) -> Column:
    return F.when(value.between(0.0, 1.0), value)


def probability_invalid(value: Column) -> Column:
    return F.coalesce(~value.between(0.0, 1.0), F.lit(False))


def parse_positive_int(col: Column) -> Column:
    return int_value(strip(col))


def positive_int_invalid(col: Column) -> Column:
    return ~is_blank(col) & parse_positive_int(col).isNull()


def interval(start: Column, end: Column) -> Column:
    """Struct of both ends when both are known and ordered, else of two NULLs."""
    usable = start.isNotNull() & end.isNotNull() & (end >= start)
    return F.struct(F.when(usable, start).alias("domain_start"), F.when(usable, end).alias("domain_end"))


def domain_interval(raw_start: Column, raw_end: Column) -> Column:
    """Struct of (start, end): both ends or none, and end not before start."""
    return interval(parse_positive_int(raw_start), parse_positive_int(raw_end))


def domain_incomplete(raw_start: Column, raw_end: Column) -> Column:
    return parse_positive_int(raw_start).isNull() != parse_positive_int(raw_end).isNull()


def domain_reversed(raw_start: Column, raw_end: Column) -> Column:
    return F.coalesce(parse_positive_int(raw_end) < parse_positive_int(raw_start), F.lit(False))
