"""Compute expensive columns exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(frame: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as the single output row of ``inline``.

    Catalyst substitutes plain projected expressions into every filter and projection above them.
    For nested array expressions that repeats the work many times over; the output of a generator
    is never substituted, so each column is evaluated once per row.
    """
    kept = [name for name in frame.columns if name not in columns]
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return frame.select(*kept, F.inline(F.array(row)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
