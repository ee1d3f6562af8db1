"""Give rows what is known of their group, whatever the sizes of the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import unused

#: A group is hot above this share of the rows counted in ``groups``, so at most its inverse are hot.
HOT_SHARE = 1 / 1000


def group_key(column: str) -> Column:
    """A string that is equal for equal values; nulls are equal among themselves."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(column).cast("string")))


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column) -> DataFrame:
    """``rows`` left-joined by ``key`` to ``groups``, which has one row per key and the group's ``size``.

    Hot groups, 1,000 at most by their definition, are broadcast; their rows then carry a key that no group
    has, dealt by ``spread``, so the join of the others meets no hot key. Both sides' other columns stay;
    ``size`` is dropped. ``groups`` should be a written table: it is read three times.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot_size = F.col(size) > F.lit(total * HOT_SHARE)
    values = [c for c in groups.columns if c not in (key, size)]
    hot, cold = unused(rows, "_hot"), unused(rows, "_cold")

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(F.col(key).alias(name), F.struct(*values).alias(f"{name}_values"))

    first = rows.join(F.broadcast(side(groups.filter(hot_size), hot)), F.col(key) == F.col(hot), "left")
    dealt = F.when(F.col(hot).isNull(), F.col(key)).otherwise(F.concat(F.lit("h"), spread.cast("string")))
    slot = unused(rows, "_slot")
    both = first.withColumn(slot, dealt).join(side(groups.filter(~hot_size), cold), F.col(slot) == F.col(cold), "left")
    found = F.coalesce(f"{hot}_values", f"{cold}_values")
    return both.select(*[c for c in rows.columns if c not in values], *[found[v].alias(v) for v in values])
