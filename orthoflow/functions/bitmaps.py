"""Bitmaps in pieces of 32,768 bits, as Spark's aggregate builds them, and a filter of fixed size over hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 32_768
#: Bits of a hash filter: 4,096 pieces of 4 KB, so 16 MB however many hashes it holds.
FILTER_BITS = 1 << 27


def piece_of(place: Column) -> Column:
    return F.floor(place / PIECE).cast("int")


def bit_is_set(piece: Column, place: Column) -> Column:
    """Whether bit ``place`` of a piece is set; a missing piece has no bits."""
    byte = F.conv(F.hex(F.substr(piece, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def hash_filter(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """(piece, bitmap): a Bloom filter with one bit per hash, at most ``bits`` / 32,768 rows of 4 KB."""
    place = F.pmod(F.col(column), F.lit(bits))
    return hashes.select(piece_of(place).alias("piece"), (place % PIECE).alias("place")).groupBy("piece").agg(F.bitmap_construct_agg("place").alias("bitmap"))


def passing(rows: DataFrame, column: str, made: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose hash may be in the filter, without a shuffle: the filter's size is fixed, so it is broadcast."""
    place = F.pmod(F.col(column), F.lit(bits))
    joined = rows.join(F.broadcast(made.withColumnsRenamed({"piece": "_piece", "bitmap": "_bitmap"})), piece_of(place) == F.col("_piece"))
    return joined.filter(bit_is_set(F.col("_bitmap"), place % PIECE)).drop("_piece", "_bitmap")
