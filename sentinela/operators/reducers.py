"""Semi-join reducer: rows that a later join would drop are dropped where they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Positions of the bitmap: 512 KB, whatever the number of keys.
FILTER_BITS = 1 << 22
WORD = 64


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def key_bitmap(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> Column:
    """Which hash positions the keys occupy: a scalar subquery, an array of ``bits / 64`` words.

    Its size is fixed, so it can go to all tasks with the plan; there is no join to broadcast.
    Keys are reduced to words in each task before the shuffle.
    """
    place = _place(F.col(column), bits)
    words = keys.select(
        F.floor(place / WORD).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), (place % WORD).cast("int")).alias("mask"))
    every = keys.sparkSession.range(bits // WORD).select(
        F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    whole = words.unionByName(every).groupBy("word").agg(F.bit_or("mask").alias("mask")).agg(
        F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("words"))
    return whole.select(F.transform("words", lambda w: w["mask"]).alias("bitmap")).scalar()


def may_match(key: Column, bitmap: Column, bits: int = FILTER_BITS) -> Column:
    """True for every key of the bitmap, and for others whose hash position is occupied.

    With far more keys than positions nothing is filtered, which is slower but as right.
    """
    place = _place(key, bits)
    word = F.get(bitmap, F.floor(place / WORD).cast("int"))
    return F.call_function("shiftright", word, (place % WORD).cast("int")).bitwiseAND(1) == 1


def reduce_to(rows: DataFrame, key: Column, keys: DataFrame, column: str,
              bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose key may be among the keys: all that are, and few others."""
    return rows.where(may_match(key, key_bitmap(keys, column, bits), bits))
