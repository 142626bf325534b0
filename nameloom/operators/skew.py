"""Joins that stay even when one key holds a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task takes easily; a key with more is split into parts of about so many.
HOT_FLOOR = 50_000
#: Where this share of all rows is more than HOT_FLOOR it takes its place, so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 0.00001


def hot_keys(df: DataFrame, key: str, total: int, share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> DataFrame:
    """(key, _parts): the keys with more than max(total * share, floor) rows, at most 1/share whatever the data, and the parts of about that size.

    The count is combined before its shuffle. Null keys never join and are left out.
    """
    part = max(total * share, floor)
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part)
    return counted.select(key, F.ceil(F.col("_n") / part).cast("long").alias("_parts"))


def salted_join(left: DataFrame, right: DataFrame, key: str, total: int, spread: Column, how: str = "inner", salts: int | None = None, share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> DataFrame:
    """left join right on `key`, where `left` may hold any share of its rows in one key and `right` has one row, or few, a key.

    Rows of a hot key go to parts by `spread` (a hash of something that differs
    within the key), as many as its own rows ask for (or `salts`); right's row of that key is
    copied as often. The list of hot keys is bounded by 1/share and is the only
    thing broadcast; the join itself is a merge, as the planner's estimate of an
    exploded side is no proof of its size. total: the rows of left, or more. left is
    counted by key first, so a costly one should be a written table. `how` is inner, left or left_semi. Null keys match nothing.
    """
    if total <= floor:  # no key can have more rows
        return left.join(right.hint("merge"), key, how)
    hot = hot_keys(left, key, total, share, floor)
    hot = F.broadcast(hot if salts is None else hot.withColumn("_parts", F.lit(salts).cast("long")))
    none = F.lit(0).cast("long")
    lhs = left.join(hot, key, "left").withColumn("_salt", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_parts"))).otherwise(none)).drop("_parts")
    rhs = right.join(hot, key, "left")
    rhs = rhs.withColumn("_salt", F.explode(F.when(F.col("_parts").isNotNull(), F.sequence(none, F.col("_parts") - 1)).otherwise(F.array(none)))).drop("_parts")
    return lhs.join(rhs.hint("merge"), [key, "_salt"], how).drop("_salt")
