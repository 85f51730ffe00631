"""Equi-joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsieve.session import within_rows

ROWS_PER_TASK = 1_000_000
BROADCAST_ROWS = 20_000
BROADCAST_POINTS = 1_000_000


def small_side(df: DataFrame, weight=None, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` is proven small enough to broadcast (rows and summed weight)."""
    return within_rows(df, max_rows, weight, BROADCAST_POINTS if weight is not None else None)


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Every key with more rows than one task should take, and its salt count.

    There are fewer of them than there are tasks' worth of rows, as each holds
    more than one task's.
    """
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task)
        .select(*keys, F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int").alias("_salts"))
    )


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str,
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Inner equi-join; rows of ``left`` under a hot key are spread by ``spread``.

    The right rows of a hot key are repeated once per salt, all others once.
    """
    hot = hot_keys(left, keys, rows_per_task)
    hot = F.broadcast(hot) if small_side(hot) else hot
    lhs = left.join(hot, keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(F.col(spread)), F.col("_salts")).cast("int"), F.lit(0))
    ).drop("_salts")
    rhs = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return lhs.join(rhs, keys + ["_salt"]).drop("_salt")


def product_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str,
                 rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Inner equi-join with many rows on both sides of a key; dealt out by the number of rows that come out of a key.

    Rows of ``left`` are spread by ``spread`` over as many parts as the key's output has tasks' worth of rows, but no more
    than there are left rows; the right rows of such a key are repeated once for each part. Counts are of keys, not of rows.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    parts = F.least(F.col("_l"), F.ceil(F.col("_l") * F.col("_r") / F.lit(rows_per_task))).cast("int")
    hot = count(left, "_l").join(count(right, "_r"), keys).withColumn("_salts", parts).filter("_salts > 1").select(*keys, "_salts")
    lhs = lookup_join(left, hot, keys).withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(F.col(spread)), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    rhs = lookup_join(right, hot, keys).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return lhs.join(rhs, keys + ["_salt"]).drop("_salt")


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join to a lookup with one row per key, broadcast only after a size check.

    Past that size it is a plain shuffled join, where adaptive execution splits
    oversized partitions of the left side.
    """
    return left.join(F.broadcast(right) if small_side(right) else right, keys, how)
