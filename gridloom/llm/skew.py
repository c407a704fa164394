"""Joins and running totals that do not put a hot key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT = 200_000  #: rows of a key above which its rows are spread over several tasks
BUCKETS = 256  #: parts of a group that a running total is taken in


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, n: str = "n", hot: int = HOT, most: int | None = None) -> DataFrame:
    """rows joined to table, which has one row per key with the number of its rows in `n`.

    Keys of more than `hot` rows are split by a hash of `by`, and their row of the table is
    repeated once per part. There are at most rows / hot such keys, which bounds the list of
    them that is broadcast. `n` is not in the result. Where `most` bounds the rows of any key
    to no more than `hot`, there is nothing to split and a plain join does.
    """
    if most is not None and most <= hot:
        return rows.join(table.drop(n), key)
    parts = F.when(F.col(n) > hot, F.ceil(F.col(n) / hot)).otherwise(1).cast("int")
    hot_keys = table.filter(F.col(n) > hot).select(F.col(key).alias("_key"), parts.alias("_parts"))
    salted = (
        rows.join(F.broadcast(hot_keys), F.col(key) == F.col("_key"), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int"))
        .drop("_key", "_parts")
    )
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(n)
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def running_total(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """df with the sum of `value` over the rows before each one, per keys, in a fixed random order.

    Rows fall into BUCKETS by a hash of `order`, a unique column, so a group of any size is
    summed in many tasks; only the buckets' sums, BUCKETS rows a group, meet in one.
    """
    at = df.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(BUCKETS)).cast("int"))
    sums = at.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(F.xxhash64(order), order).rowsBetween(Window.unboundedPreceding, -1)
    own: Column = F.coalesce(F.sum(value).over(within), F.lit(0))
    return at.withColumn("_own", own).join(start, [*keys, "_bucket"]).withColumn(out, F.col("_start") + F.col("_own")).drop("_bucket", "_own", "_start")
