"""Deterministic draws: rows are ordered by a hash of seed and key, so no random state is kept.

A draw is a row number per group, which the optimizer turns into a limit before the
shuffle. Groups that hold a large share of all rows therefore send a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, key: str) -> list[Column]:
    """Sort columns of a random order of the keys; the key itself breaks ties."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def drawn(df: DataFrame, by: list[str], seed: int, key: str, name: str = "rn") -> DataFrame:
    """df with each row's place in its group's random order, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*hash_order(seed, key))))


def label_budget(df: DataFrame, budget: int | None, seed: int, label: str = "label", key: str = "cell_id") -> DataFrame:
    """At most `budget` random rows per label, all of a label that has fewer; None keeps all.

    Null labels form one group of their own. The rows keep their columns.
    """
    if budget is None:
        return df
    if budget < 1:
        raise ValueError("a label budget is 1 or more, or None for all")
    return drawn(df, [label], seed, key, "_rn").filter(F.col("_rn") <= budget).drop("_rn")


def caps(counts: DataFrame, target: int, by: str, label: str, n: str = "n") -> DataFrame:
    """(by, cap): the smallest cap per label with at least `target` rows in all, null to keep all.

    With the labels ordered by count, a cap above the first i of them gives their sum plus
    the cap times the rest, so the cap is the ceiling of a quotient; no search is needed.
    counts holds one row per (by, label).
    """
    w = Window.partitionBy(by).orderBy(n, label)
    whole = Window.partitionBy(by)
    before = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1))
    steps = counts.select(
        by,
        F.col(n).alias("_n"),
        F.coalesce(before, F.lit(0)).alias("_before"),
        (F.count("*").over(whole) - F.row_number().over(w) + 1).alias("_left"),
        F.sum(n).over(whole).alias("_all"),
        (F.coalesce(F.lag(n).over(w), F.lit(0)) + 1).alias("_least"),
    )
    enough = F.col("_before") + F.col("_left") * F.col("_n") >= target
    cap = F.greatest(F.ceil((F.lit(target) - F.col("_before")) / F.col("_left")), F.col("_least")).cast("bigint")
    return steps.groupBy(by).agg(F.min(F.when((F.col("_all") > target) & enough, cap)).alias("cap"))


def capped(df: DataFrame, target: int, seed: int, by: str = "dataset", label: str = "label", key: str = "cell_id") -> DataFrame:
    """Rows of df, common labels of each `by` cut to the cap that leaves about `target` rows.

    Labels below the cap stay whole. The total may exceed the target by less than the
    number of labels. Rows with a null `by` are left out.
    """
    counts = df.filter(F.col(by).isNotNull()).groupBy(by, label).agg(F.count("*").alias("n"))
    cap = caps(counts, target, by, label)
    return (
        drawn(df, [by, label], seed, key, "_rn")
        .join(cap, by)
        .filter(F.col("cap").isNull() | (F.col("_rn") <= F.col("cap")))
        .drop("_rn", "cap")
    )


def cv_subsample(df: DataFrame, most: int, seed: int, label: str = "label", key: str = "cell_id") -> DataFrame:
    """About `most` rows, labels in proportion, at least two of each label that has two; all rows if fewer."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    share = F.greatest(
        F.bround(F.lit(float(most)) * F.col("_n") / F.col("_all")).cast("bigint"), F.least(F.col("_n"), F.lit(2))
    )
    take = counts.join(F.broadcast(total)).select(
        F.col(label).alias("_label"), F.when(F.col("_all") > most, share).otherwise(F.col("_n")).alias("_take")
    )
    return (
        drawn(df, [label], seed, key, "_rn")
        .join(take, F.col(label).eqNullSafe(F.col("_label")))
        .filter(F.col("_rn") <= F.col("_take"))
        .drop("_rn", "_label", "_take")
    )


def folds(df: DataFrame, most: int, seed: int, label: str = "label", key: str = "cell_id") -> DataFrame:
    """df with a stratified `fold` from 0; as many folds as the rarest label has rows, at most `most`."""
    k = df.groupBy(label).agg(F.count("*").alias("_n")).agg(F.least(F.min("_n"), F.lit(most)).alias("_k"))
    placed = drawn(df, [label], seed, key, "_rn").join(F.broadcast(k))
    return placed.withColumn("fold", F.pmod(F.col("_rn") - 1, F.col("_k")).cast("int")).drop("_rn", "_k")


def top_per_group(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order, which must be total."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")
