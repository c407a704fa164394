"""Paired statistics over datasets: seeds are averaged first, the dataset is the unit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["dataset", "representation", "scheme", "budget"]


def aggregate_seeds(t2: DataFrame, metric: str) -> DataFrame:
    """(dataset, representation, scheme, budget, metric, metric_resample_sd, n_runs).

    The sd is the sample's, null for one run; runs without the metric are not counted. A
    missing dataset column or a null in it raises, as another unit would fake independence.
    """
    if "dataset" not in t2.columns:
        raise ValueError("no dataset column: the dataset is the unit of replication")
    guarded = t2.withColumn("dataset", F.coalesce("dataset", F.raise_error(F.lit("a null dataset can't be aggregated")).cast("string")))
    return guarded.groupBy(*CELL).agg(
        F.avg(metric).alias(metric), F.stddev_samp(metric).alias(f"{metric}_resample_sd"), F.count(metric).alias("n_runs")
    )


def pairs(agg: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """(scheme, budget, dataset, va, vb, d) of the datasets that have both arms."""
    value = lambda arm: F.avg(F.when(F.col("representation") == arm, F.col(metric)))
    wide = agg.groupBy("scheme", "budget", "dataset").agg(value(a).alias("va"), value(b).alias("vb"))
    return wide.dropna(subset=["va", "vb"]).withColumn("d", F.round(F.col("va") - F.col("vb"), 12))


def draws(n: Column, times: int, seed: int) -> Column:
    """An array of `times` arrays of n places (from 0), drawn with replacement by a hash of draw, place and seed."""

    def place(b: Column, j: Column) -> Column:
        h = F.md5(F.concat_ws("|", b.cast("string"), j.cast("string"), F.lit(str(seed))))
        return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), n)

    return F.transform(F.sequence(F.lit(1), F.lit(times)), lambda b: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda j: place(b, j)))


def bootstrap(values: DataFrame, by: list[str], order: str, value: str, times: int, seed: int = 0) -> DataFrame:
    """(by, n, lo, hi): the 95 % percentile interval of the mean; null for groups under two values.

    Values are taken in the order of `order`. Groups are of datasets, hence short; NaN and
    null values are left out.
    """
    sane = values.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    lists = sane.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_v"))
    means = lists.select(*by, F.size("_v").cast("bigint").alias("n"), "_v").withColumn("_b", F.explode(draws(F.col("n"), times, seed)))
    total = F.aggregate("_b", F.lit(0.0), lambda acc, i: acc + F.get("_v", i.cast("int"))[value])
    each = means.select(*by, "n", (total / F.col("n")).alias("_m"))
    ends = each.groupBy(*by, "n").agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_p"))
    return ends.select(*by, "n", *[F.when(F.col("n") >= 2, F.col("_p")[i]).alias(x) for i, x in ((0, "lo"), (1, "hi"))])


def contrast(paired: DataFrame) -> DataFrame:
    """(scheme, budget, n_datasets, delta_mean, delta_median, cohens_dz, n_datasets_favouring_a, datasets, t_stat).

    dz and t are null where all differences are equal; cells under three datasets have no row.
    """
    sd = F.stddev_samp("d")
    out = paired.groupBy("scheme", "budget").agg(
        F.count("*").alias("n_datasets"),
        F.avg("d").alias("delta_mean"),
        F.median("d").alias("delta_median"),
        F.when(sd > 0, F.avg("d") / sd).alias("cohens_dz"),
        F.count_if(F.col("d") > 0).alias("n_datasets_favouring_a"),
        F.array_join(F.sort_array(F.collect_list("dataset")), ";").alias("datasets"),
        F.when(sd > 0, F.avg("d") / (sd / F.sqrt(F.count("*")))).alias("t_stat"),
    )
    return out.filter("n_datasets >= 3")


def run_range(agg: DataFrame) -> DataFrame:
    """(scheme, budget, representation, n_runs): "lo-hi" of the runs behind an arm, or one number."""
    lo, hi = F.min("n_runs"), F.max("n_runs")
    text = F.when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string")))
    return agg.groupBy("scheme", "budget", "representation").agg(text.alias("n_runs"))


def signed_rank(paired: DataFrame) -> DataFrame:
    """(scheme, budget, n_nonzero, w_plus, w_minus, wilcoxon_stat) of the differences; zeros are left out.

    Equal sizes share their mean rank. A cell without any difference has no row.
    """
    w = Window.partitionBy("scheme", "budget").orderBy("_size")
    same = Window.partitionBy("scheme", "budget", "_size")
    sized = paired.filter("d <> 0").withColumn("_size", F.abs("d"))
    ranked = sized.withColumn("_rank", F.rank().over(w) + (F.count("*").over(same) - 1) / F.lit(2.0))
    sides = ranked.groupBy("scheme", "budget").agg(
        F.count("*").alias("n_nonzero"),
        F.sum(F.when(F.col("d") > 0, F.col("_rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("_rank")).otherwise(0.0)).alias("w_minus"),
    )
    return sides.withColumn("wilcoxon_stat", F.least("w_plus", "w_minus"))


def signed_rank_p(ranks: np.ndarray, w: float) -> float:
    """Two-sided p of a signed-rank statistic.

    Up to 50 untied ranks exactly, by counting the sign patterns of each sum; else by the
    normal approximation with the correction for ties.
    """
    n = len(ranks)
    if n == 0:
        return 1.0
    if n <= 50 and len(np.unique(ranks)) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / ways.sum()))
    _, ties = np.unique(ranks, return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    z = (w - n * (n + 1) / 4) / math.sqrt(var) if var > 0 else 0.0
    return float(min(1.0, math.erfc(abs(z) / math.sqrt(2))))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def t_p(t: float, df: int) -> float:
    """Two-sided p of Student's t."""
    if df < 1 or t != t:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def p_values(paired: DataFrame) -> DataFrame:
    """(scheme, budget, p_raw, ttest_p): signed-rank and t test of the differences, a group per cell of the design."""

    def test(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d = rows["d"].to_numpy()
        nz = d[d != 0]
        ranks = pd.Series(np.abs(nz)).rank().to_numpy()
        w = min(ranks[nz > 0].sum(), ranks[nz < 0].sum()) if len(nz) else 0.0
        sd = d.std(ddof=1) if len(d) > 1 else 0.0
        t = d.mean() / (sd / math.sqrt(len(d))) if sd > 0 else float("nan")
        return pd.DataFrame({"scheme": [key[0]], "budget": [key[1]], "p_raw": [signed_rank_p(ranks, w)], "ttest_p": [t_p(t, len(d) - 1)]})

    return paired.select("scheme", "budget", "d").groupBy("scheme", "budget").applyInPandas(
        test, "scheme string, budget string, p_raw double, ttest_p double"
    )


def bh(tests: DataFrame, p: str, order: list[str], out: str = "p_fdr") -> DataFrame:
    """tests with Benjamini-Hochberg adjusted p over the whole family; null p stay null and do not count.

    The family is a table of contrasts, at most thousands of rows, so one global window is right.
    """
    ok = F.col(p).isNotNull()
    m = F.count(p).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col(p).asc_nulls_last(), *order))
    raised = tests.withColumn("_q", F.when(ok, F.col(p) * m / rank)).withColumn("_rank", rank)
    least = F.min("_q").over(Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0))
    return raised.withColumn(out, F.when(ok, F.least(least, F.lit(1.0)))).drop("_q", "_rank")


def verdict(p_fdr: Column, delta: Column, negligible: float = 0.02, alpha: float = 0.05) -> Column:
    """What a contrast says; a null p detects nothing."""
    return (
        F.when(~F.coalesce(p_fdr < alpha, F.lit(False)), "no detectable difference")
        .when(F.abs(delta) < negligible, f"detectable but negligible (|delta| < {negligible})")
        .when(delta > 0, "a better")
        .otherwise("b better")
    )


def overlap_correlation(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """(n, pearson, spearman, y_at_min_x, y_at_max_x): ranks are mean ranks, ends by smallest key."""
    mean_rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / F.lit(2.0)
    rows = df.select(key, x, y, mean_rank(x).alias("_rx"), mean_rank(y).alias("_ry"))
    return rows.agg(
        F.count("*").alias("n"),
        F.corr(x, y).alias("pearson"),
        F.corr("_rx", "_ry").alias("spearman"),
        F.min_by(y, F.struct(x, key)).alias("y_at_min_x"),
        F.max_by(y, F.struct(x, key)).alias("y_at_max_x"),
    )


def budget_table(t2: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """(scheme, representation, budget, mean): units are averaged first, a unit being the holdout or the split."""
    unit = F.when(F.coalesce(F.length("holdout_group"), F.lit(0)) > 0, F.col("holdout_group")).otherwise(F.col("split_file"))
    per = t2.withColumn("unit", unit).groupBy("scheme", "representation", "budget", "unit").agg(F.avg(metric).alias("_m"))
    return per.groupBy("scheme", "representation", "budget").agg(F.avg("_m").alias("mean"), F.count("*").alias("n_units"))


def budget_order(budget: Column) -> Column:
    """Sort key of budgets as they are shown: by number, then "all"."""
    return F.coalesce(budget.try_cast("int"), F.lit(2**31 - 1))


def transfer_matrix(t2: DataFrame, representations: list[str], scheme: str, metric: str = "macro_f1") -> DataFrame:
    """(holdout_group, one column per representation): mean score of each held-out group."""
    held = t2.filter((F.col("scheme") == scheme) & (F.coalesce(F.length("holdout_group"), F.lit(0)) > 0))
    return held.groupBy("holdout_group").pivot("representation", representations).agg(F.avg(metric))
