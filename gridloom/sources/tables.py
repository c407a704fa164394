"""Table scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], by: str, cols: list[str]) -> DataFrame:
    """One row per key: the one with the greatest `by`, nulls first, then the greatest columns.

    A partial aggregate runs before the shuffle, so a record delivered many times
    crosses the network about once per map task. Columns come out as keys + cols.
    """
    kept = [c for c in cols if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(by).alias("_by"), *kept)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in kept])


def blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"[\s ]+", " ")) == "", F.lit(True))
