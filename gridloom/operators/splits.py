"""Train, calibration and test splits, with guards that stop a leaking one."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.sampling import drawn, hash_order

PARTS = ("train", "calibration", "test")
FRACTIONS = {"train": 0.6, "calibration": 0.2, "test": 0.2}
S1, S2, S3 = "S1_within_dataset", "S2_leave_donor_out", "S3_leave_dataset_out"
INDEX = ("cell_id", "dataset", "group", "donor", "label")


class LeakageError(AssertionError):
    """A split breaks a leakage rule."""


@dataclass(frozen=True)
class Split:
    scheme: str
    seed: int
    holdout: str | None = None


def check_index(index: DataFrame) -> DataFrame:
    """index if it has the required columns, unique ids and no null label; else ValueError."""
    missing = [c for c in INDEX if c not in index.columns]
    if missing:
        raise ValueError(f"the index lacks {missing}")
    if index.filter("label IS NULL").limit(1).count():
        raise ValueError("the index has null labels; drop them and count them before a split is made")
    if index.groupBy("cell_id").count().filter("count > 1").limit(1).count():
        raise ValueError("the index has a cell_id more than once")
    return index


def s1(index: DataFrame, seed: int, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """(cell_id, partition): a random split of each (dataset, label).

    Groups under three rows go to train; larger ones leave at least two rows for the others.
    """
    by = Window.partitionBy("dataset", "label")
    n = F.count("*").over(by)
    part = drawn(index.select("cell_id", "dataset", "label"), ["dataset", "label"], seed, "cell_id").withColumn("n", n)
    train = F.when(F.col("n") >= 3, F.least(F.bround(F.lit(fractions["train"]) * F.col("n")), F.col("n") - 2)).otherwise(F.col("n"))
    calibration = F.bround(F.lit(fractions["calibration"]) * F.col("n"))
    return part.select(
        "cell_id",
        F.when(F.col("rn") <= train, "train").when(F.col("rn") <= train + calibration, "calibration").otherwise("test").alias("partition"),
    )


def _small(n: int, shares: list[float]) -> list[int]:
    """How many of a few units each partition gets; where all can't have their floor, the largest gives way."""
    got = [max(1, math.floor(f * n)) for f in shares]
    for _ in range(sum(got) - n):
        got[got.index(max(got))] -= 1
    return [n - sum(got[1:]), *got[1:]]


def _counts(n: Column, fractions: dict[str, float]) -> list[Column]:
    """How many of n units each wanted partition gets: floors, one at least, the rest to the first.

    From `few` units on every floor is at least one; below it the counts are listed, which
    keeps the expression small.
    """
    shares = [fractions[p] for p in PARTS if fractions.get(p, 0) > 0]
    few = math.ceil(1 / min(shares))
    listed = [_small(k, shares) if k >= len(shares) else [0] * len(shares) for k in range(few + 1)]
    rest = [
        F.when(n <= few, F.element_at(F.array(*[F.lit(row[i]) for row in listed]), n.cast("int") + 1)).otherwise(F.floor(F.lit(f) * n).cast("int"))
        for i, f in enumerate(shares)
    ][1:]
    return [n - sum(rest[1:], rest[0]) if rest else n, *rest]


def allocate(units: DataFrame, scope: list[str], unit: str, seed: int, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """(scope, unit, partition): whole units dealt out within each scope.

    units holds one row per (scope, unit). A scope with fewer units than partitions raises
    when the plan runs, as no unit may be cut.
    """
    wanted = [p for p in PARTS if fractions.get(p, 0) > 0]
    by = Window.partitionBy(*scope)
    rank = F.row_number().over(by.orderBy(*hash_order(seed, unit)))
    placed = units.select(*scope, unit, rank.alias("_rn"), F.count("*").over(by).alias("_n"))
    part, upto = None, F.lit(0)
    for p, c in zip(wanted, _counts(F.col("_n"), fractions), strict=True):
        upto = upto + c
        part = F.when(F.col("_rn") <= upto, p) if part is None else part.when(F.col("_rn") <= upto, p)
    few = F.raise_error(F.lit(f"fewer units than the {len(wanted)} partitions")).cast("string")
    return placed.select(*scope, unit, F.when(F.col("_n") < len(wanted), few).otherwise(part).alias("partition"))


def s2(index: DataFrame, seed: int, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """(cell_id, partition): whole donors, dealt out within each dataset."""
    donors = allocate(index.select("dataset", "donor").distinct(), ["dataset"], "donor", seed, fractions)
    return index.select("cell_id", "dataset", "donor").join(donors, ["dataset", "donor"]).select("cell_id", "partition")


def s3(index: DataFrame, seed: int, holdout: str | None = None, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """(cell_id, partition): whole groups; a named group is the test set and the others share the rest."""
    groups = index.select("group").distinct()
    if holdout is None:
        placed = allocate(groups.withColumn("_all", F.lit(1)), ["_all"], "group", seed, fractions).drop("_all")
    else:
        if not groups.filter(F.col("group") == holdout).limit(1).count():
            raise ValueError(f"no group {holdout!r}")
        whole = fractions["train"] + fractions["calibration"]
        rest = {"train": fractions["train"] / whole, "calibration": fractions["calibration"] / whole}
        others = groups.filter(F.col("group") != holdout).withColumn("_all", F.lit(1))
        placed = allocate(others, ["_all"], "group", seed, rest).drop("_all")
        placed = placed.unionByName(groups.filter(F.col("group") == holdout).withColumn("partition", F.lit("test")))
    return index.select("cell_id", "group").join(placed, "group").select("cell_id", "partition")


def make(index: DataFrame, split: Split, fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """(cell_id, partition) of a split."""
    if split.scheme == S1:
        return s1(index, split.seed, fractions)
    if split.scheme == S2:
        return s2(index, split.seed, fractions)
    if split.scheme == S3:
        return s3(index, split.seed, split.holdout, fractions)
    raise ValueError(f"no scheme {split.scheme!r}")


def many(index: DataFrame, splits: list[Split], fractions: dict[str, float] = FRACTIONS) -> DataFrame:
    """(scheme, seed, holdout_group, cell_id, partition) of several splits, "" for no holdout."""
    out = None
    for s in splits:
        one = make(index, s, fractions).select(
            F.lit(s.scheme).alias("scheme"), F.lit(s.seed).alias("seed"), F.lit(s.holdout or "").alias("holdout_group"), "cell_id", "partition"
        )
        out = one if out is None else out.unionByName(one)
    return out


def store(splits: DataFrame, path: str) -> None:
    """Writes many()'s rows, a folder per split; a run replaces the splits it holds and no others."""
    splits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scheme", "seed", "holdout_group").parquet(path)


def manifest(index: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per split: rows, classes and datasets of each partition, learnable and test-only classes."""
    rows = splits.join(index.select("cell_id", "dataset", "label"), "cell_id")
    aggs = []
    for p in PARTS:
        at = F.col("partition") == p
        aggs += [
            F.count_if(at).alias(f"n_{p}"),
            F.collect_set(F.when(at, F.col("label"))).alias(f"_l_{p}"),
            F.collect_set(F.when(at, F.col("dataset"))).alias(f"_d_{p}"),
        ]
    one = rows.groupBy("scheme", "seed", "holdout_group").agg(*aggs)
    size = lambda c: F.size(c).cast("bigint")
    return one.select(
        "scheme",
        "seed",
        "holdout_group",
        *[c for p in PARTS for c in (F.col(f"n_{p}"), size(f"_l_{p}").alias(f"classes_{p}"), size(f"_d_{p}").alias(f"datasets_{p}"))],
        size(F.array_intersect("_l_train", "_l_test")).alias("classes_learnable"),
        size(F.array_except("_l_test", "_l_train")).alias("classes_test_only"),
    )


def audit(index: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per split: how many units span partitions, cells without one and empty partitions.

    Donors count under S2 and S3 and groups under S3, else 0. A clean split has only zeros.
    """
    key = ["scheme", "seed", "holdout_group"]
    rows = splits.join(index.select("cell_id", "donor", "group"), "cell_id")
    total = index.agg(F.count("*").alias("_total"))
    ends = [F.min("partition").alias("a"), F.max("partition").alias("b")]
    seen = [F.max((F.col("partition") == p).cast("int")).alias(p) for p in PARTS]
    donors = rows.groupBy(*key, "donor").agg(*ends, *seen, F.count("*").alias("n"))
    groups = rows.groupBy(*key, "group").agg(*ends)
    spans = lambda schemes: F.count_if((F.col("a") != F.col("b")) & F.col("scheme").isin(schemes))
    of_donors = donors.groupBy(*key).agg(
        F.sum("n").alias("_n"), spans([S2, S3]).alias("donors_spanning"), (F.lit(3) - sum([F.max(p) for p in PARTS[1:]], F.max(PARTS[0]))).cast("bigint").alias("partitions_empty")
    )
    out = of_donors.join(groups.groupBy(*key).agg(spans([S3]).alias("groups_spanning")), key).join(F.broadcast(total))
    return out.select(*key, (F.col("_total") - F.col("_n")).alias("cells_unassigned"), "partitions_empty", "donors_spanning", "groups_spanning")


def guard(index: DataFrame, splits: DataFrame) -> DataFrame:
    """splits if audit() finds nothing; else LeakageError."""
    bad = audit(index, splits).filter("donors_spanning + groups_spanning + cells_unassigned + partitions_empty > 0").limit(5).collect()
    if bad:
        raise LeakageError("; ".join(str(r.asDict()) for r in bad))
    return splits


def read_parts(splits: DataFrame, parts: list[str]) -> DataFrame:
    """The rows of some partitions; the calibration partition is reserved and raises."""
    if "calibration" in parts:
        raise LeakageError("the calibration partition is reserved")
    return splits.filter(F.col("partition").isin(parts))


def aligned(index: DataFrame, split: DataFrame) -> DataFrame:
    """(cell_id, side) of cells that only the index or only the split has; empty if both agree."""
    a = index.select("cell_id", F.lit(1).alias("a"))
    b = split.select("cell_id", F.lit(1).alias("b"))
    both = a.join(b, "cell_id", "full_outer").filter("a IS NULL OR b IS NULL")
    return both.select("cell_id", F.when(F.col("a").isNull(), "split").otherwise("index").alias("side"))
