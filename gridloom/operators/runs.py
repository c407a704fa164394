"""The grid of runs: seeds per cell, what is done, what is pending, and what may be appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = ["representation", "split_file", "budget", "seed"]

#: The result table: every append has exactly these columns in this order.
T2 = T.StructType(
    [
        T.StructField(name, kind)
        for kind, names in (
            (T.StringType(), "representation split_file scheme holdout_group budget"),
            (T.IntegerType(), "seed"),
            (T.StringType(), "dataset"),
            (T.IntegerType(), "n_datasets_in_run n_train_used"),
            (T.DoubleType(), "C_selected"),
            (T.IntegerType(), "inner_cv_folds_used cv_selection_cells n_dims_selected"),
            (T.DoubleType(), "seconds pooled_macro_f1 pooled_macro_f1_all_test_classes"),
            (T.IntegerType(), "n_test n_classes_learnable n_classes_test_only"),
            (T.DoubleType(), "macro_f1 macro_f1_all_test_classes accuracy"),
        )
        for name in names.split()
    ]
)


class SchemaMismatch(RuntimeError):
    """Rows do not have the columns of the table they are for."""


def budget_text(c: Column) -> Column:
    """A budget as text: null, empty, nan and none are "all", whole numbers lose their fraction."""
    plain = F.trim(c.cast("string"))
    number = plain.try_cast("double")
    whole = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 9e15) & (number == F.floor(number).cast("double"))
    return (
        F.when(plain.isNull() | F.lower(plain).isin("", "nan", "none", "all"), "all").when(whole, number.cast("bigint").cast("string")).otherwise(plain)
    )


def seeds_for(run: dict, scheme: str, budget: int | str | None) -> list[int]:
    """The seeds of a (scheme, budget) cell.

    run has `seeds`, and may have `reduced_seeds` (budgets, n_seeds: the first n of the base
    list, 2 at least) and `extra_seeds` (schemes, budgets, seeds: added in those cells). A
    budget named by both raises.
    """
    text = lambda b: "all" if b is None else str(b)
    base, less, more = list(run["seeds"]), run.get("reduced_seeds") or {}, run.get("extra_seeds") or {}
    fewer, added = ({text(b) for b in x.get("budgets", [])} for x in (less, more))
    if less and fewer & added:
        raise ValueError(f"budgets {sorted(fewer & added)} are both reduced and extended")
    if text(budget) in fewer:
        if int(less["n_seeds"]) < 2:
            raise ValueError("n_seeds is 2 or more")
        return base[: int(less["n_seeds"])]
    if text(budget) in added and scheme in {str(s) for s in more.get("schemes", [])}:
        return base + [s for s in more["seeds"] if s not in base]
    return base


def grid(splits: DataFrame, representations: list[str], budgets: list[int | None], run: dict) -> DataFrame:
    """(representation, split_file, scheme, budget, seed) of every run of the design.

    splits has (split_file, scheme). The policy is a small table of its own, so the product
    is an equi-join on the scheme.
    """
    spark = splits.sparkSession
    schemes = [r[0] for r in splits.select("scheme").distinct().collect()]
    policy = [(s, r, "all" if b is None else str(b), x) for s in schemes for r in representations for b in budgets for x in seeds_for(run, s, b)]
    table = spark.createDataFrame(policy, "scheme string, representation string, budget string, seed int")
    return splits.select("split_file", "scheme").join(F.broadcast(table), "scheme").select("representation", "split_file", "scheme", "budget", "seed")


def _normal(df: DataFrame) -> DataFrame:
    return df.withColumn("budget", budget_text(F.col("budget"))).withColumn("seed", F.col("seed").cast("int"))


def complete(results: DataFrame) -> DataFrame:
    """The run keys that have a row for each dataset of the run."""
    per = _normal(results).groupBy(*RUN).agg(F.count_distinct("dataset").alias("n"), F.max("n_datasets_in_run").alias("need"))
    return per.filter("n >= need").select(*RUN)


def pending(design: DataFrame, results: DataFrame) -> DataFrame:
    """The runs of the design that no complete result has; partial ones run again."""
    return _normal(design).join(complete(results), RUN, "left_anti")


def shard(df: DataFrame, order: str, k: int, n: int) -> DataFrame:
    """Every n-th distinct value of `order`, from the k-th (0 first)."""
    named = df.select(order).distinct().withColumn("_rn", F.row_number().over(Window.orderBy(order)) - 1)
    return df.join(named.filter(F.pmod("_rn", F.lit(n)) == k).select(order), order, "left_semi")


def first_splits(splits: DataFrame, n: int) -> DataFrame:
    """The first n splits of each scheme by file name."""
    return splits.withColumn("_rn", F.row_number().over(Window.partitionBy("scheme").orderBy("split_file"))).filter(F.col("_rn") <= n).drop("_rn")


def split_name(c: Column) -> Column:
    """(scheme, seed, holdout_group) of a file name scheme__seedN[__holdout-G].parquet."""
    stem = F.regexp_replace(c, r"\.parquet$", "")
    return F.struct(
        F.split_part(stem, F.lit("__"), F.lit(1)).alias("scheme"),
        F.regexp_extract(stem, r"__seed(\d+)", 1).try_cast("int").alias("seed"),
        F.when(stem.contains("__holdout-"), F.split_part(stem, F.lit("__holdout-"), F.lit(2))).otherwise("").alias("holdout_group"),
    )


def merged(*shards: DataFrame) -> DataFrame:
    """Complete runs of all shards, one row per (run, dataset).

    Rows of runs that are nowhere complete are left out. A run that a shard left partial and
    another finished would otherwise have some rows twice; the row with the most test cells,
    then the greatest score, is kept.
    """
    every = None
    for s in shards:
        every = _normal(s) if every is None else every.unionByName(_normal(s))
    kept = every.join(complete(every), RUN, "left_semi")
    best = Window.partitionBy(*RUN, "dataset").orderBy(F.desc_nulls_last("n_test"), F.desc_nulls_last("macro_f1"), F.desc_nulls_last("seconds"))
    return kept.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")


def append(df: DataFrame, path: str, schema: T.StructType = T2) -> None:
    """Appends rows to a parquet table, or raises SchemaMismatch.

    The columns must be the schema's, in any order; what is already there must have the
    schema in its order.
    """
    have, want = set(df.columns), set(schema.names)
    if have != want or len(df.columns) != len(schema.names):
        raise SchemaMismatch(f"missing {sorted(want - have)}, unexpected {sorted(have - want)}")
    rows = df.select(*schema.names)
    wrong = [f.name for f, g in zip(rows.schema, schema, strict=True) if f.dataType != g.dataType]
    if wrong:
        raise SchemaMismatch(f"other types in {wrong}")
    there = existing(df.sparkSession, path)
    if there is not None and there.schema.names != schema.names:
        raise SchemaMismatch(f"{path} has the columns {there.schema.names}")
    rows.write.mode("append").parquet(path)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, None if there is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return spark.read.parquet(path)


def assembled(parts: DataFrame, wanted: DataFrame, key: str = "dataset") -> DataFrame:
    """The accounting rows of all wanted keys; a key without any raises."""
    gone = wanted.select(key).distinct().join(parts.select(key).distinct(), key, "left_anti").limit(5).collect()
    if gone:
        raise ValueError(f"no accounting for {[r[0] for r in gone]}")
    return parts.join(wanted.select(key).distinct(), key, "left_semi")


def run_settings(t2: DataFrame) -> DataFrame:
    """(run, C_selected, n_dims_selected), one row per run; the values do not differ within a run."""
    return t2.groupBy(*RUN).agg(F.min("C_selected").alias("C_selected"), F.min("n_dims_selected").alias("n_dims_selected"))


def reconstruction(refit: DataFrame, recorded: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Refitted scores against recorded ones: (run, dataset, recorded, refit, status).

    status is ok, failed (further apart than the tolerance) or unrecorded.
    """
    key = [*RUN, "dataset"]
    old = recorded.select(*key, F.col("macro_f1").alias("recorded"))
    both = refit.select(*key, F.col("macro_f1").alias("refit")).join(old, key, "left")
    off = F.abs(F.col("recorded") - F.col("refit")) > tolerance
    return both.withColumn("status", F.when(F.col("recorded").isNull(), "unrecorded").when(off, "failed").otherwise("ok"))


def representation(rows: DataFrame, name: str, split: str | None) -> DataFrame:
    """(cell_id, emb) of a representation: the split's own rows if it has any, else the global ones.

    A representation that is fitted per split has no global rows; asking it for a split it
    was not fitted on raises, as rows of several fits must not be mixed.
    """
    mine = rows.filter(F.col("representation") == name)
    own = mine.filter(F.col("split_id") == split) if split is not None else mine.limit(0)
    if split is not None and own.limit(1).count():
        return own.select("cell_id", "emb")
    whole = mine.filter("split_id IS NULL")
    if not whole.limit(1).count():
        raise ValueError(f"{name} has no rows for split {split!r} and none that hold for all splits")
    return whole.select("cell_id", "emb")
