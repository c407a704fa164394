"""The star-schema tables seen as cells, counts and runs, for the queries.

An order is a cell, its nation the dataset, its region the group, its customer the donor and
its priority the label; a line item is a count of a gene. Predictions of a made-up design
come from a hash of run and cell, so that every engine draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import harmonise, scoring
from gridloom.sources.tables import table

LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: (representation, share of wrong predictions in percent)
ARMS = [("rank", 20), ("pca", 32), ("token", 25)]
RUN = ["representation", "scheme", "holdout_group", "budget", "seed"]


def observed(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))


def index(spark: SparkSession, d: str) -> DataFrame:
    return harmonise.index(observed(spark, d), "n_name", "r_name", "o_custkey", "o_orderpriority", "o_orderkey")


def counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("value"))
    return harmonise.summed(rows)


def named_counts(spark: SparkSession, d: str) -> DataFrame:
    """counts with `dataset` and `mito`, the genes whose name begins with "hot" standing for mitochondrial ones."""
    genes = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.upper("p_name").startswith("HOT").alias("mito"))
    cells = observed(spark, d).select(F.col("o_orderkey").alias("cell"), F.col("n_name").alias("dataset"))
    return counts(spark, d).join(genes, "gene").join(cells, "cell")


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """(gene, token, median) of the genes a vocabulary knows: two of three."""
    parts = table(spark, d, "part").filter("p_partkey % 3 <> 0")
    return parts.select(F.col("p_partkey").alias("gene"), (F.col("p_partkey") + 10).alias("token"), F.col("p_retailprice").alias("median"))


def drawn(*parts: Column | str) -> Column:
    """A number below 2^32 from a hash of the parts."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(run, dataset, cell_id, y_true, y_pred) of 3 arms x 2 budgets x 2 seeds, split within datasets and by held-out group."""
    arms = F.array(*[F.struct(F.lit(a).alias("representation"), F.lit(w).alias("wrong")) for a, w in ARMS])
    cells = index(spark, d)
    nation = F.regexp_extract("dataset", r"(\d+)$", 1).cast("int")
    every = (
        cells.withColumn("arm", F.explode(arms))
        .withColumn("budget", F.explode(F.array(F.lit("10"), F.lit("all"))))
        .withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("scheme", F.explode(F.array(F.lit("S1_within_dataset"), F.lit("S3_leave_dataset_out"))))
    )
    tested = (F.col("scheme") != "S1_within_dataset") | (drawn("s1", F.col("seed"), F.col("cell_id")) % 5 == 0)
    level = F.col("arm.wrong") + F.when(F.col("budget") == "10", 15).otherwise(0) + nation % 7
    roll = drawn(F.col("arm.representation"), F.col("budget"), F.col("seed"), F.col("cell_id")) % 100
    turned = F.element_at(F.array(*map(F.lit, LABELS)), F.substring("label", 1, 1).cast("int") % 5 + 1)
    return every.filter(tested).select(
        F.col("arm.representation").alias("representation"),
        "scheme",
        F.when(F.col("scheme") == "S3_leave_dataset_out", F.col("group")).otherwise("").alias("holdout_group"),
        "budget",
        "seed",
        "dataset",
        "cell_id",
        F.col("label").alias("y_true"),
        F.when(roll < level, turned).otherwise(F.col("label")).alias("y_pred"),
    )


def train_classes(pred: DataFrame) -> DataFrame:
    """(run, label): all labels, but for one that a budget of 10 never saw."""
    labels = F.explode(F.array(*map(F.lit, LABELS))).alias("label")
    return pred.select(*RUN).distinct().select(*RUN, labels).filter("budget = 'all' OR label <> '5-LOW'")


def results(spark: SparkSession, d: str) -> DataFrame:
    """evaluate_per_dataset() of the predictions, with the split's file name."""
    pred = predictions(spark, d)
    scored = scoring.evaluate_per_dataset(pred, train_classes(pred), RUN)
    name = F.concat("scheme", F.lit("__seed"), F.col("seed").cast("string"), F.when(F.col("holdout_group") != "", F.concat(F.lit("__holdout-"), "holdout_group")).otherwise(""), F.lit(".parquet"))
    return scored.withColumn("split_file", name)
