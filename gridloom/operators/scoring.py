"""Scores of predictions: pooled over a run, or within each dataset of a run.

Both start from counts per (run, dataset, true class, predicted class), made before any
shuffle by key, so the number of cells matters to the scan only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pred: DataFrame, by: list[str]) -> DataFrame:
    """(by, y_true, y_pred, n)."""
    return pred.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def per_class(conf: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, tp, n_true, n_pred, precision, recall, f1) of every class seen; no counts score 0."""
    hit = F.col("y_true") == F.col("y_pred")
    sides = conf.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("y_true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(hit, F.col("n")).otherwise(0).alias("h")),
                F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h")),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    c = sides.groupBy(*by, "label").agg(F.sum("h").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))
    part = lambda a, b: F.when(b > 0, a / b.cast("double")).otherwise(0.0)
    return c.select(
        *by,
        "label",
        "tp",
        "n_true",
        "n_pred",
        part(F.col("tp"), F.col("n_pred")).alias("precision"),
        part(F.col("tp"), F.col("n_true")).alias("recall"),
        part(2 * F.col("tp"), F.col("n_true") + F.col("n_pred")).alias("f1"),
    )


def _marked(conf: DataFrame, train_classes: DataFrame, by: list[str], run: list[str]) -> DataFrame:
    """conf with `learnable`: the true class is among its run's training classes."""
    known = train_classes.select(*run, F.col("label").alias("y_true"), F.lit(True).alias("learnable")).distinct()
    return conf.join(known, [*run, "y_true"], "left").fillna(False, ["learnable"])


def evaluate(pred: DataFrame, train_classes: DataFrame, run: list[str]) -> DataFrame:
    """One row per run, scored over all its rows.

    macro_f1 and balanced_acc are over the learnable classes (those in training and test)
    and only over rows whose true class is learnable: predictions of other rows are no false
    positives. They are null if no class is learnable. macro_f1_all_test_classes is over
    every class of the test rows, all rows counting.
    """
    conf = _marked(confusion(pred, run), train_classes, run, run)
    inner = per_class(conf.filter("learnable"), run).filter("n_true > 0")
    scored = inner.groupBy(*run).agg(
        F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_acc"), F.array_join(F.sort_array(F.collect_set("label")), ";").alias("classes_learnable")
    )
    return _whole(conf, run).join(scored, run, "left")


def evaluate_per_dataset(pred: DataFrame, train_classes: DataFrame, run: list[str], dataset: str = "dataset") -> DataFrame:
    """One row per (run, dataset) that has a learnable class, scored within the dataset.

    Here rows of other classes stay, so their predictions count as false positives.
    """
    by = [*run, dataset]
    conf = _marked(confusion(pred, by), train_classes, by, run)
    known = train_classes.select(*run, "label").distinct()
    inner = per_class(conf, by).filter("n_true > 0").join(known, [*run, "label"], "left_semi")
    return _whole(conf, by).join(inner.groupBy(*by).agg(F.avg("f1").alias("macro_f1")), by)


def _whole(conf: DataFrame, by: list[str]) -> DataFrame:
    """Counts, accuracy and the macro F1 over all test classes."""
    counts = conf.groupBy(*by).agg(
        F.sum("n").alias("n_test"),
        F.count_distinct(F.when(F.col("learnable"), F.col("y_true"))).alias("n_classes_learnable"),
        F.count_distinct(F.when(~F.col("learnable"), F.col("y_true"))).alias("n_classes_test_only"),
        (F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n").cast("double")).alias("accuracy"),
    )
    every = per_class(conf, by).filter("n_true > 0").groupBy(*by).agg(F.avg("f1").alias("macro_f1_all_test_classes"))
    return counts.join(every, by)


def class_rows(pred: DataFrame, train_classes: DataFrame, run: list[str], dataset: str = "dataset") -> DataFrame:
    """(run, dataset, cell_type, f1, counts, prevalence) of each learnable class of each dataset."""
    from pyspark.sql import Window

    by = [*run, dataset]
    known = train_classes.select(*run, "label").distinct()
    rows = per_class(confusion(pred, by), by).withColumn("_all", F.sum("n_true").over(Window.partitionBy(*by)))
    return rows.filter("n_true > 0").join(known, [*run, "label"], "left_semi").select(
        *by,
        F.col("label").alias("cell_type"),
        "f1",
        F.col("n_true").alias("n_test_cells_class"),
        (F.col("n_true") / F.col("_all").cast("double")).alias("class_prevalence"),
        F.col("_all").alias("n_test_cells_dataset"),
    )


def stratum(share: Column, rare: float = 0.01, uncommon: float = 0.05) -> Column:
    return F.when(share < rare, "rare").when(share < uncommon, "uncommon").otherwise("common")


def rarity(train: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, prevalence, stratum) by a class's share of the training rows."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"))
    share = F.col("n") / F.col("_all").cast("double")
    return counts.join(F.broadcast(whole)).select(label, "n", share.alias("prevalence"), stratum(share).alias("stratum"))


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): balanced weights, all rows over classes times the class's rows."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return counts.join(F.broadcast(whole)).select(label, "n", (F.col("_all") / (F.col("_k") * F.col("n")).cast("double")).alias("weight"))
