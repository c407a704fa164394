"""Quality control of sparse counts, label rules and gene sets.

Counts are rows (cell, gene, value); a pair that is not there counts zero, so every mean
over cells divides by the number of cells and never by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UnmappedLabelError(ValueError):
    """A label has no rule."""


class MissingRowsError(ValueError):
    """Rows that must be there are not."""


def summed(rows: DataFrame, cell: str = "cell", gene: str = "gene", value: str = "value") -> DataFrame:
    """One row per (cell, gene); values of repeated pairs are added up."""
    return rows.groupBy(cell, gene).agg(F.sum(value).alias(value))


def dims(rows: DataFrame) -> DataFrame:
    """(n_cells, n_genes) that the counts speak of."""
    return rows.agg(F.count_distinct("cell").alias("n_cells"), F.count_distinct("gene").alias("n_genes"))


def unique_names(genes: DataFrame, name: str = "name", key: str = "gene") -> DataFrame:
    """(key, name) with repeated names suffixed -1, -2, ... in key order; the first stays."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(name).orderBy(key)) - 1
    return genes.select(key, F.when(at > 0, F.concat(name, F.lit("-"), at.cast("string"))).otherwise(F.col(name)).alias(name))


def keep_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The counts of the given cells: a semi join, so the scan is filtered before anything is built."""
    return rows.join(cells.select("cell"), "cell", "left_semi")


def covered(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """rows joined to the index; MissingRowsError if a key of the index has none."""
    gone = index.select(key).join(rows.select(key), key, "left_anti").limit(5).collect()
    if gone:
        raise MissingRowsError(f"no row for {[r[0] for r in gone]}")
    return index.join(rows, key)


def harmonised(df: DataFrame, rules: DataFrame, strict: bool = True) -> DataFrame:
    """df with working_class, cl_term, action and reason of its label_raw.

    rules has one row per label_raw, working_class null where the label is dropped; it is a
    list kept by hand, and it is joined without a forced broadcast. A label without a rule
    raises UnmappedLabelError if strict, else its action is null. Null labels have no rule.
    """
    if strict:
        odd = df.select("label_raw").distinct().join(rules, "label_raw", "left_anti").limit(5).collect()
        if odd:
            raise UnmappedLabelError(f"no rule for {[r[0] for r in odd]}")
    return df.join(rules.select("label_raw", "working_class", "cl_term", "action", "reason"), "label_raw", "left")


def rule_table(maps: DataFrame, drops: DataFrame) -> DataFrame:
    """The rules as one table: the mapped labels, then the dropped ones, each by label."""
    a = maps.select("label_raw", "cl_term", "working_class", F.lit("map").alias("action"), F.lit("").alias("reason"))
    b = drops.select("label_raw", F.lit("").alias("cl_term"), F.lit("").alias("working_class"), F.lit("drop").alias("action"), "reason")
    return a.unionByName(b).orderBy(F.desc("action"), "label_raw")


def accounting(df: DataFrame, by: str = "dataset") -> DataFrame:
    """Rows per (by, label_raw, working_class), dropped ones with a null class included."""
    return df.groupBy(by, "label_raw", "working_class", "action").agg(F.count("*").alias("n_cells"))


def cell_metrics(rows: DataFrame, is_mito: Column) -> DataFrame:
    """(cell, n_genes, total, mito, pct_mito); the percentage is 0 for a cell without counts."""
    value = F.col("value")
    per = rows.groupBy("cell").agg(
        F.count_if(value > 0).alias("n_genes"), F.sum(value).alias("total"), F.sum(F.when(is_mito, value).otherwise(0.0)).alias("mito")
    )
    return per.withColumn("pct_mito", F.when(F.col("total") > 0, F.lit(100.0) * F.col("mito") / F.col("total")).otherwise(0.0))


def with_empty(metrics: DataFrame, cells: DataFrame) -> DataFrame:
    """metrics for every cell of `cells`; one without counts measures 0."""
    return cells.join(metrics, "cell", "left").fillna(0).fillna(0.0)


def passes(min_genes: int, max_pct: float) -> Column:
    return (F.col("n_genes") >= min_genes) & (F.col("pct_mito") <= max_pct)


def qc_counters(metrics: DataFrame, min_genes: int, max_pct: float, by: str = "dataset") -> DataFrame:
    """Per group: cells before, failed by each rule, exact medians, cells after."""
    return metrics.groupBy(by).agg(
        F.count("*").alias("cells_before"),
        F.count_if(F.col("n_genes") < min_genes).alias("failed_min_genes"),
        F.count_if(F.col("pct_mito") > max_pct).alias("failed_max_pct_mito"),
        F.median("n_genes").alias("median_genes_per_cell"),
        F.median("pct_mito").alias("median_pct_mito"),
        F.count_if(passes(min_genes, max_pct)).alias("cells_after"),
    )


def gene_filter(rows: DataFrame, min_cells: int) -> DataFrame:
    """(gene, n_cells) of the genes that at least min_cells cells have above zero."""
    return rows.groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n_cells")).filter(F.col("n_cells") >= min_cells)


def gene_sets(rows: DataFrame, by: str = "dataset") -> DataFrame:
    """(by, gene), distinct."""
    return rows.select(by, "gene").distinct()


def common_genes(sets: DataFrame, least: int, by: str = "dataset") -> DataFrame:
    """The genes that every group has; ValueError if fewer than `least` are left."""
    groups = sets.agg(F.count_distinct(by).alias("_all"))
    out = sets.groupBy("gene").agg(F.count("*").alias("_n")).join(F.broadcast(groups)).filter(F.col("_n") == F.col("_all")).select("gene")
    n = out.limit(least).count() if least else 0
    if n < least:
        raise ValueError(f"only {n} common genes; {least} are needed")
    return out


def gene_overlap(sets: DataFrame, by: str = "dataset") -> DataFrame:
    """(a, b, overlap) for all ordered pairs of groups: the share of a's genes that b has, 0 if none.

    The pairs are of groups (datasets), not of rows: each gene's list of groups is folded
    into counts, so the join is on the gene and the table has groups squared rows.
    """
    sizes = sets.groupBy(by).agg(F.count("*").alias("_size"))
    left, right = sets.select(F.col(by).alias("a"), "gene"), sets.select(F.col(by).alias("b"), "gene")
    shared = left.join(right, "gene").groupBy("a", "b").agg(F.count("*").alias("_n"))
    frame = sizes.select(F.col(by).alias("a"), "_size").join(F.broadcast(sizes.select(F.col(by).alias("b"))))
    return frame.join(shared, ["a", "b"], "left").select(
        "a", "b", (F.coalesce("_n", F.lit(0)) / F.greatest("_size", F.lit(1)).cast("double")).alias("overlap")
    )


def no_null_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """cols as strings; the words that a null turns into when it is written out raise."""
    for c in cols:
        text = F.col(c).cast("string")
        ok = text.isNotNull() & ~text.isin("None", "nan", "")
        df = df.withColumn(c, F.when(ok, text).otherwise(F.raise_error(F.lit(f"{c} is null or reads like one")).cast("string")))
    return df


def index(obs: DataFrame, dataset: str, group: str, donor: str, label: str, cell: str) -> DataFrame:
    """(cell_id, dataset, group, donor, label) from any table of cells; donors are qualified by dataset."""
    return obs.select(
        F.col(cell).cast("string").alias("cell_id"),
        F.col(dataset).alias("dataset"),
        F.col(group).alias("group"),
        F.concat_ws("|", F.col(dataset), F.col(donor).cast("string")).alias("donor"),
        F.col(label).alias("label"),
    )
