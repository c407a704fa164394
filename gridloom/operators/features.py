"""Features of sparse counts and dense vectors, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import let


def log_norm(rows: DataFrame, target: float = 1e4) -> DataFrame:
    """(cell, gene, value): log1p of the value scaled to `target` per cell; an empty cell stays empty.

    Input that is logarithmic already is logged once more, as nothing tells the two apart.
    """
    total = F.sum("value").over(Window.partitionBy("cell"))
    scaled = F.when(total > 0, F.log1p(F.col("value") * target / total)).otherwise(0.0)
    return rows.select("cell", "gene", scaled.alias("value"))


def pseudo_counts(rows: DataFrame) -> DataFrame:
    """(cell, gene, value): rounded expm1, half to even; zeros are left out."""
    return rows.select("cell", "gene", F.rint(F.expm1("value")).alias("value")).filter(F.col("value") != 0)


def gene_moments(rows: DataFrame, n_cells: int | Column) -> DataFrame:
    """(gene, mean, variance, dispersion) over n_cells cells, absent ones counting zero.

    The variance is the sample's and at least 0; the dispersion of a zero mean is 0.
    """
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    sums = rows.groupBy("gene").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    mean = F.col("_s") / n
    spread = F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0)) * n / F.greatest(n - 1, F.lit(1))
    return sums.select("gene", mean.alias("mean"), spread.alias("variance")).withColumn(
        "dispersion", F.when(F.col("mean") > 0, F.col("variance") / F.col("mean")).otherwise(0.0)
    )


def variable_genes(rows: DataFrame, n_cells: int, top: int, bins: int = 20, digits: int = 9) -> DataFrame:
    """(gene, bin, score) of the `top` genes most variable for their mean, best first by score then gene.

    Genes with a positive mean are cut into `bins` by quantiles of the mean and scored by
    their dispersion's distance from the bin's mean in population standard deviations, 0 if
    those are 0. With `bins` genes or fewer all are in one bin. Scores are rounded to
    `digits` before they are ranked, so that equal ones tie. Rows are of training cells only.
    """
    genes = gene_moments(rows, n_cells).filter("mean > 0")
    edges = genes.agg(
        F.percentile("mean", F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("_edges"), F.count("*").alias("_genes")
    )
    below = F.size(F.filter("_edges", lambda e: F.round(e, 12) <= F.round(F.col("mean"), 12))) - 1
    bin_of = F.when(F.col("_genes") > bins, F.greatest(F.least(below, F.lit(bins - 1)), F.lit(0))).otherwise(0)
    w = Window.partitionBy("bin")
    sd = F.stddev_pop("dispersion").over(w)
    score = F.when(sd > 0, (F.col("dispersion") - F.avg("dispersion").over(w)) / sd).otherwise(0.0)
    scored = genes.join(F.broadcast(edges)).withColumn("bin", bin_of.cast("int")).select("gene", "bin", F.round(score, digits).alias("score"))
    return scored.orderBy(F.desc("score"), "gene").limit(top)


def rank_encode(rows: DataFrame, dictionary: DataFrame, length: int, digits: int = 9) -> DataFrame:
    """(cell, tokens): each cell's tokens by falling value per cell total and gene median, at most `length`.

    dictionary has (gene, token, median); genes that are missing or have a median of 0 or
    less are skipped before totals are taken. Ties go by gene. A cell whose counts are all
    zero has no row. Only the first `length` values of a cell reach the collection.
    """
    usable = dictionary.filter("median > 0 AND token IS NOT NULL")
    known = rows.filter("value > 0").join(usable, "gene")
    total = F.sum("value").over(Window.partitionBy("cell"))
    norm = F.round(F.col("value") / total * 1e4 / F.col("median"), digits)
    valued = known.select("cell", "gene", "token", norm.alias("_norm"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("_norm"), "gene"))
    first = valued.withColumn("_rn", rank).filter(F.col("_rn") <= length)
    sequence = F.array_sort(F.collect_list(F.struct("_rn", "token")))
    return first.groupBy("cell").agg(F.transform(sequence, lambda x: x["token"]).alias("tokens"))


def coverage(genes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(n_input, n_mapped, frac_mapped) of a gene list against a dictionary's usable genes."""
    usable = dictionary.filter("median > 0 AND token IS NOT NULL").select("gene").distinct().withColumn("_in", F.lit(1))
    both = genes.select("gene").join(usable, "gene", "left")
    return both.agg(F.count("*").alias("n_input"), F.count("_in").alias("n_mapped")).withColumn(
        "frac_mapped", F.col("n_mapped") / F.greatest("n_input", F.lit(1)).cast("double")
    )


def verify_encoding(encoded: DataFrame, dictionary: DataFrame, length: int) -> DataFrame:
    """Cells whose sequence breaks a property: too long, empty, repeated or unknown tokens. Must be empty."""
    vocabulary = dictionary.filter("median > 0").select("token").distinct()
    unknown = encoded.select("cell", F.explode("tokens").alias("token")).join(vocabulary, "token", "left_anti").select("cell", F.lit("unknown").alias("fault"))
    n = F.size("tokens")
    shape = encoded.select("cell", F.when(n > length, "long").when(n == 0, "empty").when(F.size(F.array_distinct("tokens")) < n, "repeated").alias("fault"))
    return shape.filter("fault IS NOT NULL").unionByName(unknown.distinct())


def prefix(v: Column | str, k: int) -> Column:
    """The first k numbers of a vector."""
    return F.slice(v, 1, k)


def l2_normalise(v: Column | str) -> Column:
    """A vector of length one; a zero vector stays as it is."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of those vectors whose mask is true, position by position; null if none is."""
    chosen = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"])
    zero = F.transform(F.element_at(vectors, 1), lambda _: F.lit(0.0))
    total = F.aggregate(chosen, zero, lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + q.cast("double")))
    return F.when(F.size(chosen) > 0, F.transform(total, lambda x: x / F.size(chosen)))


def pooled(rows: DataFrame, by: list[str], v: str, mask: str) -> DataFrame:
    """(by, place, value): masked_mean over rows, long form, for token vectors too many for one array."""
    each = rows.filter(F.col(mask)).select(*by, F.posexplode(v).alias("place", "x"))
    return each.groupBy(*by, "place").agg(F.avg(F.col("x").cast("double")).alias("value"))


def standardiser(train: DataFrame, v: str) -> DataFrame:
    """(place, mean, sd) of the training vectors: population sd, 1 where it is under 1e-8."""
    each = train.select(F.posexplode(v).alias("place", "x"))
    out = each.groupBy("place").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))
    return out.withColumn("sd", F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd")))


def standardise(df: DataFrame, fitted: DataFrame, v: str, out: str) -> DataFrame:
    """df with the vector v standardised as `out`; the fitted table is one row per dimension and is broadcast."""
    pairs = F.array_sort(F.collect_list(F.struct("place", "mean", "sd")))
    fit = fitted.agg(pairs.alias("_fit"))
    return (
        df.join(F.broadcast(fit))
        .withColumn(out, F.zip_with(v, "_fit", lambda x, f: (x.cast("double") - f["mean"]) / f["sd"]))
        .drop("_fit")
    )


def finite(df: DataFrame, v: str) -> DataFrame:
    """The rows whose vector is null or holds a null, NaN or infinity. Must be empty."""
    return df.filter(F.col(v).isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def check_train(n_train: int, n_all: int, least: int = 50) -> None:
    """ValueError if a training mask takes every row or fewer than `least`."""
    if n_train >= n_all:
        raise ValueError("the training rows are all rows: whatever is fitted on them has seen the test set")
    if n_train < least:
        raise ValueError(f"only {n_train} training rows; {least} are needed")
