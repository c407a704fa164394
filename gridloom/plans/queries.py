"""One query per operator over the fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import features, harmonise, models, runs, sampling, scoring, splits, statistics
from gridloom.plans import fixtures as fx
from gridloom.sources.tables import latest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Three-scheme design of the split queries.
DESIGN = [splits.Split(splits.S1, 0), splits.Split(splits.S2, 0), splits.Split(splits.S3, 0), splits.Split(splits.S3, 0, "ASIA")]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(*cols: str) -> list:
    return [F.round(F.col(c), 6).alias(c) for c in cols]


def rules(spark: SparkSession) -> DataFrame:
    rows = [("1-URGENT", "acute", "CL:1", "map", ""), ("2-HIGH", "acute", "CL:1", "map", ""), ("3-MEDIUM", "steady", "CL:2", "map", ""), ("5-LOW", "steady", "CL:3", "map", "")]
    rows.append(("4-NOT SPECIFIED", None, "", "drop", "unspecified"))
    return spark.createDataFrame(rows, "label_raw string, working_class string, cl_term string, action string, reason string")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.index(spark, d).withColumnRenamed("label", "label_raw")
    return harmonise.harmonised(cells, rules(spark), strict=False)


# ---- scans and the index


@query
def cell_index(spark, d):
    """Every cell with its qualified keys."""
    return fx.index(spark, d)


@query
def manifest_cells(spark, d):
    """The delivered cell index: one row per cell, the latest delivery, with a group and a label."""
    cells = latest(table(spark, d, "cell_index"), ["cell_id"], "loaded_at", ["dataset", "ldo_group", "donor", "label"])
    return cells.filter("label IS NOT NULL").groupBy("dataset", "label").agg(F.count("*").alias("n_cells"), F.count_distinct("donor").alias("n_donors"))


@query
def matrix_dims(spark, d):
    return harmonise.dims(fx.counts(spark, d))


@query
def counts_of_cells(spark, d):
    """Counts of the cells of one label only: the semi join reaches the scan."""
    keep = fx.observed(spark, d).filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("cell"))
    return harmonise.keep_cells(fx.counts(spark, d), keep)


@query
def row_block(spark, d):
    """A block of cells by key range, pushed down to the scan."""
    lines = table(spark, d, "lineitem").filter((F.col("l_orderkey") >= 1000) & (F.col("l_orderkey") < 2000))
    return lines.groupBy(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))


@query
def unique_gene_names(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("name"))
    return harmonise.unique_names(parts)


@query
def union_of_parts(spark, d):
    """Rows of two sources, each named, as one table."""
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("source", F.lit("customer"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("source", F.lit("supplier"))
    return a.unionByName(b)


@query
def duplicate_keys(spark, d):
    """Records that were delivered more than once."""
    return table(spark, d, "t4_label_harmonisation").groupBy("row_id").agg(F.count("*").alias("n")).filter("n > 1")


# ---- harmonisation and quality control


@query
def label_harmonise(spark, d):
    return labelled(spark, d).select("cell_id", "label_raw", "working_class", "cl_term", "action", "reason")


@query
def label_accounting(spark, d):
    return harmonise.accounting(labelled(spark, d))


@query
def label_rules(spark, d):
    r = rules(spark)
    return harmonise.rule_table(r.filter("action = 'map'"), r.filter("action = 'drop'"))


@query
def unmapped_labels(spark, d):
    """Labels that no rule knows; here the rules lack one on purpose."""
    known = rules(spark).filter("label_raw <> '5-LOW'")
    return fx.index(spark, d).select(F.col("label").alias("label_raw")).distinct().join(known, "label_raw", "left_anti")


def metrics(spark, d):
    return harmonise.cell_metrics(fx.named_counts(spark, d), F.col("mito"))


@query
def qc_cell_metrics(spark, d):
    return metrics(spark, d).select("cell", "n_genes", *r6("total", "mito", "pct_mito"))


@query
def qc_filter_stats(spark, d):
    """Per dataset: what quality control counts; cells without any count are there with zeros."""
    cells = fx.observed(spark, d).select(F.col("o_orderkey").alias("cell"), F.col("n_name").alias("dataset"))
    out = harmonise.qc_counters(harmonise.with_empty(metrics(spark, d), cells), 2, 20.0)
    return out.select("dataset", "cells_before", "failed_min_genes", "failed_max_pct_mito", *r6("median_genes_per_cell", "median_pct_mito"), "cells_after")


@query
def gene_filter(spark, d):
    """Genes of at least three cells that pass quality control."""
    good = metrics(spark, d).filter(harmonise.passes(2, 20.0))
    return harmonise.gene_filter(harmonise.keep_cells(fx.counts(spark, d), good), 3)


@query
def mito_filter_applied(spark, d):
    return fx.named_counts(spark, d).groupBy("dataset").agg(F.bool_or("mito").alias("mito_filter_applied"), F.count_distinct(F.when(F.col("mito"), F.col("gene"))).alias("mito_genes_found"))


@query
def gene_intersection(spark, d):
    """Genes that the cells of every region have."""
    cells = fx.observed(spark, d).select(F.col("o_orderkey").alias("cell"), F.col("r_name").alias("dataset"))
    return harmonise.common_genes(harmonise.gene_sets(fx.counts(spark, d).join(cells, "cell")), 100)


@query
def gene_overlap_matrix(spark, d):
    return harmonise.gene_overlap(harmonise.gene_sets(fx.named_counts(spark, d))).select("a", "b", *r6("overlap"))


@query
def water_fill_cap(spark, d):
    n = fx.index(spark, d).groupBy("dataset", "label").agg(F.count("*").alias("n"))
    return sampling.caps(n, 300, "dataset", "label")


@query
def stratified_cap(spark, d):
    return sampling.capped(fx.index(spark, d), 300, 0).select("cell_id", "dataset", "label")


# ---- splits


@query
def split_s1(spark, d):
    """Cells per partition of a split within datasets."""
    cells = splits.check_index(fx.index(spark, d))
    return splits.s1(cells, 0).join(cells, "cell_id").groupBy("dataset", "partition").agg(F.count("*").alias("n_cells"), F.count_distinct("label").alias("n_classes"))


@query
def split_s1_cells(spark, d):
    return splits.s1(fx.index(spark, d), 1)


@query
def split_s2(spark, d):
    return splits.s2(fx.index(spark, d), 0)


@query
def split_s3_free(spark, d):
    return splits.s3(fx.index(spark, d), 0)


@query
def split_s3_holdout(spark, d):
    return splits.s3(fx.index(spark, d), 0, "ASIA")


@query
def unit_allocation(spark, d):
    """The partition of every donor of every dataset."""
    return splits.allocate(fx.index(spark, d).select("dataset", "donor").distinct(), ["dataset"], "donor", 3)


@query
def split_manifest(spark, d):
    cells = fx.index(spark, d)
    return splits.manifest(cells, splits.many(cells, DESIGN))


@query
def leakage_audit(spark, d):
    """Clean splits, and one within datasets that is audited as if it kept donors and groups whole."""
    cells = fx.index(spark, d)
    wrong = splits.s1(cells, 0).select(F.lit(splits.S3).alias("scheme"), F.lit(9).alias("seed"), F.lit("").alias("holdout_group"), "cell_id", "partition")
    return splits.audit(cells, splits.many(cells, DESIGN).unionByName(wrong))


@query
def split_alignment(spark, d):
    """Cells that a split lacks, here those of one dataset."""
    cells = fx.index(spark, d)
    return splits.aligned(cells, splits.s1(cells, 0).join(cells.filter("dataset <> 'NATION_3'"), "cell_id", "left_semi"))


@query
def partition_read(spark, d):
    """Rows of the partitions that may be read."""
    cells = fx.index(spark, d)
    return splits.read_parts(splits.s2(cells, 0), ["train", "test"])


@query
def classes_learnable(spark, d):
    """Classes in training and test, and in test only, of a manifest's splits."""
    train = fx.index(spark, d).filter("dataset < 'NATION_12' AND label <> '5-LOW'").select("label").distinct()
    test = fx.index(spark, d).filter("dataset >= 'NATION_12'").select("label").distinct()
    both = train.intersect(test).withColumn("kind", F.lit("learnable"))
    return both.unionByName(test.exceptAll(train).withColumn("kind", F.lit("test_only")))


@query
def split_names(spark, d):
    """What a split's file name says, and one shard of the files."""
    files = latest(table(spark, d, "split_manifest"), ["split_id"], "loaded_at", ["file"]).select("file")
    return runs.shard(files, "file", 1, 3).select("file", runs.split_name(F.col("file")).alias("s")).select("file", "s.scheme", "s.seed", "s.holdout_group")


@query
def first_splits(spark, d):
    files = latest(table(spark, d, "split_manifest"), ["split_id"], "loaded_at", ["scheme", "file"])
    return runs.first_splits(files.select("scheme", F.col("file").alias("split_file")), 5)


# ---- features


@query
def log_norm(spark, d):
    return features.log_norm(fx.counts(spark, d)).select("cell", "gene", *r6("value"))


@query
def pseudo_counts(spark, d):
    return features.pseudo_counts(fx.counts(spark, d).withColumn("value", F.round(F.log1p("value"), 9)))


@query
def gene_moments(spark, d):
    n = table(spark, d, "orders").count()
    return features.gene_moments(fx.counts(spark, d), n).select("gene", *r6("mean", "variance", "dispersion"))


@query
def hvg_select(spark, d):
    n = table(spark, d, "orders").filter("o_orderkey % 5 <> 0").count()
    return features.variable_genes(fx.counts(spark, d).filter("cell % 5 <> 0"), n, 200).select("gene")


@query
def rank_encode(spark, d):
    return features.rank_encode(fx.counts(spark, d), fx.dictionary(spark, d), 4)


@query
def encoding_faults(spark, d):
    """Broken sequences when only five tokens are allowed and three come: none."""
    known = fx.dictionary(spark, d)
    return features.verify_encoding(features.rank_encode(fx.counts(spark, d), known, 3), known, 5)


@query
def vocab_coverage(spark, d):
    genes = table(spark, d, "part").select(F.col("p_partkey").alias("gene"))
    return features.coverage(genes, fx.dictionary(spark, d)).select("n_input", "n_mapped", *r6("frac_mapped"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("cell_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("emb"), "vec_id")


@query
def standardise(spark, d):
    v = vectors(spark, d)
    out = features.standardise(v, features.standardiser(v.filter("vec_id % 5 <> 0"), "emb"), "emb", "z")
    return out.select("cell_id", F.posexplode("z").alias("place", "z")).select("cell_id", "place", *r6("z"))


@query
def pc_prefix(spark, d):
    return vectors(spark, d).select("cell_id", F.posexplode(features.prefix("emb", 30)).alias("place", "x")).select("cell_id", "place", F.col("x").cast("double").alias("x"))


@query
def l2_normalise(spark, d):
    return vectors(spark, d).select("cell_id", F.posexplode(features.l2_normalise("emb")).alias("place", "x")).select("cell_id", "place", *r6("x"))


@query
def masked_mean_pool(spark, d):
    """The mean vector of each label, over the vectors a mask keeps."""
    v = vectors(spark, d).withColumn("keep", F.col("vec_id") % 3 != 0)
    return features.pooled(v, ["label"], "emb", "keep").select("label", "place", *r6("value"))


@query
def finite_vectors(spark, d):
    """Delivered vectors that can't be used."""
    return features.finite(table(spark, d, "cell_repr"), "emb").select("cell_id").distinct()


@query
def representation_scan(spark, d):
    """A representation's own rows for a split."""
    rows = vectors(spark, d).select(F.lit("pca").alias("representation"), F.when(F.col("vec_id") % 2 == 0, "a").alias("split_id"), "cell_id", "emb")
    return runs.representation(rows, "pca", "a").select("cell_id", F.size("emb").alias("width"))


# ---- budgets and folds


@query
def label_budget(spark, d):
    return sampling.label_budget(fx.index(spark, d), 25, 0).select("cell_id", "label")


@query
def cv_subsample(spark, d):
    return sampling.cv_subsample(fx.index(spark, d), 1000, 0).select("cell_id", "label")


@query
def cv_folds(spark, d):
    return sampling.folds(fx.index(spark, d), 5, 0).select("cell_id", "label", "fold")


@query
def class_weights(spark, d):
    return scoring.class_weights(fx.index(spark, d)).select("label", "n", *r6("weight"))


@query
def rarity_strata(spark, d):
    """Strata of brands by their share of the line items."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).join(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey")
    return scoring.rarity(lines.withColumn("label", F.concat_ws("/", "p_brand", "p_type"))).select("label", "n", *r6("prevalence"), "stratum")


# ---- scoring


@query
def confusion(spark, d):
    return scoring.confusion(fx.predictions(spark, d), fx.RUN)


@query
def eval_pooled(spark, d):
    pred = fx.predictions(spark, d)
    out = scoring.evaluate(pred, fx.train_classes(pred), fx.RUN)
    return out.select(*fx.RUN, "n_test", "n_classes_learnable", "n_classes_test_only", "classes_learnable", *r6("macro_f1", "balanced_acc", "macro_f1_all_test_classes", "accuracy"))


@query
def eval_per_dataset(spark, d):
    out = fx.results(spark, d)
    return out.select(*fx.RUN, "dataset", "n_test", "n_classes_learnable", "n_classes_test_only", *r6("macro_f1", "macro_f1_all_test_classes", "accuracy"))


@query
def per_class_f1(spark, d):
    pred = fx.predictions(spark, d)
    out = scoring.class_rows(pred, fx.train_classes(pred), fx.RUN)
    return out.select(*fx.RUN, "dataset", "cell_type", *r6("f1"), "n_test_cells_class", *r6("class_prevalence"), "n_test_cells_dataset")


# ---- statistics


def aggregated(spark, d):
    return statistics.aggregate_seeds(fx.results(spark, d), "macro_f1")


def paired(spark, d):
    return statistics.pairs(aggregated(spark, d), "rank", "pca", "macro_f1")


@query
def seed_aggregate(spark, d):
    return aggregated(spark, d).select("dataset", "representation", "scheme", "budget", *r6("macro_f1", "macro_f1_resample_sd"), "n_runs")


@query
def run_range(spark, d):
    return statistics.run_range(aggregated(spark, d))


@query
def paired_contrast(spark, d):
    out = statistics.contrast(paired(spark, d))
    return out.select("scheme", "budget", "n_datasets", *r6("delta_mean", "delta_median", "cohens_dz"), "n_datasets_favouring_a", "datasets")


@query
def bootstrap_ci(spark, d):
    out = statistics.bootstrap(paired(spark, d), ["scheme", "budget"], "dataset", "d", 1000)
    return out.select("scheme", "budget", "n", *r6("lo", "hi"))


@query
def wilcoxon_stat(spark, d):
    return statistics.signed_rank(paired(spark, d)).select("scheme", "budget", "n_nonzero", *r6("w_plus", "w_minus", "wilcoxon_stat"))


@query
def ttest_stat(spark, d):
    return statistics.contrast(paired(spark, d)).select("scheme", "budget", *r6("t_stat"))


@query
def test_p_values(spark, d):
    return statistics.p_values(paired(spark, d)).select("scheme", "budget", *r6("p_raw", "ttest_p"))


def family(spark, d):
    """A family of p values made from the results' accuracy."""
    t2 = fx.results(spark, d).groupBy("dataset", "representation").agg(F.round(F.avg("accuracy"), 9).alias("acc"))
    p = F.when(F.col("dataset") != "NATION_7", F.pow(F.lit(1.0) - F.col("acc"), F.lit(4.0)))
    return t2.select("dataset", "representation", F.round(p, 9).alias("p_raw"), (F.col("acc") - 0.7).alias("delta"))


@query
def bh_fdr(spark, d):
    return statistics.bh(family(spark, d), "p_raw", ["dataset", "representation"]).select("dataset", "representation", *r6("p_raw", "p_fdr"))


@query
def verdict(spark, d):
    out = statistics.bh(family(spark, d), "p_raw", ["dataset", "representation"])
    return out.select("dataset", "representation", statistics.verdict(F.col("p_fdr"), F.col("delta"), 0.02, 0.01).alias("verdict"))


@query
def overlap_correlation(spark, d):
    """Mean gene overlap of a dataset against its difference between two arms."""
    over = harmonise.gene_overlap(harmonise.gene_sets(fx.named_counts(spark, d))).filter("a <> b").groupBy(F.col("a").alias("dataset")).agg(F.round(F.avg("overlap"), 9).alias("overlap"))
    diff = paired(spark, d).filter("scheme = 'S3_leave_dataset_out' AND budget = 'all'").select("dataset", F.round("d", 9).alias("d"))
    out = statistics.overlap_correlation(diff.join(over, "dataset"), "overlap", "d", "dataset")
    return out.select("n", *r6("pearson", "spearman", "y_at_min_x", "y_at_max_x"))


@query
def f1_budget_table(spark, d):
    out = statistics.budget_table(fx.results(spark, d))
    return out.select("scheme", "representation", "budget", *r6("mean"), "n_units").orderBy("scheme", "representation", statistics.budget_order(F.col("budget")))


@query
def transfer_matrix(spark, d):
    out = statistics.transfer_matrix(fx.results(spark, d), [a for a, _ in fx.ARMS], "S3_leave_dataset_out")
    return out.select("holdout_group", *r6(*[a for a, _ in fx.ARMS]))


# ---- runs


def done(spark, d):
    """Delivered results as result rows: a run needs as many rows as its split file says."""
    rows = latest(table(spark, d, "pilot_results_long"), ["result_id"], "loaded_at", ["representation", "split_file", "budget", "seed", "n_test", "macro_f1", "seconds", "scheme"])
    return rows.withColumn("dataset", F.col("result_id").cast("string")).withColumn("n_datasets_in_run", F.lit(2))


@query
def budget_text(spark, d):
    """How budgets are spelt and what they mean."""
    return table(spark, d, "pilot_results_long").groupBy("budget").agg(F.count("*").alias("n")).select("budget", runs.budget_text(F.col("budget")).alias("budget_text"), "n")


@query
def seed_grid(spark, d):
    """The runs of a design with fewer seeds at one budget and more in one cell."""
    files = latest(table(spark, d, "split_manifest"), ["split_id"], "loaded_at", ["scheme", "file"]).select("scheme", F.col("file").alias("split_file"))
    policy = {"seeds": [0, 1, 2], "reduced_seeds": {"budgets": [None], "n_seeds": 2}, "extra_seeds": {"schemes": ["S3_leave_group_out"], "budgets": [10], "seeds": [3, 4]}}
    return runs.grid(files, ["rank", "pca"], [10, 100, None], policy)


@query
def resume_anti_join(spark, d):
    """Runs of the delivered design that no complete result covers."""
    results = done(spark, d)
    return runs.pending(results.select(*runs.RUN).distinct(), results).distinct()


@query
def shard_merge(spark, d):
    results = done(spark, d)
    a, b = results.filter("result_id % 3 <> 0"), results.filter("result_id % 3 <> 1")
    return runs.merged(a, b).select(*runs.RUN, "dataset", "n_test", *r6("macro_f1"))


@query
def run_settings(spark, d):
    rows = latest(table(spark, d, "pilot_results_long"), ["result_id"], "loaded_at", [*runs.RUN, "c_selected"])
    known = rows.select(*runs.RUN, F.col("c_selected").alias("C_selected"), F.lit(30).alias("n_dims_selected"))
    return runs.run_settings(known)


@query
def recon_check(spark, d):
    """Scores recorded with an error in some rows, against the same scores again."""
    t2 = fx.results(spark, d).filter("scheme = 'S1_within_dataset'")
    noisy = t2.withColumn("macro_f1", F.col("macro_f1") + F.when(F.col("dataset") == "NATION_4", 0.01).otherwise(0.0)).filter("dataset <> 'NATION_5'")
    return runs.reconstruction(t2, noisy).groupBy("status").agg(F.count("*").alias("n"))


@query
def topn_per_group(spark, d):
    """The two largest datasets of each cancer that qualify."""
    rows = latest(table(spark, d, "t1_dataset_manifest"), ["dataset"], "loaded_at", ["cancer", "n_donors", "n_mappable_immune_classes", "mappable_immune_cells", "cells_raw"])
    fit = rows.filter("n_donors >= 3 AND n_mappable_immune_classes >= 3 AND mappable_immune_cells >= 500")
    order = [F.desc("n_mappable_immune_classes"), F.desc("cells_raw"), F.col("dataset")]
    return sampling.top_per_group(fit, "cancer", order, 2).select("cancer", "dataset")


@query
def dataset_table(spark, d):
    """The manifest with what other tables say of each dataset, and whether another has its DOI."""
    rows = latest(table(spark, d, "t1_dataset_manifest"), ["dataset"], "loaded_at", ["doi", "cells_raw"])
    labels = latest(table(spark, d, "t4_label_harmonisation"), ["row_id"], "loaded_at", ["dataset", "n_cells"])
    per = labels.groupBy("dataset").agg(F.count("*").alias("n_labels"), F.sum("n_cells").alias("n_cells"))
    plain = F.regexp_extract(F.lower("doi"), r"(10\.\d+/[a-z0-9.]*[a-z0-9])", 1)
    keyed = rows.withColumn("doi", F.when(plain != "", plain))
    shared = keyed.filter("doi IS NOT NULL").groupBy("doi").agg(F.count("*").alias("n_same_doi"))
    return keyed.join(per, "dataset", "left").join(shared, "doi", "left").select("dataset", "doi", "cells_raw", "n_labels", "n_cells", "n_same_doi")


# ---- models, checked by properties


@query
def logreg_fit(spark, d):
    """Held-out predictions of a multinomial head on the labelled vectors."""
    return _swept(spark, d, [1.0], None)


@query
def sweep(spark, d):
    """The same with C and the number of dimensions chosen by inner folds."""
    return _swept(spark, d, [0.01, 0.1, 1.0], [16, 32, 64])


def _swept(spark, d, grid, dims):
    v = vectors(spark, d).select(F.explode(F.array(F.lit("0"), F.lit("1"))).alias("seed"), "cell_id", "label", F.lit("all").alias("dataset"), "emb")
    test = F.pmod(fx.drawn("t", F.col("seed"), F.col("cell_id")), F.lit(5)) == 0
    return models.sweep(v.filter(~test), v.filter(test), ["seed"], grid, 5, dims)


@query
def pca_fit(spark, d):
    """Five components of the vectors, fitted on the training rows."""
    v = vectors(spark, d)
    mean, parts = models.fit_pca(v.filter("vec_id % 5 <> 0"), "emb", 5)
    return models.apply_pca(v, "emb", "pc", mean, parts).select("cell_id", F.posexplode("pc").alias("place", "x")).select("cell_id", "place", *r6("x"))
