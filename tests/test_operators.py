"""Operators on small tables: values by hand, edges, nulls, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import features, harmonise, models, runs, sampling, scoring, statistics


def one(df):
    return [tuple(r) for r in df.collect()]


# ---- draws


def test_budget_caps_and_folds(spark):
    df = spark.createDataFrame([(f"c{n}", "abcd"[min(3, n // 40)], "d") for n in range(125)], "cell_id string, label string, dataset string")
    got = {r["label"]: r["count"] for r in sampling.label_budget(df, 7, 0).groupBy("label").count().collect()}
    assert got == {"a": 7, "b": 7, "c": 7, "d": 5}
    assert sampling.label_budget(df, None, 0) is df and sampling.label_budget(df.limit(0), 3, 0).count() == 0
    with pytest.raises(ValueError):
        sampling.label_budget(df, 0, 0)
    assert sampling.capped(df, 60, 0).groupBy("label").count().agg(F.max("count")).first()[0] == 19  # 3 x 19 + 5 >= 60
    assert sampling.capped(df, 500, 0).count() == 125
    sub = sampling.cv_subsample(df, 25, 0).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in sub} == {"a": 8, "b": 8, "c": 8, "d": 2}
    folds = sampling.folds(df, 10, 0)
    assert {r[0] for r in folds.select("fold").distinct().collect()} == set(range(5))
    assert folds.groupBy("label", "fold").count().agg(F.max("count"), F.min("count")).first() == (8, 1)


@pytest.mark.parametrize("counts,target", [([5, 5, 5], 7), ([1, 1, 100], 50), ([3, 9, 9, 20], 40), ([2], 1), ([4, 4], 8)])
def test_cap_is_the_smallest_that_reaches_the_target(spark, counts, target):
    df = spark.createDataFrame([("d", str(i), n) for i, n in enumerate(counts)], "dataset string, label string, n long")
    want = None if sum(counts) <= target else min(c for c in range(1, max(counts) + 1) if sum(min(n, c) for n in counts) >= target)
    assert one(sampling.caps(df, target, "dataset", "label")) == [("d", want)]


# ---- harmonisation


def test_labels_and_genes(spark):
    rules = spark.createDataFrame([("B", "Bc", "C1", "map", ""), ("junk", None, "", "drop", "why")], "label_raw string, working_class string, cl_term string, action string, reason string")
    cells = spark.createDataFrame([("d", "B"), ("d", "junk"), ("d", "B")], "dataset string, label_raw string")
    assert sorted(one(harmonise.accounting(harmonise.harmonised(cells, rules))), key=str) == [("d", "B", "Bc", "map", 2), ("d", "junk", None, "drop", 1)]
    with pytest.raises(harmonise.UnmappedLabelError):
        harmonise.harmonised(spark.createDataFrame([("d", "new")], cells.schema), rules)
    sets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 9)], "dataset string, gene int")
    got = {(r["a"], r["b"]): r["overlap"] for r in harmonise.gene_overlap(sets).collect()}
    assert got["a", "b"] == 0.5 and got["b", "a"] == 1.0 and got["a", "c"] == 0.0 and len(got) == 9
    with pytest.raises(ValueError):
        harmonise.common_genes(sets, 1)
    with pytest.raises(harmonise.MissingRowsError):
        harmonise.covered(sets, spark.createDataFrame([("a",), ("z",)], "dataset string"), "dataset")
    with pytest.raises(Exception, match="reads like one"):
        harmonise.no_null_text(spark.createDataFrame([("nan",)], "x string"), ["x"]).collect()


def test_quality_control(spark):
    rows = spark.createDataFrame([("c", 1, 3.0, True), ("c", 2, 1.0, False), ("e", 2, 5.0, False), ("z", 2, 0.0, False)], "cell string, gene int, value double, mito boolean")
    cells = spark.createDataFrame([("c", "d"), ("e", "d"), ("z", "d"), ("none", "d")], "cell string, dataset string")
    m = harmonise.with_empty(harmonise.cell_metrics(rows, F.col("mito")), cells)
    got = {r["cell"]: (r["n_genes"], r["pct_mito"]) for r in m.collect()}
    assert got == {"c": (2, 75.0), "e": (1, 0.0), "z": (0, 0.0), "none": (0, 0.0)}
    assert one(harmonise.qc_counters(m, 1, 20.0)) == [("d", 4, 2, 1, 0.5, 0.0, 1)]
    assert one(harmonise.gene_filter(rows, 2)) == [(2, 2)]


# ---- features


def test_features(spark):
    rows = spark.createDataFrame([("c", 1, 3.0), ("c", 2, 1.0), ("z", 1, 0.0)], "cell string, gene int, value double")
    got = {(r["cell"], r["gene"]): r["value"] for r in features.log_norm(rows).collect()}
    assert got["c", 1] == pytest.approx(math.log1p(7500)) and got["z", 1] == 0.0
    dictionary = spark.createDataFrame([(1, 11, 100.0), (2, 12, 1.0), (3, 13, 0.0)], "gene int, token long, median double")
    encoded = features.rank_encode(rows, dictionary, 5)
    assert one(encoded) == [("c", [12, 11])] and features.verify_encoding(encoded, dictionary, 5).count() == 0
    doubled = rows.withColumn("value", F.col("value") * 17)
    assert one(features.rank_encode(doubled, dictionary, 5)) == [("c", [12, 11])] and one(features.rank_encode(rows, dictionary, 1)) == [("c", [12])]
    bad = spark.createDataFrame([("a", [11, 11]), ("b", []), ("c", [99]), ("d", [11, 12, 11])], "cell string, tokens array<long>")
    assert {tuple(r) for r in features.verify_encoding(bad, dictionary, 2).collect()} == {("a", "repeated"), ("b", "empty"), ("c", "unknown"), ("d", "long")}
    assert one(features.pseudo_counts(spark.createDataFrame([("c", 1, math.log1p(2.5)), ("c", 2, 0.1)], "cell string, gene int, value double"))) == [("c", 1, 2.0)]
    with pytest.raises(ValueError):
        features.check_train(10, 10)
    with pytest.raises(ValueError):
        features.check_train(10, 100)


def test_variable_genes_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(rng.uniform(0.1, 5, 60)[None, :], (80, 60)).astype(float)
    rows = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "cell int, gene int, value double")
    mean, var = x.mean(axis=0), x.var(axis=0, ddof=1)
    disp = var / mean
    at = np.clip(np.searchsorted(np.quantile(mean, np.linspace(0, 1, 21)), mean, side="right") - 1, 0, 19)
    score = np.array([(disp[g] - disp[at == at[g]].mean()) / (disp[at == at[g]].std() or 1.0) for g in range(60)]).round(9)
    want = sorted(range(60), key=lambda g: (-score[g], g))[:15]
    assert [r["gene"] for r in features.variable_genes(rows, 80, 15).collect()] == want
    few = rows.filter("gene < 5")
    assert features.variable_genes(few, 80, 15).count() == 5 and {r["bin"] for r in features.variable_genes(few, 80, 15).collect()} == {0}


def test_vectors(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0], True), ("b", [0.0, 0.0], True), ("c", [1.0, 0.0], False)], "cell_id string, emb array<double>, keep boolean")
    assert [r[0] for r in df.select(features.l2_normalise("emb")).collect()] == [[0.6, 0.8], [0.0, 0.0], [1.0, 0.0]]
    fitted = features.standardiser(df.filter("keep"), "emb")
    z = features.standardise(df, fitted, "emb", "z").collect()
    assert z[0]["z"] == [1.0, 1.0] and z[1]["z"] == [-1.0, -1.0]
    pooled = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [True, False]), ([[1.0, 2.0], [3.0, 4.0]], [False, False])], "v array<array<double>>, m array<boolean>")
    assert [r[0] for r in pooled.select(features.masked_mean(pooled.v, pooled.m)).collect()] == [[1.0, 2.0], None]
    nan = spark.createDataFrame([("a", [1.0]), ("b", [float("nan")]), ("c", None)], "cell_id string, emb array<double>")
    assert {r[0] for r in features.finite(nan, "emb").collect()} == {"b", "c"}


# ---- scoring


def test_two_conventions_differ_on_unlearnable_rows(spark):
    pred = spark.createDataFrame([("r", "d", "a", "a"), ("r", "d", "a", "b"), ("r", "d", "b", "b"), ("r", "d", "new", "b"), ("r", "e", "new", "a")], "run string, dataset string, y_true string, y_pred string")
    train = spark.createDataFrame([("r", "a"), ("r", "b")], "run string, label string")
    whole = scoring.evaluate(pred, train, ["run"]).first()
    assert whole["macro_f1"] == pytest.approx((2 / 3 + 2 / 3) / 2) and whole["balanced_acc"] == pytest.approx(0.75)
    assert (whole["n_test"], whole["n_classes_learnable"], whole["n_classes_test_only"], whole["classes_learnable"]) == (5, 2, 1, "a;b")
    per = scoring.evaluate_per_dataset(pred, train, ["run"]).collect()
    assert len(per) == 1 and per[0]["macro_f1"] == pytest.approx((2 / 3 + 1 / 2) / 2)  # e has no learnable class
    assert per[0]["macro_f1_all_test_classes"] == pytest.approx((2 / 3 + 1 / 2 + 0) / 3)
    assert scoring.evaluate(pred.limit(0), train, ["run"]).count() == 0


def test_strata_and_weights(spark):
    df = spark.createDataFrame([("a",)] * 96 + [("b",)] * 3 + [("c",)], "label string")
    assert {r["label"]: r["stratum"] for r in scoring.rarity(df.unionByName(df.filter("label = 'a'"))).collect()} == {"a": "common", "b": "uncommon", "c": "rare"}
    assert {r["label"]: r["weight"] for r in scoring.class_weights(df).collect()}["c"] == pytest.approx(100 / 3)


# ---- statistics


def test_p_values_against_known_ones():
    assert statistics.signed_rank_p(np.arange(1.0, 6), 0.0) == pytest.approx(2 / 32)
    assert statistics.signed_rank_p(np.arange(1.0, 11), 8.0) == pytest.approx(0.048828125)
    assert statistics.signed_rank_p(np.array([]), 0.0) == 1.0
    assert statistics.t_p(2.0, 10) == pytest.approx(0.07338803477074037, rel=1e-9)
    assert statistics.t_p(-2.3533634348018264, 3) == pytest.approx(0.1, rel=1e-6)
    assert statistics.t_p(0.0, 5) == pytest.approx(1.0) and math.isnan(statistics.t_p(float("nan"), 5))


def test_contrasts(spark):
    rows = [(f"d{n}", arm, "S", "10", 0.5 + n / 100 + (0.1 if arm == "a" else 0.0) * (n > 0), 2) for n in range(5) for arm in "ab"] + [("lone", "a", "S", "10", 0.9, 1)]
    agg = spark.createDataFrame(rows, "dataset string, representation string, scheme string, budget string, m double, n_runs long")
    paired = statistics.pairs(agg, "a", "b", "m")
    got = statistics.contrast(paired).first()
    assert got["n_datasets"] == 5 and got["delta_mean"] == pytest.approx(0.08) and got["n_datasets_favouring_a"] == 4 and got["datasets"] == "d0;d1;d2;d3;d4"
    ranks = statistics.signed_rank(paired).first()
    assert (ranks["n_nonzero"], ranks["w_plus"], ranks["w_minus"]) == (4, 10.0, 0.0)
    assert statistics.contrast(paired.limit(2)).count() == 0
    assert {r["representation"]: r["n_runs"] for r in statistics.run_range(agg).collect()} == {"a": "1-2", "b": "2"}
    ci = statistics.bootstrap(paired, ["scheme"], "dataset", "d", 300).first()
    assert ci["n"] == 5 and ci["lo"] <= 0.08 <= ci["hi"]
    assert statistics.bootstrap(paired.limit(1), ["scheme"], "dataset", "d", 10).first()["lo"] is None
    p = statistics.p_values(paired).first()
    assert 0 < p["ttest_p"] < 0.05 and 0 < p["p_raw"] <= 0.125
    with pytest.raises(ValueError):
        statistics.aggregate_seeds(agg.drop("dataset"), "m")
    with pytest.raises(Exception, match="null dataset"):
        statistics.aggregate_seeds(agg.withColumn("dataset", F.lit(None).cast("string")), "m").collect()


def test_false_discovery_and_verdicts(spark):
    df = spark.createDataFrame([("a", 0.01, 0.5), ("b", 0.04, 0.01), ("c", 0.03, -0.5), ("d", None, 0.5)], "k string, p double, delta double")
    out = statistics.bh(df, "p", ["k"])
    got = {r["k"]: r["p_fdr"] for r in out.collect()}
    assert got["a"] == pytest.approx(0.03) and got["b"] == got["c"] == pytest.approx(0.04) and got["d"] is None
    said = {r[0]: r[1] for r in out.select("k", statistics.verdict(F.col("p_fdr"), F.col("delta"))).collect()}
    assert said == {"a": "a better", "b": "detectable but negligible (|delta| < 0.02)", "c": "b better", "d": "no detectable difference"}


def test_figure_tables(spark):
    t2 = spark.createDataFrame([("S3", "a", "5", "g1", "f1", 0.2), ("S3", "a", "5", "g1", "f2", 0.4), ("S3", "a", "5", None, "f3", 0.9)], "scheme string, representation string, budget string, holdout_group string, split_file string, macro_f1 double")
    assert one(statistics.budget_table(t2)) == [("S3", "a", "5", pytest.approx(0.6), 2)]
    assert one(statistics.transfer_matrix(t2, ["a", "b"], "S3")) == [("g1", pytest.approx(0.3), None)]
    order = spark.createDataFrame([("all",), ("100",), ("5",)], "budget string")
    assert [r[0] for r in order.orderBy(statistics.budget_order(F.col("budget"))).collect()] == ["5", "100", "all"]


# ---- runs


def test_budget_text_and_seeds(spark):
    df = spark.createDataFrame([(x,) for x in (None, "", "NaN", "None", "all", "0.0", "10", " 25.0 ", "2.5", "x")], "b string")
    assert [r[0] for r in df.select(runs.budget_text(F.col("b"))).collect()] == ["all"] * 5 + ["0", "10", "25", "2.5", "x"]
    run = {"seeds": [0, 1, 2], "reduced_seeds": {"budgets": [None], "n_seeds": 2}, "extra_seeds": {"schemes": ["S3"], "budgets": [5], "seeds": [2, 7]}}
    assert runs.seeds_for(run, "S3", None) == [0, 1] and runs.seeds_for(run, "S3", 5) == [0, 1, 2, 7] and runs.seeds_for(run, "S1", 5) == [0, 1, 2]
    with pytest.raises(ValueError):
        runs.seeds_for(run | {"extra_seeds": {"schemes": ["S3"], "budgets": [None], "seeds": [9]}}, "S3", 5)
    with pytest.raises(ValueError):
        runs.seeds_for(run | {"reduced_seeds": {"budgets": [None], "n_seeds": 1}}, "S3", None)


RESULT = "representation string, split_file string, budget string, seed int, dataset string, n_datasets_in_run int, n_test int, macro_f1 double, seconds double"


def test_resume_and_merge(spark):
    full = [("a", "f", "10.0", 0, d, 2, 5, 0.5, 1.0) for d in ("x", "y")]
    part = [("a", "f", "10", 1, "x", 2, 5, 0.5, 1.0), ("a", "f", "10", 0, "x", 2, 3, 0.4, 1.0)]
    done = spark.createDataFrame(full + part, RESULT)
    design = spark.createDataFrame([("a", "f", "10", 0), ("a", "f", "10", 1), ("a", "f", None, 0)], "representation string, split_file string, budget string, seed int")
    assert {(r["budget"], r["seed"]) for r in runs.pending(design, done).collect()} == {("10", 1), ("all", 0)}
    merged = runs.merged(done.limit(0), done)
    assert sorted((r["dataset"], r["n_test"]) for r in merged.collect()) == [("x", 5), ("y", 5)]


def test_append_refuses_other_schemas(spark, tmp_path):
    path = str(tmp_path / "t2")
    row = spark.createDataFrame([tuple(None for _ in runs.T2)], runs.T2)
    runs.append(row.select(*reversed(runs.T2.names)), path)
    runs.append(row, path)
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(path).columns == runs.T2.names
    for bad in (row.drop("seed"), row.withColumn("extra", F.lit(1)), row.withColumn("seed", F.lit("0"))):
        with pytest.raises(runs.SchemaMismatch):
            runs.append(bad, path)
    row.select(*reversed(runs.T2.names)).write.parquet(str(tmp_path / "odd"))
    with pytest.raises(runs.SchemaMismatch):
        runs.append(row, str(tmp_path / "odd"))


def test_reconstruction_assembly_and_representations(spark):
    old = spark.createDataFrame([("a", "f", "1", 0, "x", 0.5), ("a", "f", "1", 0, "y", 0.5)], "representation string, split_file string, budget string, seed int, dataset string, macro_f1 double")
    new = spark.createDataFrame([("a", "f", "1", 0, "x", 0.5000001), ("a", "f", "1", 0, "y", 0.6), ("a", "f", "1", 0, "z", 0.5)], old.schema)
    assert {r["dataset"]: r["status"] for r in runs.reconstruction(new, old).collect()} == {"x": "ok", "y": "failed", "z": "unrecorded"}
    with pytest.raises(ValueError):
        runs.assembled(old, spark.createDataFrame([("nope",)], "dataset string"))
    rep = spark.createDataFrame([("pca", "s1", "c", [1.0]), ("global", None, "c", [2.0])], "representation string, split_id string, cell_id string, emb array<double>")
    assert runs.representation(rep, "pca", "s1").first()["emb"] == [1.0] and runs.representation(rep, "global", "s9").first()["emb"] == [2.0]
    with pytest.raises(ValueError):
        runs.representation(rep, "pca", "s2")


# ---- models


def _blobs(n=240, k=3, d=4, seed=0):
    rng = np.random.default_rng(seed)
    y = np.array([str(c) for c in rng.choice(k, n, p=[0.6, 0.3, 0.1])])
    return rng.normal(size=(n, d)) + 1.5 * np.eye(k, d)[y.astype(int)], y


def test_head_is_at_the_optimum():
    x, y = _blobs()
    model = models.Multinomial(2.0).fit(x, y)
    assert model.gradient < 1e-4 and model.weights.shape == (3, 4) and np.allclose(model.probabilities(x).sum(axis=1), 1)
    eps, theta = 1e-5, np.concatenate([model.weights.ravel(), model.bias])
    hot = np.eye(3)[y.astype(int)]
    w = (len(y) / (3 * hot.sum(axis=0)))[y.astype(int)]
    f0, g0 = model._loss(theta + 0.1, x, hot, w)
    for i in (0, 5, 13):
        step = np.zeros_like(theta)
        step[i] = eps
        assert (model._loss(theta + 0.1 + step, x, hot, w)[0] - model._loss(theta + 0.1 - step, x, hot, w)[0]) / (2 * eps) == pytest.approx(g0[i], rel=1e-4)


def test_head_matches_the_distributed_one(spark):
    x, y = _blobs(120)
    df = spark.createDataFrame([(str(v), [float(a) for a in e]) for v, e in zip(y, x)], "label string, emb array<double>")
    _, fitted = models.fit_distributed(df, 1.0)
    mine = models.Multinomial(1.0).fit(x, y)
    assert np.allclose(fitted.coefficientMatrix.toArray(), mine.weights, atol=1e-3)


def test_inner_folds_and_sweep(spark):
    x, y = _blobs(90)
    assert models.inner_cv(x, y, np.zeros(90, int), [1.0]) == (1.0, -np.inf, 0)
    d, c, score, k = models.choose_dims(x, y, models.stratified(y, 5), [2, 4, 9], [0.1, 1.0])
    assert d in (2, 4) and c in (0.1, 1.0) and 0 < score <= 1 and k >= 2
    rows = [("r", f"c{n}", "d", v, [float(a) for a in e]) for n, (v, e) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "run string, cell_id string, dataset string, label string, emb array<double>")
    out = models.sweep(df.limit(60), df.filter("cell_id >= 'c6'"), ["run"], [1.0])
    assert out.count() == df.filter("cell_id >= 'c6'").count() and out.filter("y_true = y_pred").count() > 0.5 * out.count()
    with pytest.raises(Exception, match="one task takes"):
        models.sweep(df, df, ["run"], [1.0], most_train=5).collect()


def test_pca_and_batches(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    df = spark.createDataFrame([(n, [float(a) for a in e]) for n, e in enumerate(x)], "cell_id int, emb array<double>")
    mean, parts = models.fit_pca(df, "emb", 2)
    got = np.array([r["pc"] for r in models.apply_pca(df, "emb", "pc", mean, parts).orderBy("cell_id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ vt[:2].T), atol=1e-6) and np.allclose(got.mean(axis=0), 0, atol=1e-9)
    batch = np.array(["a", "b"] * 150)
    shifted = x + np.where(batch == "a", 2.0, 0.0)[:, None]
    gap = lambda z: np.abs(z[batch == "a"].mean(axis=0) - z[batch == "b"].mean(axis=0)).mean()
    assert gap(models.harmonised_batches(shifted, batch)) < 0.5 * gap(shifted)
    assert models.harmonised_batches(x, np.array(["a"] * 300)) is x


def test_pluggable_encoder(spark):
    df = spark.createDataFrame([("a", [1, 2, 3]), ("b", [4]), ("c", [5, 6])], "cell_id string, tokens array<long>")
    calls = lambda batch: np.array([[float(sum(x)), float(len(batch))] for x in batch])
    got = {r["cell_id"]: r["emb"] for r in models.encode(df.coalesce(1), calls, "tokens", tokens=4).collect()}
    assert got == {"a": [6.0, 1.0], "b": [4.0, 2.0], "c": [11.0, 2.0]}
