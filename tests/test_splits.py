"""Splits keep units whole, hit their shares and stop when they leak; every guard is made to fire."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import splits as sp

GROUPS = {"A1": "G1", "A2": "G2", "B1": "G3", "B2": "G4", "C1": "G5", "C2": "G5"}
LABELS = ["T4", "T8", "NK", "B", "Mono", "DC", "Fib"]


@pytest.fixture(scope="module")
def index(spark):
    """Six datasets in five groups, four donors each, seven labels of 3 to 12 cells per donor."""
    rng, rows = random.Random(0), []
    for d, g in GROUPS.items():
        for n in range(4):
            for label in LABELS:
                rows += [(f"{d}|{n}{label}{k}", d, g, f"{d}|P{n}", label) for k in range(rng.randint(3, 12))]
    return spark.createDataFrame(rows, "cell_id string, dataset string, `group` string, donor string, label string").cache()


@pytest.mark.parametrize("split", [sp.Split(sp.S1, 0), sp.Split(sp.S2, 3), sp.Split(sp.S3, 2), sp.Split(sp.S3, 1, "G5")])
def test_every_cell_once_and_no_leak(index, split):
    rows = sp.many(index, [split])
    assert rows.count() == index.count() == rows.select("cell_id").distinct().count()
    assert sp.guard(index, rows) is rows


def test_shares_and_strata(index):
    rows = sp.s1(index, 0).join(index, "cell_id")
    n = index.count()
    for p, f in sp.FRACTIONS.items():
        assert abs(rows.filter(F.col("partition") == p).count() / n - f) < 0.03
    assert rows.select("partition", "label").distinct().count() == 3 * len(LABELS)


def test_named_holdout_is_the_test_set(index):
    rows = sp.s3(index, 0, "G5").join(index, "cell_id")
    assert {r[0] for r in rows.filter("partition = 'test'").select("dataset").distinct().collect()} == {"C1", "C2"}
    assert rows.select("group", "partition").distinct().count() == 5


def test_seeds_differ(index):
    assert sorted(sp.s1(index, 0).collect()) != sorted(sp.s1(index, 1).collect())


def test_small_strata_go_to_train(spark):
    df = spark.createDataFrame([("a", "d", "x"), ("b", "d", "x"), ("c", "d", "y"), ("e", "d", "y"), ("f", "d", "y")], "cell_id string, dataset string, label string")
    got = {r["cell_id"]: r["partition"] for r in sp.s1(df, 0).collect()}
    assert got["a"] == got["b"] == "train" and sorted(got[x] for x in "cef") == ["calibration", "test", "train"]


@pytest.mark.parametrize("n,want", [(3, (1, 1, 1)), (4, (2, 1, 1)), (5, (3, 1, 1)), (10, (6, 2, 2)), (13, (9, 2, 2))])
def test_unit_counts(spark, n, want):
    units = spark.createDataFrame([("d", f"u{k}") for k in range(n)], "dataset string, donor string")
    got = [r["partition"] for r in sp.allocate(units, ["dataset"], "donor", 0).collect()]
    assert tuple(got.count(p) for p in sp.PARTS) == want


def test_too_few_units(index, spark):
    with pytest.raises(Exception, match="fewer units"):
        sp.s3(index.filter("group = 'G1'"), 0).collect()


def test_guards_fire(index):
    s1 = sp.s1(index, 0)
    for scheme in (sp.S2, sp.S3):
        with pytest.raises(sp.LeakageError):
            sp.guard(index, s1.select(F.lit(scheme).alias("scheme"), F.lit(0).alias("seed"), F.lit("").alias("holdout_group"), "cell_id", "partition"))
    named = sp.many(index, [sp.Split(sp.S1, 0)])
    with pytest.raises(sp.LeakageError):
        sp.guard(index, named.filter("partition <> 'test'"))
    with pytest.raises(sp.LeakageError):
        sp.read_parts(s1, ["train", "calibration"])
    assert sp.read_parts(s1, ["train", "test"]).filter("partition = 'calibration'").count() == 0
    with pytest.raises(ValueError):
        sp.check_index(index.withColumn("label", F.when(F.rand(1) > 0.1, F.col("label"))))
    with pytest.raises(ValueError):
        sp.check_index(index.unionByName(index.limit(1)))
    with pytest.raises(ValueError):
        sp.check_index(index.drop("donor"))
    with pytest.raises(ValueError):
        sp.s3(index, 0, "nowhere")
    with pytest.raises(ValueError):
        sp.make(index, sp.Split("S9", 0))


def test_alignment_and_manifest(index):
    s = sp.s1(index, 0)
    assert sp.aligned(index, s).count() == 0
    assert sp.aligned(index, s.limit(10)).count() == index.count() - 10
    row = sp.manifest(index, sp.many(index, [sp.Split(sp.S2, 0)])).first()
    assert row["n_train"] + row["n_calibration"] + row["n_test"] == index.count() and row["classes_learnable"] == 7 and row["datasets_test"] == 6


def test_store_replaces_only_its_splits(index, spark, tmp_path):
    sp.store(sp.many(index, [sp.Split(sp.S1, 0), sp.Split(sp.S1, 1)]), str(tmp_path))
    sp.store(sp.many(index, [sp.Split(sp.S1, 1)]), str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).count() == 2 * index.count()
