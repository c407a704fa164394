"""Components against union-find, incremental growth, proportions, quarantine, hot keys, odd rows."""

import random

from pyspark.sql import functions as F

from gridloom.llm import components as co
from gridloom.llm import skew


def _tied(spark, rows):
    return spark.createDataFrame([(f"0{d}", t) for d, t in rows], "node string, tie string")


def _records(spark, weights):
    return spark.createDataFrame(list(weights.items()), "dataset string, n_donors int")


def test_identifiers_however_written(spark):
    manifest = spark.createDataFrame(
        [("a", "XSE1", "10.9/x.1"), ("b", "(xse-2)", "DOI 10.9/X.1."), ("c", "XSE3", None), ("d", "XSE2b", "NA"), ("e", "NA", "NA"), ("f", None, "-"), (None, "XSE1", None), ("a", "XSE1", "10.9/x.1")],
        "dataset string, ldo_group string, doi string",
    )
    splits = spark.createDataFrame([("XSE 2 & acc:XSE3",), ("XSE2b",), (None,), ("XSE 2 & acc:XSE3",)], "holdout_group string")
    got = {tuple(r) for r in co.components(co.ties(manifest, splits)).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a")}


def test_random_graph_and_long_chain(spark):
    rng = random.Random(1)
    rows = [(f"d{rng.randrange(60):02}", f"t{rng.randrange(50)}") for _ in range(70)] + [(f"z{n:02}", f"u{n + k}") for n in range(40) for k in (0, 1)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for d, t in rows:
        a, b = sorted((find(d), find(t)))
        up[b] = a
    sets = {}
    for d, _ in rows:
        sets.setdefault(find(d), set()).add(d)
    want = {(d, min(s)) for s in sets.values() if len(s) > 1 for d in s}
    assert {tuple(r) for r in co.components(_tied(spark, rows)).collect()} == want


def test_hot_keys_are_split_and_lose_nothing(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("r"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("r").alias("least"))
    out = skew.spread_join(rows, table, "k", "r", hot=20)
    assert out.columns == ["k", "r", "least"] and out.count() == 500 and out.filter("k = 'hot'").select("least").distinct().count() == 1
    total = skew.running_total(rows.withColumn("v", F.lit(2)), ["k"], "v", "r", "at")
    assert sorted(r[0] for r in total.filter("k = 'hot'").select("at").collect()) == list(range(0, 2 * 167, 2))


def test_shares_and_whole_components(spark):
    rng = random.Random(2)
    weights = {f"d{n:03}": rng.randrange(1, 9) for n in range(600)}
    weights["d000"] = 200
    rows = [(f"d{n:03}", f"t{n // 3}") for n in range(300)]
    got = co.dealt(_records(spark, weights), _tied(spark, rows)).collect()
    assert len(got) == 600 and all(r["status"] == "new" for r in got)
    part = {}
    for r in got:
        assert part.setdefault(r["root_dataset"], r["partition"]) == r["partition"]
    total = sum(weights.values())
    for p, f in co.FRACTIONS:
        assert abs(sum(r["weight"] for r in got if r["partition"] == p) / total - f) < 0.02


def test_old_components_keep_their_split_and_conflicts_are_quarantined(spark):
    before = spark.createDataFrame(
        [("a", "a", 1.0, "train", "new"), ("b", "a", 1.0, "train", "new"), ("c", "c", 1.0, "test", "new"), ("q", "q", 1.0, "quarantine", "conflict")],
        "dataset string, root_dataset string, weight double, partition string, status string",
    )
    records = _records(spark, {"a": 1, "b": 1, "c": 1, "q": 1, "n": 1, "m": None, "x": 5})
    grown = co.dealt(records, _tied(spark, [("n", "t1"), ("b", "t1")]), before=before)
    got = {r["dataset"]: (r["root_dataset"], r["partition"], r["status"]) for r in grown.collect()}
    assert got["n"] == got["a"] == got["b"] == ("a", "train", "kept") and got["c"] == ("c", "test", "kept")
    assert got["q"][1:] == ("quarantine", "conflict") and got["x"][2] == got["m"][2] == "new"
    merged = co.dealt(records, _tied(spark, [("a", "t"), ("c", "t")]), before=before)
    assert {r["dataset"]: r["partition"] for r in merged.collect() if r["root_dataset"] == "a"} == dict.fromkeys("abc", "quarantine")


def test_empty_tables(spark):
    none = _tied(spark, [("a", "t")]).limit(0)
    assert co.components(none).count() == 0
    assert co.dealt(_records(spark, {"a": 1}).limit(0), none).count() == 0
    assert [r["partition"] for r in co.dealt(_records(spark, {"a": None}), none).collect()][0] in {"train", "calibration", "test"}
