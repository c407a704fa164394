"""Calibration and pivotal draws: moments, floors, gaps, expectations, spread over rows, odd rows."""

import numpy as np

from gridloom.llm import targets


def test_budgets_however_spelt(spark):
    b = spark.createDataFrame([(" 2,000",), ("50 cells",), ("25.0",), ("all",), ("2.5",), (None,), ("",), ("99999999999999",)], "b string")
    assert [r[0] for r in b.select(targets.whole_budget(b.b)).collect()] == [2000, 50, 25, None, None, None, None, None]


def test_newton_meets_the_moments():
    stock = np.array([[1000.0, 50, 3, 0], [10, 10, 10, 10]])
    want = np.array([[60.0, 30, 3, 0], [10, 0.5, 2, 7]])
    assert np.allclose(targets.tilted(stock, want, np.array([93.0, 20.0])), want, atol=1e-6)


def test_floors_shares_and_stocks():
    share, floor = np.array([0.7, 0.2, 0.1]), np.array([1.0, 1.0, 8.0])
    stock = np.array([[1000.0, 1000, 1000], [1000, 2, 1000], [5, 1000, 3], [0, 0, 0]])
    got = targets.shared_out(stock, share, floor, np.full(4, 50.0))
    assert np.allclose(got[0], [42 * 7 / 9, 42 * 2 / 9, 8]) and np.allclose(got[0].sum(), 50)
    assert got[1][1] == 2 and np.isclose(got[1].sum(), 50) and np.allclose(got[2], [5, 42, 3]) and not got[3].any()


def test_pivotal_keeps_expectations_and_totals():
    part = np.tile([0.3, 1.7, 0.25, 2.0, 0.75], (20000, 1))
    got = targets.pivotal(part, np.arange(1, 20001, dtype=np.int64) * 7919)
    assert np.abs(got.sum(axis=1) - 5).max() <= 1e-9 and (np.abs(got - part) < 1).all()
    assert np.abs(got.mean(axis=0) - part[0]).max() < 0.02
    assert (targets.pivotal(part[:5], np.arange(5)) == targets.pivotal(part[:5], np.arange(5))).all()


def test_sample_over_rows_matches_the_report(spark):
    rows = [(n, "x" if n % 3 else "y", 1 + n % 2, None if n == 7 else n % 5) for n in range(60)] + [(100, None, 1, 5), (101, "z", 0, 4), (102, "x", 9, 4)]
    stock = spark.createDataFrame(rows, "row_id int, dataset string, class_id int, cells int").fillna(0, ["cells"])
    budgets = spark.createDataFrame([(10,), (10,), (40,), (None,)], "budget int")
    wanted = spark.createDataFrame([(1, 60, 2), (2, 40, 30)], "class_id int, share_pct int, min_cells int")
    report = targets.calibrated(stock, budgets, wanted).cache()
    assert report.count() == 3 * 2 * 2
    at = {(r["dataset"], r["budget"], r["class_id"]): r for r in report.collect()}
    assert at["x", 10, 1]["asked"] == 6 and at["x", 40, 1]["asked"] == 24 and at["x", 10, 2]["asked"] == 30
    assert all(r["taken"] <= r["available"] and abs(r["taken"] - r["target"]) <= 1 for r in at.values()) and at["z", 10, 1]["taken"] == 0
    drawn = targets.drawn(stock, report).collect()
    sums, cells = {}, {r[0]: r[3] for r in rows}
    for r in drawn:
        assert 0 < r["n_take"] <= cells[r["row_id"]]
        sums[r["dataset"], r["budget"], r["class_id"]] = sums.get((r["dataset"], r["budget"], r["class_id"]), 0) + r["n_take"]
    assert sums == {k: r["taken"] for k, r in at.items() if r["taken"]}


def test_empty(spark):
    stock = spark.createDataFrame([], "row_id int, dataset string, class_id int, cells int")
    budgets, wanted = spark.createDataFrame([(5,)], "budget int"), spark.createDataFrame([(1, 100, 2)], "class_id int, share_pct int, min_cells int")
    assert targets.calibrated(stock, budgets, wanted).count() == 0
    some = spark.createDataFrame([(1, "a", 1, 5)], stock.schema)
    assert targets.calibrated(some, budgets, wanted.limit(0)).count() == targets.calibrated(some, budgets.limit(0), wanted).count() == 0
