"""The k nearest against brute force, over one shard and many, with copies and unusable rows."""

import numpy as np
import pytest

from gridloom.llm import neighbours


def _rows(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(150, 8))
    v = np.concatenate([base, base[:60] * 3 + rng.normal(size=(60, 8)) * 0.2]).astype(np.float32)
    return [(f"c{n:03}", [float(x) for x in e]) for n, e in enumerate(v)]


def _table(spark, rows):
    return spark.createDataFrame(rows, "cell_id string, emb array<float>")


def _brute(rows, k):
    v = np.array([e for _, e in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cos = v @ v.T
    np.fill_diagonal(cos, -2)
    return {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in np.argsort(-cos[i], kind="stable")[:k]}


@pytest.mark.parametrize("shard_rows", [1000, 50])
def test_factor_one_is_exact(spark, shard_rows):
    rows = _rows()
    got = neighbours.nearest(_table(spark, rows), width=8, k=3, factor=1.0, shard_rows=shard_rows, fit_rows=120)
    assert {(r["id"], r["other"]) for r in got.collect()} == _brute(rows, 3)


def test_relaxed_search_keeps_nine_of_ten_near_pairs():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4000, 64))
    v = neighbours.unit(np.concatenate([base, base[:500] + rng.normal(size=(500, 64)) * 0.2]))
    n = np.arange(len(v))
    i, j, _ = neighbours.search(v, v, n, np.full(len(v), np.arccos(0.93)), n, 5, neighbours.FACTOR)
    pairs = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    true = {(a, 4000 + a) for a in range(500) if float(v[a] @ v[4000 + a]) >= 0.93}
    assert len(true) > 400 and len(pairs & true) / len(true) >= 0.9


def test_copies_repeats_and_unusable_rows(spark):
    one, two = [1.0] + [0.0] * 7, [0.99] + [0.1] * 7
    rows = [(f"a{n}", one) for n in range(40)] + [("a0", one), ("b", two), ("z", [0.0] * 8), ("n", [float("nan")] * 8), ("s", [1.0]), ("e", []), ("u", None), (None, one)]
    got = {tuple(r) for r in neighbours.mutual(_table(spark, rows), k=2, least=0.9, width=8, factor=1.0).collect()}
    assert got == {("a0", "a1"), ("a0", "a10"), ("a1", "a10")}


def test_empty_and_clashing_columns(spark):
    df = _table(spark, _rows()[:3])
    assert neighbours.mutual(df.limit(0), width=8).count() == 0
    clash = df.selectExpr("cell_id", "emb", "1 AS id", "2 AS v", "3 AS shard", "4 AS other")
    assert neighbours.nearest(clash, width=8, k=2, factor=1.0).count() == 6
