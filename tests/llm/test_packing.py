"""Windows against capacity, volume and best fit; cutting, odd rows, repeatability."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import packing


def _best_fit(sizes, capacity):
    room = []
    for x in sorted(sizes, reverse=True):
        fits = [(r - x, i) for i, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits)[1]] -= x
        else:
            room.append(capacity - x)
    return len(room)


@pytest.mark.parametrize("low,high,n", [(50, 800, 1024), (900, 1200, 512), (1, 2048, 512), (1020, 1030, 300), (1, 3, 2000), (2048, 2049, 5)])
def test_windows_near_the_best(low, high, n):
    sizes = np.random.default_rng(0).integers(low, high, n)
    part = packing.windows(sizes, 2048)
    load = np.bincount(part, weights=sizes)
    assert load.max() <= 2048 and load.min() > 0 and load.sum() == sizes.sum()
    assert len(load) <= _best_fit(sizes.tolist(), 2048) * 1.01 + 1


def test_differencing_is_even():
    sizes = np.random.default_rng(1).integers(1, 100, 400)
    load = np.bincount(packing.difference(sizes, 20), weights=sizes)
    assert load.max() - load.min() <= 0.05 * load.mean()


def test_pack_rows(spark):
    rows = [(1, "tok " * 3000, "a"), (2, "short text", "b"), (3, None, "c"), (4, "", "d"), (2, "short text", "e"), (5, "tok " * 2048, "f")]
    df = spark.createDataFrame(rows, "doc_id int, text string, window string")
    out = packing.pack(df).cache()
    assert {r["doc_id"] for r in packing.cut_texts(out).collect()} >= {1}
    got = out.filter("doc_id = 1").orderBy("piece").collect()
    assert [r["piece"] for r in got] == list(range(len(got))) and len(got) > 1 and got[0]["n_tokens"] == 2048 and got[1]["start"] == 2048
    assert out.filter("doc_id IN (3, 4) AND window IS NULL AND n_tokens = 0").count() == 2 and out.filter("doc_id = 2").count() == 2
    assert out.groupBy("window").agg(F.sum("n_tokens").alias("n")).filter("n > 2048").count() == 0
    assert out.dtypes[0] == ("doc_id", "int") and packing.pack(df.limit(0)).count() == 0


def test_small_batches_still_fit(spark):
    df = spark.createDataFrame([(n, "word " * (n % 700 + 1)) for n in range(600)], "doc_id long, text string").coalesce(1)
    loads = packing.pack(df, batch=50).groupBy("window").agg(F.sum("n_tokens").alias("n"))
    assert loads.filter("n > 2048").count() == 0


def test_missing_tokenizer(spark):
    with pytest.raises(FileNotFoundError):
        packing.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer="/nowhere/x.tiktoken")
