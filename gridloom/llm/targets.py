"""Samples whose shares of each category match targets, with floors and a report of the gaps.

The table is first added up to cells per dataset and category; from there on a sample is a
few numbers per dataset and budget, computed in batches of numpy without gathering a group.
Back at the rows, the cells of a category are spread by running totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.skew import running_total

ROUNDS = 60  #: Newton steps at most; they end when all moments are met
MOST_CATEGORIES = 10_000  #: the target list is broadcast as a literal


def whole_budget(text: Column) -> Column:
    """A budget written as a whole number of cells, however spelt; null for all others."""
    plain = F.regexp_replace(F.lower(text), r"[\s,_']", "")
    found = F.regexp_extract(plain, r"^(\d+)(?:\.0*)?(?:cells?)?$", 1)
    return F.when(found != "", found.try_cast("int"))


def tilted(stock: np.ndarray, want: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Expected cells per category: inclusion probabilities tilted until the moments match.

    Every cell starts with the probability budget / cells and category c's is multiplied by
    exp(x_c), one at most. The dual of the smallest change is concave in x and separable,
    so Newton's steps are x += (want - moment) / moment per category, kept to 2. `want` is at most
    the stock. Rows are datasets and budgets.
    """
    total = stock.sum(axis=1, keepdims=True)
    base = np.clip(budget[:, None] / np.maximum(total, 1), 1e-300, 1.0)
    x = np.zeros_like(want)
    sane = (stock > 0) & (want > 0)
    for _ in range(ROUNDS):
        moment = stock * np.minimum(base * np.exp(x), 1.0)
        gap = np.where(sane, want - moment, 0.0)
        if np.abs(gap).max(initial=0.0) < 1e-9 * max(1.0, want.max(initial=0.0)):
            break
        x += np.clip(np.where(sane, gap / np.maximum(moment, 1e-300), 0.0), -2.0, 2.0)
    return np.where(sane, np.minimum(stock * np.minimum(base * np.exp(x), 1.0), stock), 0.0)


def shared_out(stock: np.ndarray, share: np.ndarray, floor: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """What each category should get of each budget: floors and stocks are kept to, the rest goes by share.

    Floors come first; if they exceed the budget, the budget grows to them. A category at its
    floor or out of stock is fixed and what is left is shared among the others anew.
    """
    least = np.minimum(floor[None, :], stock)
    want = np.zeros_like(stock)
    fixed = np.zeros(stock.shape, bool)
    for _ in range(2 * stock.shape[1] + 1):
        room = np.maximum(budget - np.where(fixed, want, 0.0).sum(axis=1), 0.0)
        free = np.where(fixed, 0.0, share[None, :])
        level = room / np.maximum(free.sum(axis=1), 1e-300)
        now = np.where(fixed, want, free * level[:, None])
        low, high = ~fixed & (now < least), ~fixed & (now > stock)
        # One side at a time, the one that is further off, as fixing it moves the other.
        under, over = np.where(low, least - now, 0).sum(axis=1), np.where(high, now - stock, 0).sum(axis=1)
        take = np.where((under >= over)[:, None], low, high)
        want = np.where(take, np.where(low, least, stock), now)
        fixed |= take
        if not take.any():
            break
    return np.clip(want, least, stock)


def pivotal(part: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whole numbers with the given expectations, by duels of the fractions.

    Two fractions a and b become a + b and 0, or 1 and a + b - 1, so that each keeps its
    expectation; the open one duels the next. Sums of neighbours are kept to within one.
    Rows are independent; key seeds the draws, so a lost task draws the same again.
    """
    whole = np.floor(part + 1e-9)
    rest = np.clip(part - whole, 0.0, 1.0)
    rest[rest < 1e-9] = 0.0
    rows = np.arange(len(part))
    open_at = np.zeros(len(part), np.int64)
    out = rest.copy()
    state = key.astype(np.uint64) | np.uint64(1)

    def draw() -> np.ndarray:
        nonlocal state
        for shift, left in ((13, True), (7, False), (17, True)):
            state = state ^ (state << np.uint64(shift) if left else state >> np.uint64(shift))
        return (state * np.uint64(0x2545F4914F6CDD1D) >> np.uint64(11)).astype(np.float64) / float(1 << 53)

    for _ in range(4):
        draw()
    for c in range(1, part.shape[1]):
        a, b, u = out[rows, open_at], out[:, c], draw()
        s = a + b
        small = s < 1
        with np.errstate(divide="ignore", invalid="ignore"):
            stays = np.where(small, u < np.where(s > 0, a / s, 1.0), u < np.where(s < 2, (1 - b) / (2 - s), 0.5))
        # Below one: the winner takes the sum; else the winner is taken and the loser keeps the rest.
        new_a = np.where(small, np.where(stays, s, 0.0), np.where(stays, 1.0, s - 1))
        new_b = np.where(small, np.where(stays, 0.0, s), np.where(stays, s - 1, 1.0))
        out[rows, open_at], out[:, c] = new_a, new_b
        is_open = lambda x: (x > 1e-9) & (x < 1 - 1e-9)
        open_at = np.where(is_open(new_b) | ~is_open(new_a), c, open_at)
    last = out[rows, open_at]
    out[rows, open_at] = np.where((last > 1e-9) & (last < 1 - 1e-9), draw() < last, last > 0.5)
    return whole + np.round(out)


def calibrated(stock: DataFrame, budgets: DataFrame, wanted: DataFrame, seed: int = 0) -> DataFrame:
    """(dataset, budget, class_id, asked, available, target, taken, share) for every dataset, budget and category.

    stock has (dataset, class_id, cells) in any number of rows; null cells and classes that
    are not wanted count nothing, and a dataset with none of the classes is there with
    zeros. wanted has (class_id, share_pct, min_cells). `asked` is the larger of the floor and
    the rounded-up share, `target` the expectation that floors and stocks leave room for, `taken` the
    whole number drawn, `share` its part of the sample. Available below asked is a gap.
    """
    goals = sorted((r["class_id"], r["share_pct"], r["min_cells"]) for r in wanted.select("class_id", "share_pct", "min_cells").distinct().limit(MOST_CATEGORIES + 1).collect())
    if len(goals) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    ids = [g[0] for g in goals]
    share, floor = (np.array([g[n] for g in goals], np.float64) for n in (1, 2))
    # One partial aggregate per category before the shuffle: a dataset with a third of all rows sends one row a task.
    sums = [F.coalesce(F.sum(F.when(F.col("class_id") == c, F.col("cells"))), F.lit(0)).cast("double") for c in ids]
    wide = stock.filter("dataset IS NOT NULL").groupBy("dataset").agg(F.array(*sums).alias("cells") if sums else F.array().cast("array<double>").alias("cells"))
    few = sorted(r[0] for r in budgets.select("budget").filter("budget > 0").distinct().limit(MOST_CATEGORIES + 1).collect())
    if len(few) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} budgets")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b in few if ids else []:
                have = np.array(f["cells"].tolist(), np.float64).reshape(len(f), len(ids))
                size = np.full(len(f), float(b))
                goal = shared_out(have, share / max(share.sum(), 1e-300), floor, size)
                mean = tilted(have, goal, size)
                taken = np.minimum(pivotal(mean, f["_key"].to_numpy() ^ np.int64(b * 2654435761 + seed)), have)
                yield pd.DataFrame(
                    {
                        "dataset": np.repeat(f["dataset"].to_numpy(), len(ids)),
                        "budget": b,
                        "class_id": np.tile(ids, len(f)),
                        "asked": np.tile(np.maximum(floor, np.ceil(share * b / 100 - 1e-9)), len(f)).astype(np.int64),
                        "available": have.ravel().astype(np.int64),
                        "target": mean.ravel(),
                        "taken": taken.ravel().astype(np.int64),
                        "share": (taken / np.maximum(taken.sum(axis=1, keepdims=True), 1)).ravel(),
                    }
                )

    schema = "dataset string, budget int, class_id int, asked bigint, available bigint, target double, taken bigint, share double"
    return wide.withColumn("_key", F.xxhash64("dataset")).mapInPandas(run, schema)


def drawn(stock: DataFrame, report: DataFrame, row: str = "row_id") -> DataFrame:
    """(row, dataset, budget, class_id, n_take): the cells each row gives, rows that give none left out.

    The taken cells of a category are every (available / taken)-th of its cells in a random
    order of rows, so each cell has the same chance, no row gives more than it has, and the
    sums are the report's.
    """
    placed = running_total(stock.filter("cells > 0 AND dataset IS NOT NULL"), ["dataset", "class_id"], "cells", row, "_from")
    asked = report.filter("taken > 0").select("dataset", "class_id", "budget", "available", "taken")
    start = F.pmod(F.xxhash64("dataset", "class_id", "budget"), F.lit(1 << 20)) / float(1 << 20)
    upto = lambda c: F.floor(c * F.col("taken") / F.col("available") + start)
    # Exact in 64 bits would overflow for huge stocks; a decimal would not, a double is off by far less than a cell up to 2^53.
    out = placed.join(asked, ["dataset", "class_id"]).withColumn("n_take", (upto(F.col("_from") + F.col("cells")) - upto(F.col("_from"))).cast("bigint"))
    return out.filter("n_take > 0").select(row, "dataset", "budget", "class_id", "n_take")
