"""The k most similar vectors of every vector: a vantage-point tree per shard, and one over the shards.

Distances are angles, which obey the triangle inequality. A node keeps a vantage point and
the median distance to it; the rows nearer than the median go inside, the others outside. A
query whose k nearest lie within the angle t needs a side only if its own distance to the
vantage point is within t of it. That margin is divided by `factor`: 1 keeps the search
exact, more trades recall for far fewer branches, since the distances of two close vectors
to a third differ by much less than their own angle in many dimensions.

The shards are the leaves of a small tree fitted on a bounded sample. Every row lives in
one shard and visits, as a query, the shards its margin reaches, so work grows with the
branches taken and not with rows times shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 120_000  #: vectors of a shard, about 30 MB of floats
FIT_ROWS = 20_000  #: bound of the sample that the tree over the shards is fitted on
LEAF = 128  #: vectors of a leaf, compared one by one
FACTOR = 5.0  #: of relaxation; the README has the recall measured at it
CHUNK = 4_000_000  #: candidates kept before they are cut to k a query


def usable(df: DataFrame, emb: str = "emb", width: int = 64) -> DataFrame:
    """Rows whose vector has `width` finite numbers, none null, not all zero."""
    c = F.col(f"`{emb}`")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter((F.size(c) == width) & ~bad & F.exists(c, lambda x: x != 0))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest number first, so nothing overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def angles(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ centre, -1.0, 1.0))


@dataclass
class Tree:
    """Nodes by number: a vantage point, a median and two children, or a leaf's range of rows."""

    centre: np.ndarray
    median: np.ndarray
    inside: np.ndarray  # -1 at leaves
    outside: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    rows: np.ndarray  # the rows in leaf order


def plant(v: np.ndarray, leaf: int, seed: int = 7) -> Tree:
    """A vantage-point tree whose leaves have at most `leaf` rows, or rows that all lie equally far."""
    rng = np.random.default_rng(seed)
    rows = np.arange(len(v))
    centre: list[np.ndarray] = []
    median: list[float] = []
    kids: list[list[int]] = []
    span: list[tuple[int, int]] = []

    def add(lo: int, hi: int) -> int:
        centre.append(np.zeros(v.shape[1], np.float32))
        median.append(0.0)
        kids.append([-1, -1])
        span.append((lo, hi))
        return len(span) - 1

    todo = [add(0, len(v))]
    while todo:
        at = todo.pop()
        lo, hi = span[at]
        if hi - lo <= leaf:
            continue
        mine = rows[lo:hi]
        # The vantage point that spreads a few rows most.
        probe = v[rng.choice(mine, min(64, len(mine)), replace=False)]
        tries = v[rng.choice(mine, min(6, len(mine)), replace=False)]
        best = tries[np.arccos(np.clip(tries @ probe.T, -1, 1)).std(axis=1).argmax()]
        d = angles(v[mine], best)
        cut = len(mine) // 2
        order = np.argpartition(d, cut)
        mu = float(d[order[cut]])
        near = d < mu
        if not near.any():
            near = d <= mu
            if near.all():
                continue
            mu = float(np.nextafter(np.float32(mu), np.float32(4)))
        rows[lo:hi] = np.concatenate([mine[near], mine[~near]])
        middle = lo + int(near.sum())
        centre[at], median[at] = best, mu
        kids[at] = [add(lo, middle), add(middle, hi)]
        todo += kids[at]
    k = np.array(kids)
    s = np.array(span)
    return Tree(np.array(centre), np.array(median), k[:, 0], k[:, 1], s[:, 0], s[:, 1], rows)


def descend(tree: Tree, q: np.ndarray, margin: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, queries that reach it); a query goes to each side that its margin touches."""
    todo = [(0, np.arange(len(q)))]
    while todo:
        at, who = todo.pop()
        if not len(who):
            continue
        if tree.inside[at] < 0:
            yield at, who
            continue
        off = angles(q[who], tree.centre[at]) - tree.median[at]
        m = margin[who]
        todo += [(int(tree.inside[at]), who[off < m]), (int(tree.outside[at]), who[off >= -m])]


def _cut(q: np.ndarray, x: np.ndarray, cos: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best candidates of each query; of equals those whose row ranks first."""
    order = np.lexsort((rank[x], -cos, q))
    q, x, cos = q[order], x[order], cos[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[place < k], x[place < k], cos[place < k]


def search(
    v: np.ndarray, q: np.ndarray, home: np.ndarray, reach: np.ndarray, rank: np.ndarray, k: int, factor: float, leaf: int = LEAF
) -> tuple[np.ndarray, ...]:
    """(query, row, cosine) of the k nearest rows of v within `reach` of each query.

    home has the row of v that a query is itself, or -1. A first pass over each row's own
    leaf narrows the reach of those that already have k rows nearby.
    """
    tree = plant(v, leaf)
    reach = reach.astype(np.float64).copy()
    own = np.full(len(v), -1)
    own[home[home >= 0]] = np.flatnonzero(home >= 0)
    for at in np.flatnonzero(tree.inside < 0):
        mine = tree.rows[tree.begin[at] : tree.end[at]]
        if k < len(mine) <= 8 * leaf:
            kth = np.partition(v[mine] @ v[mine].T, len(mine) - 1 - k, axis=1)[:, len(mine) - 1 - k]
            asks = own[mine]
            bound = np.arccos(np.clip(kth[asks >= 0] - 1e-6, -1, 1))
            reach[asks[asks >= 0]] = np.minimum(reach[asks[asks >= 0]], bound)
    least = np.cos(np.minimum(reach, np.pi)).astype(np.float32) - np.float32(1e-5)
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0
    for at, who in descend(tree, q, reach / factor):
        rows = tree.rows[tree.begin[at] : tree.end[at]]
        for lo in range(0, len(rows), 1024):
            some = rows[lo : lo + 1024]
            for a in range(0, len(who), 4096):
                ask = who[a : a + 4096]
                near = q[ask] @ v[some].T
                i, j = np.nonzero(near >= least[ask][:, None])
                i, j = ask[i], some[j]
                ok = home[i] != j
                i, j = i[ok], j[ok]
                if len(i):
                    parts.append((i, j, np.einsum("ij,ij->i", q[i], v[j], dtype=np.float64)))
                    held += len(i)
                if held > CHUNK:
                    parts = [_cut(*(np.concatenate(c) for c in zip(*parts, strict=True)), rank, k)]
                    held = min(len(parts[0][0]), CHUNK // 2)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return _cut(*(np.concatenate(c) for c in zip(*parts, strict=True)), rank, k)


def _matrix(column, width: int) -> np.ndarray:
    """Arrow lists of equal width as rows of unit length."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), np.float32)
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64))


def nearest(
    df: DataFrame,
    key: str = "cell_id",
    emb: str = "emb",
    width: int = 64,
    k: int = 5,
    least: float | None = None,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(id, other, cos, place): the k most similar others of every usable vector, best first.

    Equal cosines are ordered by id. With `least`, only neighbours of at least that cosine
    are looked for, which also bounds every search; without it each query starts from the
    k nearest of its sample leaf. Vectors that are not usable and null ids give no row and
    are no neighbour; a row that is there twice counts once, and an empty table gives an
    empty result. Other columns are not read.

    Exact copies of a vector are searched once. Of a group of copies only the k + 1
    smallest ids appear: they fill the k places of every row that is close to the group,
    so a group that holds a third of all rows costs one row, and its other members have
    no row here (their neighbours are the k smallest ids of their own group).
    """
    spark = df.sparkSession
    rows = usable(df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{emb}`").alias("v")), "v", width).filter("id IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    # dense_rank, as an id may come twice; the limit is applied before the shuffle, too, and
    # all three windows share it.
    by_copy = Window.partitionBy("v").orderBy("id")
    classes = (
        rows.withColumn("_n", F.dense_rank().over(by_copy))
        .filter(F.col("_n") <= k + 1)
        .withColumn("ids", F.sort_array(F.collect_set("id").over(Window.partitionBy("v"))))
        .withColumn("_n", F.row_number().over(by_copy))
        .filter("_n = 1")
        .select("v", "ids")
    )
    total = rows.count()
    shards = max(1, -(-total // shard_rows))
    far = float(np.arccos(least)) if least is not None else np.pi
    top = None
    if shards > 1:
        slots = 1 << 30
        some = rows.filter(F.pmod(F.xxhash64("v"), F.lit(slots)) < int(slots * fit_rows / total)).limit(2 * fit_rows)
        fit = unit(np.array([r[0] for r in some.select("v").collect()], np.float64))
        fit = np.unique(fit, axis=0)
        top = spark.sparkContext.broadcast((plant(fit, max(k + 1, len(fit) // shards)), fit))

    def route(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for f in frames:
            q = _matrix(f.column(0), width)
            bound = np.full(len(q), far)
            if top is None:
                where, who, lives = np.zeros(len(q), np.int32), np.arange(len(q)), np.ones(len(q), bool)
            else:
                tree, fit = top.value
                # The nearest rows of the sample are rows of the table: the k-th bounds the search.
                here = np.zeros(len(q), np.int32)
                for at, ask in descend(tree, q, np.zeros(len(q))):  # no margin: one leaf each
                    here[ask] = at
                    mine = fit[tree.rows[tree.begin[at] : tree.end[at]]]
                    if len(mine) > k:
                        near = np.partition(q[ask] @ mine.T, len(mine) - 1 - k, axis=1)[:, len(mine) - 1 - k]
                        bound[ask] = np.minimum(far, np.arccos(np.clip(near - 1e-6, -1, 1)))
                got = [(np.full(len(ask), at, np.int32), ask) for at, ask in descend(tree, q, bound / factor)]
                where, who = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (here[:0], here[:0])
                lives = here[who] == where
            whole = pa.Table.from_batches([f]).take(pa.array(who))
            for name, column in (("shard", pa.array(where, pa.int32())), ("home", pa.array(lives)), ("reach", pa.array(bound[who]))):
                whole = whole.append_column(name, column)
            yield from whole.to_batches()

    def close(table):
        import pyarrow as pa

        table = table.combine_chunks()
        lives = table["home"].to_numpy()
        q = _matrix(table["v"], width)
        at = np.flatnonzero(lives)
        home = np.full(len(q), -1)
        home[at] = np.arange(len(at))
        ids = table["ids"].combine_chunks()
        name = np.array([x[0].as_py() for x in ids], object)
        rank = np.argsort(np.argsort(name[at], kind="stable"), kind="stable")
        i, j, cos = search(q[at], q, home, table["reach"].to_numpy(), rank, k, factor) if len(at) else (at, at, np.zeros(0))
        if least is not None:
            i, j, cos = i[cos >= least], j[cos >= least], cos[cos >= least]
        j = at[j]
        copies = at[np.array([len(ids[int(r)]) > 1 for r in at], bool)] if len(at) else at
        a, b = np.concatenate([i, copies]), np.concatenate([j, copies])
        c = np.concatenate([np.minimum(cos, 1.0), np.ones(len(copies))])
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "cos": pa.array(c, pa.float64())})

    spread = classes.mapInArrow(route, f"v array<float>, ids array<{kind}>, shard int, home boolean, reach double")
    found = spread.groupBy("shard").applyInArrow(close, f"a array<{kind}>, b array<{kind}>, cos double")
    each = found.select(F.explode("a").alias("id"), "b", "cos").select("id", F.explode("b").alias("other"), "cos").filter("id <> other")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "other"))
    return each.groupBy("id", "other").agg(F.max("cos").alias("cos")).withColumn("place", place).filter(F.col("place") <= k)


def mutual(df: DataFrame, key: str = "cell_id", emb: str = "emb", k: int = 5, least: float = 0.93, **how) -> DataFrame:
    """(key_a, key_b), smaller first: each among the k most similar of the other, cosine `least` or more."""
    top = nearest(df, key, emb, k=k, least=least, **how)
    ends = top.select(F.least("id", "other").alias(f"{key}_a"), F.greatest("id", "other").alias(f"{key}_b"))
    return ends.groupBy(f"{key}_a", f"{key}_b").agg(F.count("*").alias("n")).filter("n = 2").drop("n")
