"""Numeric fits, each in one group of rows whose size the caller bounds.

A design has thousands of small fits, so a fit is a task: one group per run, no Spark job
per iteration. The rows of a run are its label budget times its classes, and at an
unrestricted budget the training partition; the latter is the one unbounded case, for which
fit_distributed() gives the same objective to MLlib.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Multinomial:
    """Multinomial logistic regression: half the squared weights plus C times the weighted loss.

    Balanced class weights, intercepts unpenalised, L-BFGS in double precision.
    """

    def __init__(self, c: float = 1.0, most: int = 500, tolerance: float = 1e-6):
        self.c, self.most, self.tolerance = c, most, tolerance

    def _loss(self, theta: np.ndarray, x: np.ndarray, hot: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        k, d = hot.shape[1], x.shape[1]
        weights, bias = theta[: k * d].reshape(k, d), theta[k * d :]
        z = x @ weights.T + bias
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        total = e.sum(axis=1, keepdims=True)
        loss = 0.5 * (weights**2).sum() + self.c * (w * (np.log(total[:, 0]) - (z * hot).sum(axis=1))).sum()
        r = self.c * w[:, None] * (e / total - hot)
        return loss, np.concatenate([(r.T @ x + weights).ravel(), r.sum(axis=0)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Multinomial:
        self.classes, at = np.unique(y, return_inverse=True)
        k, n = len(self.classes), len(y)
        hot = np.eye(k)[at]
        w = (n / (k * hot.sum(axis=0)))[at]
        x = np.asarray(x, np.float64)
        theta = np.zeros(k * x.shape[1] + k)
        f, g = self._loss(theta, x, hot, w)
        old: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(self.most):
            if np.abs(g).max() <= self.tolerance * max(1.0, self.c):
                break
            p, coef = g.copy(), []
            for s, t in reversed(old):
                a = (s @ p) / (s @ t)
                coef.append(a)
                p -= a * t
            if old:
                s, t = old[-1]
                p *= (s @ t) / (t @ t)
            for (s, t), a in zip(old, reversed(coef), strict=True):
                p += s * (a - (t @ p) / (s @ t))
            step, slope = (1.0 if old else 1.0 / max(1.0, np.abs(g).sum())), g @ p
            while True:
                after = theta - step * p
                f2, g2 = self._loss(after, x, hot, w)
                if f2 <= f - 1e-4 * step * slope or step < 1e-12:
                    break
                step /= 2
            s, t = after - theta, g2 - g
            if s @ t > 1e-12:
                old = [*old[-9:], (s, t)]
            done = abs(f - f2) <= 1e-13 * max(1.0, abs(f))
            theta, f, g = after, f2, g2
            if done:
                break
        d = x.shape[1]
        self.weights, self.bias = theta[: k * d].reshape(k, d), theta[k * d :]
        self.gradient = float(np.abs(g).max())
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.asarray(x, np.float64) @ self.weights.T + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self.probabilities(x).argmax(axis=1)]


def macro_f1(y: np.ndarray, p: np.ndarray) -> float:
    """Over the classes of either side, as a fold is scored."""
    out = [2 * ((y == c) & (p == c)).sum() / ((y == c).sum() + (p == c).sum()) for c in np.union1d(y, p)]
    return float(np.mean(out)) if out else float("nan")


def inner_cv(x: np.ndarray, y: np.ndarray, fold: np.ndarray, grid: list[float]) -> tuple[float, float, int]:
    """(C, best mean macro F1, folds used); the first C wins ties. C 1, -inf and 0 if no fold can be made."""
    k = int(fold.max()) + 1 if len(fold) else 0
    if k < 2 or len(np.unique(y)) < 2:
        return 1.0, -np.inf, 0
    score = [float(np.mean([macro_f1(y[fold == f], Multinomial(c).fit(x[fold != f], y[fold != f]).predict(x[fold == f])) for f in range(k)])) for c in grid]
    best = int(np.argmax(score))
    return grid[best], score[best], k


def stratified(y: np.ndarray, most: int) -> np.ndarray:
    """Fold numbers in row order per class, as many folds as the rarest class has rows; all 0 if under two."""
    classes, n = np.unique(y, return_counts=True)
    k = int(min(most, n.min())) if len(n) else 0
    fold = np.zeros(len(y), np.int64)
    if k >= 2:
        for c in classes:
            at = np.flatnonzero(y == c)
            fold[at] = np.arange(len(at)) % k
    return fold


def choose_dims(x: np.ndarray, y: np.ndarray, fold: np.ndarray, dims: list[int], grid: list[float]) -> tuple[int, float, float, int]:
    """(dims, C, score, folds): the prefix of the features with the best inner score; the smallest wins ties."""
    best = None
    for d in sorted({d for d in dims if 0 < d <= x.shape[1]}) or [x.shape[1]]:
        c, score, k = inner_cv(x[:, :d], y, fold, grid)
        if best is None or score > best[2]:
            best = (d, c, score, k)
    return best


def sweep(train: DataFrame, test: DataFrame, run: list[str], grid: list[float], n_folds: int = 5, dims: list[int] | None = None, most_train: int = 200_000) -> DataFrame:
    """Predictions (run, cell_id, dataset, y_true, y_pred, C_selected, n_dims_selected, inner_cv_folds_used).

    train and test have the run's keys, cell_id, label, emb, and test also dataset. Runs are
    text. Every run is scaled by its own training rows, tuned on them by inner folds and
    refitted on all of them. A run with more than most_train rows raises, since one task
    holds it: use fit_distributed(). Runs without training rows give no prediction.
    """
    a = train.select(*run, "cell_id", F.lit("").alias("dataset"), "label", "emb", F.lit(True).alias("fit"))
    b = test.select(*run, "cell_id", "dataset", "label", "emb", F.lit(False).alias("fit"))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell_id", kind="stable")
        fit, rest = rows[rows["fit"]], rows[~rows["fit"]]
        if len(fit) > most_train:
            raise ValueError(f"run {key} has {len(fit)} training rows; one task takes {most_train}")
        if not len(fit) or not len(rest):
            return pd.DataFrame(columns=[*run, "cell_id", "dataset", "y_true", "y_pred", "C_selected", "n_dims_selected", "inner_cv_folds_used"])
        x = np.array(fit["emb"].tolist(), np.float64)
        mean, sd = x.mean(axis=0), x.std(axis=0)
        sd[sd < 1e-8] = 1.0
        x, z = (x - mean) / sd, (np.array(rest["emb"].tolist(), np.float64) - mean) / sd
        y = fit["label"].to_numpy().astype(str)
        d, c, _, k = choose_dims(x, y, stratified(y, n_folds), dims or [x.shape[1]], grid)
        model = Multinomial(c).fit(x[:, :d], y)
        if not np.allclose(model.probabilities(z[:64, :d]).sum(axis=1), 1.0, atol=1e-6):
            raise RuntimeError("class probabilities do not add up to 1")
        out = pd.DataFrame({"cell_id": rest["cell_id"], "dataset": rest["dataset"], "y_true": rest["label"], "y_pred": model.predict(z[:, :d])})
        for name, value in zip(run, key, strict=True):
            out[name] = value
        return out.assign(C_selected=c, n_dims_selected=d, inner_cv_folds_used=k)[
            [*run, "cell_id", "dataset", "y_true", "y_pred", "C_selected", "n_dims_selected", "inner_cv_folds_used"]
        ]

    keys = ", ".join(f"`{r}` string" for r in run)
    schema = f"{keys}, cell_id string, dataset string, y_true string, y_pred string, C_selected double, n_dims_selected int, inner_cv_folds_used int"
    return a.unionByName(b).groupBy(*run).applyInPandas(one, schema)


def fit_distributed(train: DataFrame, c: float, label: str = "label", emb: str = "emb"):
    """The same objective by MLlib, for training sets beyond one task. Returns (indexer, model)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    from gridloom.operators.scoring import class_weights

    rows = train.select(label, array_to_vector(F.col(emb).cast("array<double>")).alias("features"))
    weighted = rows.join(class_weights(train, label).select(label, "weight"), label)
    n = weighted.count()
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(weighted)
    head = LogisticRegression(
        family="multinomial", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, labelCol="_y", weightCol="weight", maxIter=500, tol=1e-9
    )
    return indexer, head.fit(indexer.transform(weighted))


def fit_pca(train: DataFrame, emb: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components) of the training vectors, from one pass of sums and of the cross products.

    The covariance is width squared, whatever the number of rows. A component's largest
    entry is positive.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    rows = train.select(array_to_vector(F.col(emb).cast("array<double>")).alias("v"))
    matrix = RowMatrix(rows.rdd.map(lambda r: Vectors.dense(r[0].toArray())))
    mean = np.array(matrix.computeColumnSummaryStatistics().mean())
    values, vectors = np.linalg.eigh(matrix.computeCovariance().toArray())
    parts = vectors[:, np.argsort(-values)[:k]].T
    sign = np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])
    return mean, parts * sign[:, None]


def apply_pca(df: DataFrame, emb: str, out: str, mean: np.ndarray, parts: np.ndarray) -> DataFrame:
    """df with the centred vector's components as `out`, by built-in expressions."""
    centred = F.zip_with(F.col(emb), F.array(*map(F.lit, map(float, mean))), lambda x, m: x.cast("double") - m)
    dot = lambda p: F.aggregate(F.zip_with("_c", F.array(*map(F.lit, map(float, p))), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("_c", centred).withColumn(out, F.array(*[dot(p) for p in parts])).drop("_c")


def harmonised_batches(z: np.ndarray, batch: np.ndarray, clusters: int = 20, rounds: int = 10, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, seed: int = 0) -> np.ndarray:
    """Vectors with batch effects taken out: soft clusters that mix batches, then a ridge fit per cluster.

    The published alternation of diverse clustering and mixture correction. With fewer than
    two batches the vectors come back as they are.
    """
    names, at = np.unique(batch, return_inverse=True)
    if len(names) < 2:
        return z
    rng = np.random.default_rng(seed)
    hot = np.eye(len(names))[at]
    share = hot.mean(axis=0)
    k = int(min(clusters, max(2, len(z) // 30)))
    now = z.copy()
    centre = now[rng.choice(len(z), k, replace=False)]
    for _ in range(rounds):
        cos = now / np.maximum(np.linalg.norm(now, axis=1, keepdims=True), 1e-12)
        r = np.full((len(z), k), 1.0 / k)
        for _ in range(5):
            mid = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
            raw = np.exp(-2 * (1 - cos @ mid.T) / sigma)
            seen, due = r.T @ hot + 1, np.outer(r.sum(axis=0), share) + 1
            r = raw * (hot @ ((due / seen) ** theta).T)
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            centre = r.T @ cos
        design = np.hstack([np.ones((len(z), 1)), hot])
        penalty = np.diag([0.0] + [ridge] * len(names))
        fixed = z.copy()
        for j in range(k):
            w = design * r[:, j : j + 1]
            beta = np.linalg.solve(w.T @ design + penalty + 1e-9 * np.eye(len(penalty)), w.T @ z)
            beta[0] = 0
            fixed -= w @ beta
        now = fixed
    return now


def encode(df: DataFrame, encoder: Callable[[list], np.ndarray], sequence: str, key: str = "cell_id", tokens: int = 8192) -> DataFrame:
    """(key, emb) by a pluggable sequence encoder, called per Arrow batch on sequences of similar length.

    Within a batch, sequences are sorted by length and cut so that longest times number stays
    within `tokens`, which keeps padding low. The weights are the caller's.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            n = f[sequence].map(len)
            order, at = n.sort_values(kind="stable").index, 0
            while at < len(order):
                to = at + 1
                while to < len(order) and (to - at + 1) * n[order[to]] <= tokens:
                    to += 1
                part = f.loc[order[at:to]]
                yield pd.DataFrame({key: part[key], "emb": list(np.asarray(encoder(part[sequence].tolist()), np.float32))})
                at = to

    return df.select(key, sequence).mapInPandas(run, f"`{key}` {kind}, emb array<float>")
