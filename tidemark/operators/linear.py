"""Elastic nets from sums of products: a whole search over cells and folds in two passes over the rows.

One pass sums, for each part of an expanding cross-validation, the products of all columns. The sums of a fold's training
rows are those of the parts before it, so that every cell of every fold is solved from tables whose size is the number of
columns squared, by coordinate descent on the driver. A second pass scores all of them at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import extreme_flags, point_metrics
from tidemark.sources.tables import saved

from .forecast import cells, coefficients, complete_parts

#: Columns that a search takes at most: the sums have as many entries as pairs of them.
MOST_FEATURES = 100
#: Sweeps over all weights at most, and the largest change of a weight, as a share of the label's deviation, at which they end.
SWEEPS, TOLERANCE = 5000, 1e-8


@dataclass
class Moments:
    """Rows, means, and sums of products of deviations from the means, of the features and the label (last)."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        step = other.mean - self.mean
        return Moments(n, self.mean + step * other.n / n, self.products + other.products + np.outer(step, step) * self.n * other.n / n)


def sums(df: DataFrame, columns: list[str], shift: list[float], by: str) -> DataFrame:
    """``by, n, first, second``: of the columns less ``shift``, sums and the sums of all products (of pairs i <= j), in
    one pass with partial sums. A shift of about the columns' size keeps what large offsets would cancel."""
    if len(columns) > MOST_FEATURES + 1:
        raise ValueError(f"more than {MOST_FEATURES} features")
    x = [F.col(c) - F.lit(s) for c, s in zip(columns, shift)]
    pairs = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    return df.groupBy(by).agg(F.count("*").alias("n"), F.array(*map(F.sum, x)).alias("first"), F.array(*pairs).alias("second"))


def moments(df: DataFrame, columns: list[str], by: str) -> dict[object, Moments]:
    """The moments of each value of ``by``, of which there must be few."""
    one = df.select(*columns).first()
    shift = [float(v) for v in one] if one else [0.0] * len(columns)
    out, p = {}, len(columns)
    for r in sums(df, columns, shift, by).collect():
        first, second = np.array(r["first"]), np.zeros((p, p))
        second[np.triu_indices(p)] = r["second"]
        second = second + np.triu(second, 1).T
        out[r[by]] = Moments(r["n"], first / r["n"] + shift, second - np.outer(first, first) / r["n"])
    return out


def covariances(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """``by, a, b, n, mean_a, mean_b, covariance`` of all pairs of columns, from the same sums."""
    found = moments(df, columns, by)
    rows = [
        (None if k is None else str(k), columns[i], columns[j], m.n, *map(float, (m.mean[i], m.mean[j], m.products[i, j] / m.n)))
        for k, m in found.items() for i in range(len(columns)) for j in range(i, len(columns))
    ]
    return df.sparkSession.createDataFrame(rows, f"`{by}` string, a string, b string, n long, mean_a double, mean_b double, covariance double")


def _on_support(gram: np.ndarray, target: np.ndarray, l1: float, l2: float, w: np.ndarray) -> np.ndarray | None:
    """The minimum of one net, if it has the signs of ``w``: those weights solve a linear system."""
    on = np.flatnonzero(w)
    out = np.zeros_like(w)
    if len(on):
        try:
            out[on] = np.linalg.solve(gram[np.ix_(on, on)] + l2 * np.eye(len(on)), target[on] - l1 * np.sign(w[on]))
        except np.linalg.LinAlgError:
            return None
    slope = target - gram @ out - l2 * out
    slope[on] -= l1 * np.sign(w[on])
    eps = 1e-9 * max(1.0, float(np.abs(target).max()))
    off = w == 0
    right = (np.sign(out) == np.sign(w)).all() and (np.abs(slope[on]) <= eps).all() and (np.abs(slope[off]) <= l1 + eps).all()
    return out if right else None


def descend(gram: np.ndarray, target: np.ndarray, l1: np.ndarray, l2: np.ndarray, start: np.ndarray, tolerance: float) -> np.ndarray:
    """Weights of several nets by cyclic coordinate descent: net k lowers ``w G[k] w / 2 - t[k] w + l1[k] |w| + l2[k] w w / 2``.
    Now and then the weights' signs are tried as those of the minimum. A feature without deviation keeps weight 0."""
    out, todo = start.copy(), np.arange(len(start))
    dead = np.einsum("kjj->kj", gram) <= 1e-12
    out[dead] = 0.0
    for sweep in range(SWEEPS):
        w, g, t, c, d = out[todo], gram[todo], target[todo], l1[todo], l2[todo]
        before = w.copy()
        for j in range(w.shape[1]):
            own = g[:, j, j]
            rest = t[:, j] - (g[:, j] * w).sum(axis=1) + own * w[:, j]
            w[:, j] = np.where(dead[todo, j], 0.0, np.sign(rest) * np.maximum(np.abs(rest) - c, 0) / np.maximum(own + d, 1e-300))
        still = np.abs(w - before).max(axis=1) > tolerance
        if sweep % 10 == 9:
            for k in np.flatnonzero(still):
                found = _on_support(g[k], t[k], c[k], d[k], w[k])
                if found is not None:
                    w[k], still[k] = found, False
        out[todo] = w
        todo = todo[still]
        if not len(todo):
            break
    return out


@dataclass
class LinearModel:
    """Weights of standardized features. ``transform`` adds ``prediction``: null where a feature is."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        made = F.lit(self.intercept)
        for c, m, s, w in zip(self.features, self.mean, self.scale, self.weights):
            made = made + (F.col(c) - F.lit(float(m))) * F.lit(float(w / s))
        return df.withColumn("prediction", made)

    def raw(self) -> np.ndarray:
        """Weights of the features as they are, the constant last."""
        w = self.weights / self.scale
        return np.append(w, self.intercept - w @ self.mean)


def solve(found: list[Moments], features: list[str], grid: list[dict]) -> list[list[LinearModel]]:
    """A model for each of some moments and each cell ``alpha, l1_ratio``, which penalize mean squared errors of an
    unscaled label as coordinate-descent libraries do. Cells of one l1_ratio start from that of the next larger alpha."""
    p = len(features)
    scale = np.array([np.sqrt(np.diag(m.products)[:p] / m.n) for m in found])
    scale[scale < 1e-12] = 1.0
    gram = np.array([m.products[:p, :p] / m.n / np.outer(s, s) for m, s in zip(found, scale)])
    target = np.array([m.products[:p, p] / m.n / s for m, s in zip(found, scale)])
    spread = max(float(np.sqrt(m.products[p, p] / m.n)) for m in found) or 1.0
    ratios = sorted({c["l1_ratio"] for c in grid})
    solved, last = {}, np.zeros((len(found) * len(ratios), p))
    big = lambda a: np.repeat(a, len(ratios), axis=0)
    gram_all, target_all, mix = big(gram), big(target), np.tile(ratios, len(found))
    for alpha in sorted({c["alpha"] for c in grid}, reverse=True):
        last = descend(gram_all, target_all, alpha * mix, alpha * (1 - mix), last, TOLERANCE * spread)
        for k in range(len(found)):
            for i, r in enumerate(ratios):
                solved[k, alpha, r] = last[k * len(ratios) + i]
    return [
        [LinearModel(features, m.mean[:p], scale[k], solved[k, c["alpha"], c["l1_ratio"]], float(m.mean[p])) for c in grid]
        for k, m in enumerate(found)
    ]


def errors(df: DataFrame, features: list[str], label: str, models: list[list[LinearModel]]) -> DataFrame:
    """``part, cell, total, n``: absolute errors of all cells' models of a part on its rows, in one pass; each task sends
    as many rows as there are models."""
    weights = [np.array([m.raw() for m in part]).T for part in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(w.shape[1]) for w in weights]
        n = [0] * len(weights)
        for b in batches:
            part = b.column(0).to_numpy()
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, b.num_columns - 1)] + [np.ones(b.num_rows)])
            y = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            for k in np.unique(part):
                mine = part == k
                total[k] += np.abs(x[mine] @ weights[k] - y[mine, None]).sum(axis=0)
                n[k] += int(mine.sum())
        rows = [(k, c, float(e), n[k]) for k in range(len(weights)) if n[k] for c, e in enumerate(total[k])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.float64(), pa.int64()))], ["part", "cell", "total", "n"])

    columns = [F.col(c).cast("double").alias(c) for c in (*features, label)]
    made = df.where(F.col("part") >= 0).select("part", *columns).mapInArrow(run, "part int, cell int, total double, n long")
    return made.groupBy("part", "cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def search(df: DataFrame, features: list[str], label: str, grid: list[dict], k: int = 4, unit: str = "rows") -> tuple[LinearModel, dict, DataFrame]:
    """forecast.search() for elastic nets, with the same result: the cell with the lowest mean over folds of the mean
    absolute error, refitted on all rows; the model, the cell, and a table ``cell, fold, mae, alpha, l1_ratio``.

    ``grid``: cells of ``alpha`` and ``l1_ratio``. Rows that lack a feature or the label are left out; the errors of
    forecast.complete_parts() are raised; of equal cells the first wins. Each fold is standardized by its own training
    rows. The rows are read twice, whatever the grid's size."""
    rows = complete_parts(df, features, label, k, unit)
    by = moments(rows, [*features, label], "part")
    before, trains = by[-1], []
    for i in range(k):
        trains.append(before)
        before = before + by[i]
    solved = solve([*trains, before], features, grid)
    scores = {(r["part"], r["cell"]): r["total"] / r["n"] for r in errors(rows, features, label, solved[:-1]).collect()}
    means = [sum(scores[i, c] for i in range(k)) / k for c in range(len(grid))]
    best = min(range(len(grid)), key=lambda c: (means[c], c))
    table = df.sparkSession.createDataFrame(
        [(c, i, scores[i, c], float(g["alpha"]), float(g["l1_ratio"])) for c, g in enumerate(grid) for i in range(k)], "cell int, fold int, mae double, alpha double, l1_ratio double"
    )
    return solved[-1][best], grid[best], table


def profile_search(df: DataFrame, features: list[str], label: str, profile: dict[str, list[float]], k: int = 4, unit: str = "rows") -> tuple[LinearModel, dict, DataFrame]:
    """search() over all cells of one of forecast.LINEAR_PROFILES."""
    return search(df, features, label, cells(**profile), k, unit)


# --- evaluation of folds

#: Buckets of the target by fixed bounds.
BUCKETS = {"negative": "{0} < 0", "above_200": "{0} > 200", "above_500": "{0} > 500"}


def predict_folds(
    df: DataFrame, label: str, variants: dict[str, tuple[Callable, list[str]]], naive: dict[str, str], folds: list[int], keep: list[str]
) -> tuple[DataFrame, DataFrame]:
    """The validation rows of each fold with a column for each model, and the chosen cells ``fold, model, parameters,
    coefficients`` (an array of ``feature, weight`` as forecast.coefficients() ranks them).

    For each of ``folds`` (a few) every variant is searched on the rows of earlier folds (null: before all) and predicts
    the fold's rows, null where a feature is. A variant's name stands for its search, called with rows, features and label
    (as search() or boosting.search() with their other arguments fixed), and its features. ``naive``: names and the columns that are their
    predictions. ``is_extreme``: further from the training rows' median than their 0.95 quantile of that distance."""
    rows, out, chosen = saved(df), None, []
    for fold in folds:
        train, test = rows.where(F.col("fold").isNull() | (F.col("fold") < fold)), rows.where(F.col("fold") == fold)
        made = extreme_flags(train.where(F.col(label).isNotNull()), test, label).withColumns({n: F.col(c) for n, c in naive.items()})
        for name, (searched, features) in variants.items():
            model, cell, _ = searched(train, features, label)
            made = model.transform(made).withColumnRenamed("prediction", name)
            told = [(r["feature"], r["weight"]) for r in coefficients(model, features).collect()]
            chosen.append((fold, name, ", ".join(f"{n} {v:.6g}" for n, v in sorted(cell.items())), told))
        made = made.select(*keep, label, "fold", "is_extreme", *naive, *variants)
        out = made if out is None else out.unionByName(made)
    return out, df.sparkSession.createDataFrame(chosen, "fold int, model string, parameters string, coefficients array<struct<feature: string, weight: double>>")


def fold_coverage(predictions: DataFrame, label: str, models: list[str]) -> DataFrame:
    """``fold, n_rows``, the rows on which each model can be scored (``n_<model>``), and all of them (``n_common``)."""
    there = F.col(label).isNotNull()
    every = there
    for m in models:
        every = every & F.col(m).isNotNull()
    return predictions.groupBy("fold").agg(
        F.count("*").alias("n_rows"), *[F.count(F.when(there & F.col(m).isNotNull(), True)).alias(f"n_{m}") for m in models], F.count(F.when(every, True)).alias("n_common")
    )


def fold_scores(predictions: DataFrame, label: str, models: list[str], hour: str = "hour_local") -> DataFrame:
    """``fold, model, grouping_key, level`` with the columns of metrics.point_metrics(), on the rows that all models
    predict: overall (level null), by local hour, by the training rows' extremes, and in the buckets of fixed bounds
    that have rows."""
    rows = predictions.dropna(subset=[label, *models])
    level = lambda key, value: F.struct(F.lit(key).alias("grouping_key"), value.cast("string").alias("level"))
    buckets = [F.when(F.expr(rule.format(f"`{label}`")), level("bucket", F.lit(name))) for name, rule in BUCKETS.items()]
    levels = F.array_compact(F.array(level("overall", F.lit(None)), level("hour", F.col(hour)), level("extreme", F.col("is_extreme")), *buckets))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in models])).alias("m")
    long = rows.select("fold", label, each, levels.alias("levels")).select("fold", label, "m.*", F.explode("levels").alias("l")).select("fold", label, "model", "prediction", "l.*")
    return point_metrics(long, ["fold", "model", "grouping_key", "level"], label)
