"""Point forecasts: naive rules, trailing profiles, and Spark ML models."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import local_date, local_time
from tidemark.sources.tables import saved


def weekday_naive(df: DataFrame, lag_24: str, lag_168: str, name: str = "weekday_pred") -> DataFrame:
    """Tuesday to Friday the day before, else the week before."""
    dow = F.weekday(local_time(F.col("timestamp_utc")))
    return df.withColumn(name, F.when(dow.between(1, 4), F.col(lag_24)).otherwise(F.col(lag_168)))


def trailing_profile(df: DataFrame, value: str, window: int) -> DataFrame:
    """Mean by local hour over the last ``window`` days that have values, before each day."""
    local = local_time(F.col("timestamp_utc"))
    rows = df.where(F.col(value).isNotNull()).select("series_id", F.to_date(local).alias("day"), F.hour(local).alias("hour_local"), F.col(value).alias("v"))
    index = rows.select("series_id", "day").distinct().withColumn("k", F.row_number().over(Window.partitionBy("series_id").orderBy("day")))
    sent = rows.join(index, ["series_id", "day"]).select("series_id", "hour_local", "v", F.explode(F.sequence(F.col("k") + 1, F.col("k") + window)).alias("k"))
    made = sent.groupBy("series_id", "k", "hour_local").agg(F.avg("v").alias("profile_pred"))
    return made.join(index, ["series_id", "k"]).select("series_id", F.col("day").alias("delivery_date"), "hour_local", "profile_pred")


def trailing_profiles(df: DataFrame, value: str, windows: list[int]) -> DataFrame:
    """``series_id, delivery_date, hour_local, window_days, profile_pred``: trailing_profile() for all of ``windows`` in one pass.
    Sums and counts of each hour run along the series' days that have values, and a window is the difference of two
    running values; no value is copied to the days that use it. Hours without values in a window have no row."""
    local = local_time(F.col("timestamp_utc"))
    rows = df.where(F.col(value).isNotNull()).select("series_id", F.to_date(local).alias("day"), F.hour(local).alias("hour_local"), F.col(value).cast("double").alias("v"))
    # a row a day with all its hours
    sums = rows.groupBy("series_id", "day", "hour_local").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    days = sums.groupBy("series_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("hour_local", F.struct("s", "n")))).alias("hours"))  # 24 at most
    along = Window.partitionBy("series_id").orderBy("day")
    indexed = days.withColumn("k", F.row_number().over(along))
    grid = indexed.select("series_id", "day", "k", "hours", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour_local"))
    each = Window.partitionBy("series_id", "hour_local").orderBy("k")
    cell = F.col("hours")[F.col("hour_local")]
    run = each.rowsBetween(Window.unboundedPreceding, -1)
    through = grid.withColumns({"cs": F.coalesce(F.sum(cell["s"]).over(run), F.lit(0.0)), "cn": F.coalesce(F.sum(cell["n"]).over(run), F.lit(0))})
    back = lambda c, w, none: F.coalesce(F.lag(c, w).over(each), none)
    cells_ = [F.struct(F.lit(w).alias("window_days"), (F.col("cs") - back("cs", w, F.lit(0.0))).alias("s"), (F.col("cn") - back("cn", w, F.lit(0))).alias("n")) for w in windows]
    made = through.select("series_id", F.col("day").alias("delivery_date"), "hour_local", F.array(*cells_).alias("cells"))
    out = made.select("series_id", "delivery_date", "hour_local", F.explode("cells").alias("c")).where("c.n > 0")
    return out.select("series_id", "delivery_date", "hour_local", "c.window_days", (F.col("c.s") / F.col("c.n")).alias("profile_pred"))


def _fit(df: DataFrame, features: list[str], estimator) -> object:
    stages = [VectorAssembler(inputCols=features, outputCol="x_raw", handleInvalid="skip"), StandardScaler(inputCol="x_raw", outputCol="x", withMean=True), estimator]
    return Pipeline(stages=stages).fit(df)


def elastic_net(df: DataFrame, features: list[str], label: str, alpha: float, l1_ratio: float):
    """A scaled linear model; ``alpha`` and ``l1_ratio`` as in coordinate-descent libraries that penalize
    the unscaled label, converted to Spark's parameters by the label's deviation over the fitted rows. The
    scaler is fitted with the model, so that a fold's scale knows nothing of later rows."""
    rows = df.dropna(subset=features + [label])
    sd = rows.agg(F.stddev_pop(label)).first()[0] or 1.0
    a = alpha * l1_ratio + alpha * (1 - l1_ratio) * sd
    return _fit(rows, features, LinearRegression(featuresCol="x", labelCol=label, regParam=a, elasticNetParam=alpha * l1_ratio / a if a else 0.0))


def boosted_trees(df: DataFrame, features: list[str], label: str, **grid):
    """Boosted trees on absolute errors; ``grid``: parameters of Spark's GBTRegressor."""
    return _fit(df.dropna(subset=features + [label]), features, GBTRegressor(featuresCol="x", labelCol=label, lossType="absolute", seed=7, **grid))


class Naive:
    """A column as a model's prediction, so that naive rules are evaluated beside fitted models."""

    def __init__(self, column: str):
        self.column = column

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.col(self.column))


def cells(**values) -> list[dict]:
    """All combinations of the values of each parameter, the last one varying fastest."""
    return [dict(zip(values, c)) for c in product(*values.values())]


#: The two search profiles of the linear model (15 alphas from 0.001 to 100 by equal ratios, the
#: second with four smaller ones) and the parameters of the trees' search (36 cells).
_ALPHAS = [10 ** (-3 + 5 * i / 14) for i in range(15)]
LINEAR_PROFILES = {
    "v1": {"alpha": _ALPHAS, "l1_ratio": [0.1, 0.5, 0.9, 1.0]},
    "v2": {"alpha": [1e-5, 3e-5, 1e-4, 3e-4, *_ALPHAS], "l1_ratio": [0.01, 0.1, 0.5, 0.9, 1.0]},
}
LEAST_ROWS = 100


def with_parts(df: DataFrame, k: int, unit: str = "rows") -> DataFrame:
    """``df`` with ``part``: the test part (0 to k - 1) of an expanding cross-validation that a row falls in, -1
    before the first. Each series' rows in time order, or its distinct local days (``unit`` "days"), are cut as
    splits.row_cv() and splits.day_aligned_cv() cut them; fold i trains on parts below i."""
    if unit not in ("rows", "days"):
        raise ValueError("unit is rows or days")
    w = Window.partitionBy("series_id")
    if unit == "rows":
        ranked = df.withColumns({"__r": F.row_number().over(w.orderBy("timestamp_utc")) - 1, "__n": F.count("*").over(w)})
    else:
        ranked = df.withColumn("__day", local_date(F.col("timestamp_utc"))).withColumn("__r", F.dense_rank().over(w.orderBy("__day")) - 1).withColumn("__n", F.max("__r").over(w) + 1).drop("__day")
    test = F.floor(F.col("__n") / (k + 1))
    start = F.col("__n") - k * test
    return ranked.withColumn("part", F.when((F.col("__r") < start) | (test == 0), -1).otherwise(F.floor((F.col("__r") - start) / test)).cast("int")).drop("__r", "__n")


def complete_parts(df: DataFrame, features: list[str], label: str, k: int, unit: str) -> DataFrame:
    """The rows of ``df`` that have all features and the label, written once with their ``part`` of with_parts(). A time
    that a series has twice, fewer than 100 rows, or a fold without rows to train on or to test is a ValueError."""
    rows = saved(with_parts(df.dropna(subset=[*features, label]).select("series_id", "timestamp_utc", *features, label), k, unit))
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    if sum(sizes.values()) < LEAST_ROWS:
        raise ValueError(f"fewer than {LEAST_ROWS} complete rows")
    if rows.groupBy("series_id", "timestamp_utc").count().where("count > 1").take(1):
        raise ValueError("a series has a time twice: folds in row order need one row a time")
    if any(not sizes.get(i) for i in range(-1, k)):
        raise ValueError(f"fewer rows than {k} folds need")
    return rows


def search(df: DataFrame, features: list[str], label: str, fit: Callable, grid: list[dict], k: int = 4, unit: str = "rows", at_once: int = 4) -> tuple[object, dict, DataFrame]:
    """The grid's cell with the lowest mean over folds of the mean absolute error, refitted on all rows: the model,
    the cell, and a table ``cell, fold, mae, parameters``. Rows that lack a feature or the label are left out;
    a time that a series has twice, or fewer than 100 rows, is a ValueError. Of equal cells the first wins. Fits
    are Spark jobs, ``at_once`` of them at a time; what comes to the driver is a number for each."""
    rows = complete_parts(df, features, label, k, unit)
    judge = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="mae")

    def score(task: tuple[int, int]) -> float:
        cell, fold = task
        return judge.evaluate(fit(rows.where(F.col("part") < fold), features, label, **grid[cell]).transform(rows.where(F.col("part") == fold)))

    tasks = [(c, i) for c in range(len(grid)) for i in range(k)]
    with ThreadPoolExecutor(at_once) as pool:
        scores = list(pool.map(inheritable_thread_target(df.sparkSession)(score), tasks))
    means = [sum(scores[c * k : c * k + k]) / k for c in range(len(grid))]
    best = min(range(len(grid)), key=lambda c: (means[c], c))
    table = df.sparkSession.createDataFrame([(c, i, s, str(grid[c])) for (c, i), s in zip(tasks, scores)], "cell int, fold int, mae double, parameters string")
    return fit(rows, features, label, **grid[best]), grid[best], table


def evaluate_folds(df: DataFrame, features: list[str], label: str, fits: dict[str, Callable[[DataFrame], object]], folds: list[int], keep: list[str]) -> DataFrame:
    """Long predictions ``*keep, label, fold, model, prediction``: for each of ``folds`` every model of ``fits`` is
    fitted on the rows of earlier folds (null: before all) and predicts the fold's, on rows that have all features
    and the label, so that all models are scored on the same rows. Score with metrics.point_metrics()."""
    rows, out = saved(df.dropna(subset=[*features, label])), None
    for fold in folds:
        train, test = rows.where(F.col("fold").isNull() | (F.col("fold") < fold)), rows.where(F.col("fold") == fold)
        for name, fit in fits.items():
            made = fit(train).transform(test).select(*keep, label, "fold", F.lit(name).alias("model"), "prediction")
            out = made if out is None else out.unionByName(made)
    return out


def predict_complete(model, df: DataFrame, features: list[str], keys: list[str], name: str) -> DataFrame:
    """Predictions on rows with all features, null elsewhere."""
    made = model.transform(df.dropna(subset=features)).select(*keys, F.col("prediction").alias(name))
    return df.join(made, keys, "left")


def coefficients(model, features: list[str]) -> DataFrame:
    """``rank, feature, weight`` of a fitted model, largest magnitude first (ties by name): coefficients of
    the standardized features, or importances of trees; of Spark's models, linear.LinearModel or boosting.TreesModel.
    As many rows as features."""
    if hasattr(model, "importances"):
        pairs = model.importances()
    elif hasattr(model, "weights"):
        pairs = zip(features, model.weights.tolist())
    else:
        last = model.stages[-1]
        pairs = zip(features, (last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray().tolist())
    rows = sorted(pairs, key=lambda x: (-abs(x[1]), x[0]))
    return SparkSession.active().createDataFrame([(n + 1, *r) for n, r in enumerate(rows)], "rank int, feature string, weight double")


def promotion(metrics: DataFrame, base: str, challenger: str, threshold: float = 0.01) -> DataFrame:
    """Row-weighted mean absolute errors over folds, and whether the challenger's is lower by enough."""
    w = lambda m: F.sum(F.when(F.col("model") == m, F.col("mae") * F.col("n"))) / F.sum(F.when(F.col("model") == m, F.col("n")))
    t = metrics.agg(w(base).alias("base_mae"), w(challenger).alias("challenger_mae"))
    gain = 1 - F.col("challenger_mae") / F.col("base_mae")
    return t.withColumns({"improvement": gain, "promoted": gain >= threshold})


def day_of(df: DataFrame) -> DataFrame:
    return df.withColumn("delivery_date", local_date(F.col("timestamp_utc")))
