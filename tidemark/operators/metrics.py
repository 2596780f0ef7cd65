"""Scores and descriptive aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import local_date
from tidemark.sources.tables import saved

from . import scan
from .quantiles import quantile_of, quantiles, ranked_values, with_quantiles


def common_mask(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows on which every column is present: all models are scored on the same rows."""
    return df.dropna(subset=columns)


def long_predictions(df: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    return df.unpivot(keep, models, "model", "prediction")


def point_metrics(df: DataFrame, by: list[str], actual: str = "price", prediction: str = "prediction") -> DataFrame:
    """Count, mean absolute error, root mean square error and median absolute error of each group. The median is
    that of few large groups: see quantiles. What the rows are made of is computed once."""
    e = F.col(actual) - F.col(prediction)
    rows = saved(df.select(*by, e.alias("__e"), F.abs(e).alias("__size")))
    table = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__size").alias("mae"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"))
    return with_quantiles(table, rows, by, "__size", {"median_ae": 0.5})


def weighted_mae(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute errors of point_metrics(), weighted by rows."""
    return scores.groupBy(*by).agg((F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("mae"))


def coverage_counts(df: DataFrame, models: list[str]) -> DataFrame:
    usable = [F.sum(F.col(m).isNotNull().cast("long")).alias(f"n_{m}") for m in models]
    every = F.sum(F.expr(" and ".join(f"{m} is not null" for m in models)).cast("long")).alias("n_common")
    return df.agg(F.count("*").alias("n_rows"), *usable, every)


PERCENTILES = (1, 5, 25, 50, 75, 95, 99)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n, mean, std, lo, p1, p5, p25, p50, p75, p95, p99, hi`` of each column, null values left out."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "v")
    table = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    names = {f"p{q}": q / 100 for q in PERCENTILES}
    return with_quantiles(table, long, ["column"], "v", names).select("column", "n", "mean", "std", "lo", *names, "hi")


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    long = df.select(*[F.col(c).isNull().cast("long").alias(c) for c in columns]).unpivot([], columns, "column", "missing")
    return long.groupBy("column").agg(F.sum("missing").alias("n_missing"), (F.avg("missing") * 100).alias("pct_missing"))


def count_share(df: DataFrame, by: list[str], value: str = "price", above: tuple[int, ...] = (200, 500)) -> DataFrame:
    """``n_negative, n_zero, n_above_...`` and their shares of the values that are not null."""
    v, n = F.col(value), F.count(value)
    tests = {"negative": v < 0, "zero": v == 0} | {f"above_{a}": v > a for a in above}
    hits = {k: F.sum(F.coalesce(t, F.lit(False)).cast("long")) for k, t in tests.items()}
    return df.groupBy(*by).agg(*[h.alias(f"n_{k}") for k, h in hits.items()], *[(h / F.nullif(n, F.lit(0))).alias(f"share_{k}") for k, h in hits.items()])


def seasonality(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, deviation and count by each key, in one scan."""
    long = df.select(value, F.explode(F.array(*[F.struct(F.lit(k).alias("grouping_key"), F.col(k).cast("long").alias("level")) for k in keys])).alias("k"))
    return long.groupBy("k.grouping_key", "k.level").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def profile(df: DataFrame, by: list[str], value: str = "price") -> DataFrame:
    """Mean, median, deviation, extremes and count of few large groups: by year, by regime."""
    table = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    return with_quantiles(table, df, by, value, {"median": 0.5})


def hour_profile(df: DataFrame, value: str = "price") -> DataFrame:
    """Mean by weekend and local hour."""
    return df.groupBy("weekend", "hour_local").agg(F.avg(value).alias("mean"))


def day_flags(df: DataFrame, value: str = "price", above: tuple[int, ...] = (200, 500)) -> DataFrame:
    """``any_negative, any_above_...`` for each series and local day; null values are none of these."""
    tests = {"negative": F.col(value) < 0} | {f"above_{a}": F.col(value) > a for a in above}
    day = local_date(F.col("timestamp_utc")).alias("delivery_date")
    return df.groupBy("series_id", day).agg(*[F.bool_or(F.coalesce(t, F.lit(False))).alias(f"any_{k}") for k, t in tests.items()])


def extremes(df: DataFrame, value: str, k: int = 10) -> DataFrame:
    """The ``k`` highest and the ``k`` lowest rows, ``side`` telling which; ties go to the earlier time."""
    rows = df.where(F.col(value).isNotNull())
    pick = lambda side, order: rows.orderBy(order, "timestamp_utc", "series_id").limit(k).withColumn("side", F.lit(side))
    return pick("highest", F.desc(value)).unionByName(pick("lowest", F.asc(value)))


def correlations(df: DataFrame, by: list[str], x: str, y: str, overall: bool = False) -> DataFrame:
    """Pearson and Spearman (average ranks) by group, or overall without ``by``, over rows that have both; with ``overall`` the
    groups and, their columns null, all rows. The input is read once, and ranks stay with their rows."""
    there = df.dropna(subset=[x, y]).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    keys = [f"__k{i}" for i in range(len(by))]
    level = lambda whole: F.struct(F.lit(whole).alias("__all"), *[(F.when(~F.lit(whole), F.col(c))).alias(k) for c, k in zip(by, keys)])
    rows = there.select(F.explode(F.array(*[level(w) for w in ([False, True] if overall else [False])])).alias("__g"), "__x", "__y").select("__g.*", "__x", "__y")
    first = scan.with_average_rank(saved(rows), ["__all", *keys], "__x", "__rx")
    ranked = scan.with_average_rank(saved(first), ["__all", *keys], "__y", "__ry")
    made = ranked.groupBy("__all", *keys).agg(F.count("*").alias("n"), F.corr("__x", "__y").alias("pearson"), F.corr("__rx", "__ry").alias("spearman"))
    return made.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n", "pearson", "spearman")


def quantile_bins(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Rows binned by quantiles of x (right-closed, repeated edges dropped): medians, mean and n."""
    rows = df.dropna(subset=[x, y]).select(x, y)
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    table = quantiles(rows, [], x, names).select(F.array_distinct(F.array(*names)).alias("edges"))
    placed = rows.crossJoin(F.broadcast(table)).withColumn("bin", F.greatest(F.size(F.filter("edges", lambda e: e < F.col(x))) - 1, F.lit(0))).drop("edges")  # a row
    made = placed.groupBy("bin").agg(F.avg(y).alias("mean_y"), F.count("*").alias("n"))
    return with_quantiles(with_quantiles(made, placed, ["bin"], x, {"median_x": 0.5}), placed, ["bin"], y, {"median_y": 0.5})


def extreme_flags(train: DataFrame, df: DataFrame, value: str, q: float = 0.95) -> DataFrame:
    """Rows whose distance from the training median is above the training quantile of that distance."""
    centre = quantiles(train, [], value, {"centre": 0.5})
    far = train.select(value).crossJoin(F.broadcast(centre)).withColumn("far", F.abs(F.col(value) - F.col("centre")))
    limit = with_quantiles(centre, far, [], "far", {"limit": q})
    return df.crossJoin(F.broadcast(limit)).withColumn("is_extreme", F.abs(F.col(value) - F.col("centre")) > F.col("limit")).drop("centre", "limit")  # a row


RESIDUAL_QUANTILES = (1, 5, 10, 25, 75, 90, 95, 99)


def residual_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, deviation, eight quantiles (q01 to q99), and the mean of the worst (lowest) 10 % and 5 %,
    one row at least."""
    rows = df.dropna(subset=[value]).select(*by, value)
    table = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    ranks = ranked_values(rows, by, value)

    def tail(p: float) -> Column:
        most = F.greatest(F.lit(1), F.floor(F.col("total") * p))
        part = F.greatest(F.lit(0), F.least(F.col("n"), most - F.col("first")))
        return F.sum(part * F.col("value")) / F.max(most)

    made = ranks.groupBy(*by).agg(quantile_of(0.5).alias("median"), *[quantile_of(q / 100).alias(f"q{q:02d}") for q in RESIDUAL_QUANTILES], tail(0.1).alias("worst_10"), tail(0.05).alias("worst_5"))
    return table.join(made, by)
