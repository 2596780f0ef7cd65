"""Joins and groupings by time, day and series that several reports share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import local_date

from .decisions import cells_of


def lag_join(df: DataFrame, value: str, hours: int, name: str) -> DataFrame:
    """``df`` with ``value`` as of ``hours`` before, by an equi-join on the shifted time: for tables that are
    bucketed by series and time. timeseries.safe_lag() gives it by a window, and null where it is not safe."""
    past = df.select("series_id", (F.col("timestamp_utc") + F.expr(f"interval {hours} hours")).alias("timestamp_utc"), F.col(value).alias(name))
    return df.join(past, ["series_id", "timestamp_utc"], "left")


def two_models(a: DataFrame, b: DataFrame, names: tuple[str, str], value: str = "prediction", keys: tuple[str, ...] = ("timestamp_utc",)) -> DataFrame:
    """The keys that both have with each one's ``value`` under its name."""
    left, right = (df.select(*keys, F.col(value).alias(n)) for df, n in zip((a, b), names))
    return left.join(right, list(keys))


def one_sided(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, side``: keys that only the left or only the right table has, each once."""
    both = a.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = both.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l <> r")
    return sides.select(*keys, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose keys ``b`` lacks."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def trailing_days(df: DataFrame, value: str, days: int) -> DataFrame:
    """``series_id, delivery_date, n, total``: rows and sum of the ``days`` local days before each day. Rows are sent
    to the days that may use them: an equi-grouping, not a range join."""
    day = local_date(F.col("timestamp_utc"))
    sent = df.select("series_id", F.col(value).alias("v"), F.explode(F.sequence(F.date_add(day, 1), F.date_add(day, days))).alias("delivery_date"))
    return sent.groupBy("series_id", "delivery_date").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def with_cells(df: DataFrame, cells: DataFrame | list[tuple[float, float]]) -> DataFrame:
    """Each row once for each cell of parameters, with ``eta, c``; a bounded list that becomes part of the
    expression."""
    table = [F.struct(F.lit(float(e)).alias("eta"), F.lit(float(c)).alias("c")) for e, c in cells_of(cells)]
    return df.select("*", F.explode(F.array(*table)).alias("__cell")).select(*df.columns, "__cell.*")


def distinct_days(df: DataFrame) -> DataFrame:
    """``series_id, n``: the number of local days that a series has rows on."""
    return df.select("series_id", local_date(F.col("timestamp_utc")).alias("day")).distinct().groupBy("series_id").agg(F.count("*").alias("n"))


def by_first_appearance(df: DataFrame, by: str = "series_id") -> DataFrame:
    """``by, first_seen, n`` in the order of the groups' first times, not of their names."""
    return df.groupBy(by).agg(F.min("timestamp_utc").alias("first_seen"), F.count("*").alias("n")).orderBy("first_seen", by)


def lowest(df: DataFrame, by: list[str], label: str, score: Column) -> DataFrame:
    """``*by, label, score``: of each group the label of the lowest score, the smaller label on ties."""
    best = F.min(F.struct(score.alias("score"), F.col(label))).alias("m")
    return df.groupBy(*by).agg(best).select(*by, f"m.{label}", "m.score")
