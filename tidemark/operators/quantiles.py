"""Exact quantiles of few large groups, or of a whole table, without holding a group in one task.

Equal values of a group are counted together first. These counts are range-partitioned by group and value, so
that a group lies in consecutive partitions; each partition's share of a group is summed, and a row's ranks are
those before its partition plus those before it within. What comes to one task is a row for each partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import saved


def ranked_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``*by, value, n, first, total``: each distinct value of a group, how often it stands there, its first place
    (from 0, ascending) and the group's size. Null values are left out, null groups are groups; NaN is the
    largest value. The columns of ``by`` must not be named n, first, total, part, held or before."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    placed = saved(counts.repartitionByRange(parts, *by, "value").withColumn("part", F.spark_partition_id()))
    held = placed.groupBy(*by, "part").agg(F.sum("n").alias("held"))
    over = Window.partitionBy(*by)  # as many rows a group as partitions
    before = F.coalesce(F.sum("held").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("part").alias("__part"), before.alias("before"), F.sum("held").over(over).alias("total"))
    same = F.col("part") == F.col("__part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    within = Window.partitionBy(*by, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("through", F.sum("n").over(within)).join(starts, same)
    return summed.select(*by, "value", "n", (F.col("before") + F.col("through") - F.col("n")).alias("first"), "total")


def quantile_of(p: float) -> Column:
    """The interpolated ``p`` quantile of the rows of ranked_values(), as an aggregate."""
    place = F.lit(p) * (F.col("total") - 1)
    at = lambda k: F.max(F.when((F.col("first") <= k) & (k < F.col("first") + F.col("n")), F.col("value")))
    low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
    return low + (high - low) * part


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``*by`` and a column for each name of ``probs``: the exact interpolated quantiles of each group. Groups
    without a value have no row (without ``by``: a row of nulls)."""
    return ranked_values(df, by, value).groupBy(*by).agg(*[quantile_of(p).alias(n) for n, p in probs.items()])


def with_quantiles(table: DataFrame, df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``table``, which has a row for each group, with the quantiles of ``df``'s groups added (null without any)."""
    made = quantiles(df, by, value, probs).withColumnsRenamed({c: f"__{c}" for c in by})
    if not by:
        return table.crossJoin(F.broadcast(made))  # a row
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return table.join(made, same, "left").drop(*[f"__{c}" for c in by])


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with its rows' place (from 0) in the order of a column of distinct values, found as above."""
    ranks = ranked_values(df, [], order).select(F.col("value").alias("__value"), F.col("first").alias(name))
    return df.join(ranks, F.col(order) == F.col("__value")).drop("__value")
