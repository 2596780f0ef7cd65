"""Chronological folds over half-open windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import local_date

FOLD_SCHEMA = "name string, train_start timestamp, train_end timestamp, val_start timestamp, val_end timestamp"


def fold_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "name string, a string, b string, c string, d string").select(
        "name", *[F.to_timestamp(x).alias(y) for x, y in zip("abcd", ("train_start", "train_end", "val_start", "val_end"))]
    )


#: Folds that a fold table has at most.
MOST_FOLDS = 10_000


def assign(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once for each fold that uses it, with its role. ``folds`` is a table of parameters (a ValueError
    beyond MOST_FOLDS rows) and becomes part of the expression: no join."""
    table = folds.select("name", "train_start", "train_end", "val_start", "val_end").limit(MOST_FOLDS + 1).collect()
    if len(table) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    t = F.col("timestamp_utc")
    uses = []
    for f in table:
        train = (t >= F.lit(f["train_start"])) & (t < F.lit(f["train_end"]))
        val = (t >= F.lit(f["val_start"])) & (t < F.lit(f["val_end"]))
        uses.append(F.when(train | val, F.struct(F.lit(f["name"]).alias("fold"), F.when(train, "train").otherwise("val").alias("role"))))
    used = F.filter(F.array(*uses), lambda x: x.isNotNull()) if uses else F.array().cast("array<struct<fold:string,role:string>>")
    return df.select("*", F.explode(used).alias("__use")).select(*df.columns, "__use.fold", "__use.role")


def final_and_holdout(df: DataFrame, boundary: Column) -> DataFrame:
    """``df`` with ``role``: final_train before ``boundary``, holdout from it on."""
    return df.withColumn("role", F.when(F.col("timestamp_utc") < boundary, "final_train").otherwise("holdout"))


def stack_folds(parts: dict[str, DataFrame], keys: tuple[str, ...] = ("series_id", "timestamp_utc")) -> DataFrame:
    """The folds' rows one below the other, tagged ``fold``; a ValueError if two folds have the same key."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("fold", F.lit(name))
        out = one if out is None else out.unionByName(one)
    twice = out.groupBy(*keys).count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"folds overlap: {twice[0].asDict()}")
    return out


def violations(folds: DataFrame) -> DataFrame:
    """Folds that validate before training ends, and pairs whose validation windows overlap."""
    own = folds.where("train_end > val_start or train_start >= train_end or val_start >= val_end").select("name", F.lit(None).cast("string").alias("other"), F.lit("order").alias("rule"))
    few = folds.limit(MOST_FOLDS + 1).count() <= MOST_FOLDS
    a, b = folds.alias("a"), (F.broadcast(folds) if few else folds).alias("b")
    both = a.join(b, F.expr("a.name < b.name and a.val_start < b.val_end and b.val_start < a.val_end")).select(F.col("a.name").alias("name"), F.col("b.name").alias("other"), F.lit("overlap").alias("rule"))
    return own.unionByName(both)


def day_aligned_cv(df: DataFrame, k: int) -> DataFrame:
    """Per series and fold: first test day, last test day and training days. Distinct local days are cut
    into k + 1 parts of N div (k + 1) days; fold i tests on the days from N - (k - i) parts on."""
    days = df.select("series_id", local_date(F.col("timestamp_utc")).alias("day")).distinct()
    ranked = days.withColumns({"r": F.row_number().over(Window.partitionBy("series_id").orderBy("day")) - 1, "n": F.count("*").over(Window.partitionBy("series_id"))})
    test = F.floor(F.col("n") / (k + 1))
    placed = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("start", F.col("n") - (k - F.col("fold")) * test)
    inside = (F.col("r") >= F.col("start")) & (F.col("r") < F.col("start") + test)
    return placed.groupBy("series_id", "fold").agg(
        F.min(F.when(inside, F.col("day"))).alias("test_start"), F.max(F.when(inside, F.col("day"))).alias("test_end"),
        F.sum((F.col("r") < F.col("start")).cast("long")).alias("train_days"), F.sum(inside.cast("long")).alias("test_days"),
    )


def row_cv(df: DataFrame, k: int) -> DataFrame:
    """The same over rows in time order, each series in parts of N div (k + 1) rows."""
    w = Window.partitionBy("series_id")
    ranked = df.select("series_id", "timestamp_utc").withColumns({"r": F.row_number().over(w.orderBy("timestamp_utc")) - 1, "n": F.count("*").over(w)})
    test = F.floor(F.col("n") / (k + 1))
    placed = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("start", F.col("n") - (k - F.col("fold")) * test)
    inside = (F.col("r") >= F.col("start")) & (F.col("r") < F.col("start") + test)
    return placed.groupBy("series_id", "fold").agg(
        F.sum((F.col("r") < F.col("start")).cast("long")).alias("train_rows"), F.sum(inside.cast("long")).alias("test_rows"),
        F.min(F.when(inside, F.col("timestamp_utc"))).alias("test_start"), F.max(F.when(inside, F.col("timestamp_utc"))).alias("test_end"),
    )
