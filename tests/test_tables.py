"""Tables compared by hash trees, and bucketed tables whose folders are replaced one by one."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import checks, decisions, timeseries, uncertainty
from tidemark.sources import tables


def some(spark, n=500):
    return spark.range(n).select(
        F.when(F.col("id") != 7, F.col("id")).alias("k"), F.col("id").cast("string").alias("s"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("x"), F.lit(True).alias("b"),
    )


@pytest.mark.parametrize("ranges", [2, 16, 4096])
def test_differences_are_named(spark, ranges):
    left = some(spark)
    right = left.where("k <> 11 or k is null").withColumns({
        "x": F.when(F.col("k") == 12, 5.0).when(F.col("k") == 13, F.lit(None)).when(F.col("k").isNull(), F.lit(9.0)).otherwise(F.col("x")), "s": F.when(F.col("k") == 12, "z").otherwise(F.col("s")),
    })
    right = right.unionByName(left.where("k = 20").withColumn("k", F.lit(9999).cast("long"))).unionByName(right.where("k = 30"))
    got = {r["k"]: (r["side"], r["columns"]) for r in checks.table_diff(left, right, ["k"], ranges).collect()}
    assert got == {
        11: ("left", None), 12: ("changed", ["s", "x"]), 13: ("changed", ["x"]), None: ("changed", ["x"]), 9999: ("right", None), 30: ("repeated", None),
    }


def test_equal_tables_are_not_shuffled(spark):
    left = some(spark).cache()
    assert left.count() == 500
    other = left.orderBy(F.desc("k"))
    assert checks.table_diff(left, other, ["k"]).count() == 0
    a = left.withColumns({"__range": F.lit(1), "__h1": F.lit(1), "__h2": F.lit(2)})
    plan = checks._unequal(a, a, ["__range"])._jdf.queryExecution().executedPlan().toString()
    # what is exchanged is partial sums of a range
    assert plan.count("Exchange hashpartitioning(__range") >= 1 and "partial_sum" in plan and "Exchange hashpartitioning(k" not in plan
    assert checks.table_diff(left.limit(0), left.limit(0), ["k"]).count() == 0
    assert checks.table_diff(left.limit(0), left, ["k"]).where("side = 'right'").count() == 500


def test_other_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="columns differ"):
        checks.table_diff(some(spark), some(spark).withColumn("more", F.lit(1)), ["k"])


def test_values_of_nulls_and_neighbours_do_not_hash_alike(spark):
    left = spark.createDataFrame([(1, None, "a"), (2, "b", None)], "k int, x string, y string")
    right = spark.createDataFrame([(1, "a", None), (2, None, "b")], "k int, x string, y string")
    assert {(r["k"], tuple(r["columns"])) for r in checks.table_diff(left, right, ["k"]).collect()} == {(1, ("x", "y")), (2, ("x", "y"))}


def test_bucketed_series_need_no_exchange_and_are_replaced_by_folder(spark):
    start = datetime(2023, 12, 30)
    rows = spark.createDataFrame([(s, start + timedelta(hours=h), float(h)) for s in "abc" for h in range(96)], "series_id string, timestamp_utc timestamp, price double")
    rows = rows.withColumn("year", F.year("timestamp_utc"))
    name = "bucketed_series_test"
    tables.write_series(rows, name, part="year", buckets=4)
    held = spark.table(name)
    assert held.count() == 288
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        w = Window.partitionBy("series_id").orderBy("timestamp_utc")
        lagged = timeseries.safe_lag(held.select("series_id", "timestamp_utc", "price"), "price", 24, "lag").withColumn("n", F.row_number().over(w))
        plan = lagged._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "Exchange" not in plan
        joined = held.select("series_id", "timestamp_utc", "price").join(held.groupBy("series_id").agg(F.max("price").alias("m")), "series_id").hint("merge")
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    tables.replace_parts(rows.where("year = 2024 and series_id <> 'c'").withColumn("price", F.col("price") + 1000), name)
    got = {(r["year"], r["series_id"]): (r["n"], r["low"]) for r in spark.table(name).groupBy("year", "series_id").agg(F.count("*").alias("n"), F.min("price").alias("low")).collect()}
    assert got == {(2023, s): (48, 0.0) for s in "abc"} | {(2024, s): (48, 1048.0) for s in "ab"}
    spark.sql(f"DROP TABLE {name}")


def test_a_backtest_on_bucketed_series_needs_no_exchange(spark):
    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(s, start + timedelta(hours=h), float(h * k % 97)) for k, s in ((31, "a"), (57, "b")) for h in range(24 * 12)], "series_id string, timestamp_utc timestamp, price double")
    name = "bucketed_backtest_test"
    tables.write_series(rows, name, buckets=3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def judged(df):
            lagged = timeseries.safe_lag(timeseries.carry_forward(df, "price"), "price", 24, "pred")
            bounds = uncertainty.with_day_safe_bounds(lagged.withColumn("residual", F.col("price") - F.col("pred")), "pred", "residual", 3, 1)
            common = decisions.on_common_days(bounds, ["price", "pred", "L", "U"])
            return decisions.backtest(common, {"S1": ("pred", "pred"), "S2": ("L", "U")}, [(0.9, 5.0)])

        found = judged(spark.table(name))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        key = lambda r: tuple(map(str, r))
        assert sorted(found.collect(), key=key) == sorted(judged(rows).collect(), key=key)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.sql(f"DROP TABLE {name}")
