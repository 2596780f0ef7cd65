"""Running values and ranks in two levels equal plain windows, wherever ranges are cut."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import documents, forecast, metrics, reports, scan, timeseries

START = datetime(2024, 3, 20)


def table(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 0.0, 0.0, 0.0, float(rng.randint(-9, 9))])) for i in range(n)]
    return spark.createDataFrame(rows, "g string, t int, v double")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("parts, own", [(1, True), (3, False), (40, True)])
def test_prefixes_equal_windows(spark, parts, own):
    df = table(spark)
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    want = df.withColumns({"s": F.sum("v").over(w), "m": F.max("v").over(w), "l": F.last("v", ignorenulls=True).over(w)})
    made = {"s": scan.running_sum("v"), "m": scan.running_max("v"), "l": scan.last_value("v", ["t"])}
    assert rows_of(scan.with_prefix(df, ["g"], ["t"], made, own, parts)) == rows_of(want)
    assert scan.with_prefix(df.limit(0), ["g"], ["t"], made, own, parts).count() == 0


@pytest.mark.parametrize("parts", [4, 50])
def test_drops_equal_windows(spark, parts):
    df = table(spark, seed=2)
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = df.where("v is not null").withColumn("c", F.sum("v").over(w)).withColumn("p", F.max("c").over(w))
    assert rows_of(scan.largest_drop(df, ["g"], ["t"], "v", parts)) == rows_of(run.groupBy("g").agg(F.max(F.col("p") - F.col("c")).alias("d")))


@pytest.mark.parametrize("parts", [2, 7, 60])
def test_average_ranks_equal_windows(spark, parts):
    df = table(spark, seed=3).where("v is not null").cache()
    w = Window.partitionBy("g").orderBy("v")
    want = df.withColumn("r", F.rank().over(w) + (F.count("*").over(Window.partitionBy("g", "v")) - 1) / 2)
    assert rows_of(scan.with_average_rank(df, ["g"], "v", "r", parts)) == rows_of(want)


def test_equal_values_are_spread_over_tasks(spark):
    df = spark.range(4000).select(F.lit(1).alias("g"), F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    placed = scan.ranges(df.withColumn("__id", F.monotonically_increasing_id()), ["g"], ["v", "__id"], 8)
    sizes = [r["count"] for r in placed.groupBy("__part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8  # nine of ten rows have one value
    ranks = {(r["v"], r["r"]) for r in scan.with_average_rank(df, ["g"], "v", "r", 8).collect()}
    assert (0.0, (1 + 3601) / 2) in ranks and len(ranks) == 400  # id 0 is a zero too


def test_correlations_of_groups_and_all(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), rng.choice([0.0, 0.0, rng.random()]), rng.choice([1.0, rng.random()])) for _ in range(200)] + [("z", 1.0, 2.0), ("x", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r["k"] if r["n"] < 201 else "all": (r["n"], r["pearson"], r["spearman"]) for r in metrics.correlations(df, ["k"], "a", "b", overall=True).collect()}
    pdf = df.toPandas().dropna(subset=["a", "b"])
    for k, part in [("all", pdf), ("x", pdf[pdf.k == "x"]), (None, pdf[pdf.k.isna()])]:
        n, pearson, spearman = got[k]
        assert n == len(part) and abs(pearson - part.a.corr(part.b)) < 1e-9 and abs(spearman - part.a.rank().corr(part.b.rank())) < 1e-9


def test_long_forms_equal_plain_ones(spark):
    rng = random.Random(5)
    days = [(s, (START + timedelta(days=i)).date(), None if rng.random() < 0.1 else rng.uniform(-5, 5)) for s in "pq" for i in range(60)] + [("r", START.date(), 1.0)]
    pnl = spark.createDataFrame(days, "strategy string, delivery_date date, net_pnl double").cache()
    near = lambda df: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows_of(df)]
    assert near(reports.cumulative(pnl, ["strategy"], long=True)) == near(reports.cumulative(pnl, ["strategy"]))
    assert near(reports.drawdown(pnl, ["strategy"], long=True)) == near(reports.drawdown(pnl, ["strategy"]))
    hours = spark.createDataFrame([("a", START + timedelta(hours=i), None if rng.random() < 0.6 else float(i)) for i in range(200)], "series_id string, timestamp_utc timestamp, price double")
    assert rows_of(timeseries.carry_forward(hours, "price", long=True)) == rows_of(timeseries.carry_forward(hours, "price"))
    spans = [("s", START + timedelta(hours=i), START + timedelta(hours=i + rng.randint(1, 9))) for i in range(100)]
    spans = spark.createDataFrame(spans, "ts_uid string, start timestamp, end timestamp")
    assert rows_of(documents.period_gaps(spans, long=True)) == rows_of(documents.period_gaps(spans))


def test_profiles_of_all_windows_equal_those_of_each(spark):
    rng = random.Random(6)
    rows = [(s, START + timedelta(hours=i), rng.uniform(-50, 200)) for s in "ab" for i in range(24 * 20) if rng.random() < 0.6 and not (s == "b" and 100 < i < 200)]
    df = spark.createDataFrame(rows, "series_id string, timestamp_utc timestamp, v double").cache()
    made = forecast.trailing_profiles(df, "v", [1, 3, 30]).cache()
    for w in (1, 3, 30):
        got = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows_of(made.where(f"window_days = {w}").drop("window_days"))]
        assert got == [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows_of(forecast.trailing_profile(df, "v", w))]
