"""Quantiles over long windows of long series equal those of plain windows."""

import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import uncertainty

START = datetime(2024, 3, 10)  # over a day of 23 hours
SCHEMA = "series_id string, timestamp_utc timestamp, r double, p double"


def some(spark, days=60, seed=1):
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    rows = [
        (s, START + timedelta(hours=h), rng.choice(odd) if rng.random() < 0.1 else float(rng.randint(-3, 3)) if rng.random() < 0.5 else rng.uniform(-9, 9), rng.uniform(0, 100))
        for s in "ab" for h in range(24 * days) if not (s == "b" and 300 < h < 800) and rng.random() < 0.95
    ]
    return spark.createDataFrame([*rows, ("c", START, 1.0, 0.0)], SCHEMA).cache()


def near(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("window, least", [(1, 1), (20, 3), (400, 5)])
def test_days(spark, window, least):
    df = some(spark)
    assert near(uncertainty.day_safe_quantiles_long(df, "r", window, least)) == near(uncertainty.day_safe_quantiles(df, "r", window, least))


@pytest.mark.parametrize("days, least, prediction", [(1, 1, "p"), (6, 2, None), (90, 1, "p")])
def test_hours(spark, days, least, prediction):
    df = some(spark, 25, 2)
    plain = uncertainty.hourly_quantiles(df, "r", days, least, prediction=prediction).select("series_id", "timestamp_utc", "q10", "q50", "q90")
    assert near(uncertainty.hourly_quantiles_long(df, "r", days, least, prediction=prediction)) == near(plain)


def test_empty_tables(spark):
    df = some(spark).limit(0)
    assert uncertainty.day_safe_quantiles_long(df, "r", 7, 1).count() == uncertainty.hourly_quantiles_long(df, "r", 7, 1).count() == 0
    assert uncertainty.day_safe_quantiles_long(some(spark).withColumn("r", F.lit(float("nan"))), "r", 7, 1).count() == 0


def test_a_row_is_worked_on_as_often_for_any_window():
    rng = np.random.default_rng(1)
    at, values = np.repeat(np.arange(3000), 24), rng.normal(size=72000)

    def took(width):
        start, last = time.process_time(), None
        for last in uncertainty._sliding(at, values, np.arange(1, 3001), width):
            pass
        np.testing.assert_allclose(last, np.sort(values[-24 * width :]))
        return time.process_time() - start

    assert took(365) < 10 * took(30) + 0.5  # twelve times as many values in the window
