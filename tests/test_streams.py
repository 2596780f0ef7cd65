"""Streams of several batches: late rows, state over batches, and a restart."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.uncertainty import day_safe_quantiles
from tidemark.streaming import resample_hourly_stream
from tidemark.streaming.sequential import sequential_quantiles, use_rocksdb

SCHEMA = "series_id string, timestamp_utc timestamp, residual double"
START = datetime(2024, 3, 28)  # over a day of 23 hours


def some_rows(days):
    rng = np.random.default_rng(4)
    rows = []
    for s in "ab":
        for h in range(24 * days):
            if not (s == "b" and 48 <= h < 120):  # days without rows
                value = float(rng.normal())
                rows.append((s, START + timedelta(hours=h), float("nan") if h % 17 == 0 else float("inf") if h % 31 == 0 else value))
    return rows


def run_stream(spark, change, at, files=1):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
    query = change(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress]


def put(spark, rows, at):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")


@pytest.fixture
def rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_sequential_quantiles_equal_those_of_the_table(spark, rocksdb, tmp_path):
    rows = some_rows(16)
    stream = lambda x: sequential_quantiles(x, "residual", 5, 2, late="1 hour")
    half = START + timedelta(days=8)
    for k in range(4):  # four files of two days
        put(spark, [r for r in rows if START + timedelta(days=2 * k) <= r[1] < START + timedelta(days=2 * k + 2)], tmp_path)
    batches = run_stream(spark, stream, tmp_path)
    assert len([n for n in batches if n]) == 4
    before = spark.read.parquet(f"{tmp_path}/out").count()
    # a restart from its checkpoint goes on with what is held
    put(spark, [r for r in rows if r[1] >= half], tmp_path)
    run_stream(spark, stream, tmp_path)
    got = {(r.series_id, r.delivery_date): (r.q10, r.q50, r.q90) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert 0 < before < len(got)
    table = day_safe_quantiles(spark.createDataFrame(rows, SCHEMA), "residual", 5, 2)
    mark = max(r[1] for r in rows) - timedelta(hours=1)
    start = F.to_utc_timestamp(F.col("delivery_date").cast("timestamp"), "Europe/Berlin")
    want = {(r.series_id, r.delivery_date): (r.q10, r.q50, r.q90) for r in table.where(start <= F.lit(mark)).collect()}
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-12)


def test_late_rows_count_until_their_day_is_closed(spark, rocksdb, tmp_path):
    at = lambda d, h: datetime(2024, 1, d, h)
    put(spark, [("a", at(1, 5), 1.0), ("a", at(3, 12), 5.0)], tmp_path)  # the watermark comes to the 2nd, 12:00
    put(spark, [("a", at(2, 20), 3.0), ("a", at(1, 6), 100.0), ("a", at(5, 12), 9.0)], tmp_path)  # in time; too late; on
    run_stream(spark, lambda x: sequential_quantiles(x, "residual", 3, 1, (0.5,), late="24 hours"), tmp_path)
    got = {r.delivery_date.day: (r.q50, r.n_days) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {2: (1.0, 1), 3: (2.0, 2), 4: (3.0, 3)}


def test_hours_over_several_batches_with_late_rows(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    put(spark, [("a", at(1), 1.0), ("a", at(5), 5.0)], tmp_path)  # the watermark comes to 3:00
    put(spark, [("a", at(3, 30), 3.0), ("a", at(9), 9.0)], tmp_path)  # in time; on
    put(spark, [("a", at(1, 30), 100.0), ("a", at(9, 10), 9.0)], tmp_path)  # too late; on
    batches = run_stream(spark, lambda x: resample_hourly_stream(x, "residual"), tmp_path)
    assert len([n for n in batches if n]) == 3
    got = {(r.timestamp_utc.hour, r.residual, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 1.0, 1), (3, 3.0, 1), (5, 5.0, 1)}
    put(spark, [("a", at(8), 8.0), ("a", at(12, 30), 0.0)], tmp_path)  # after a restart: state is kept
    run_stream(spark, lambda x: resample_hourly_stream(x, "residual"), tmp_path)
    got = {(r.timestamp_utc.hour, r.residual, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 1.0, 1), (3, 3.0, 1), (5, 5.0, 1), (8, 8.0, 1), (9, 9.0, 2)}
