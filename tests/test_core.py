"""Hand-computed cases, daylight-saving days, hostile perturbations and two-way checks."""

import hashlib
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions.columns import draw
from tidemark.operators import checks, decisions, documents, forecast, joins, metrics, quantiles, reports, splits, timeseries, uncertainty
from tidemark.streaming import dedupe_stream, resample_hourly_stream
from tidemark.plans import registry


def hours(spark, start, n, value=lambda i: float(i)):
    at = datetime.fromisoformat(start)
    return spark.createDataFrame([("a", at + timedelta(hours=i), value(i)) for i in range(n)], "series_id string, timestamp_utc timestamp, price double")


def test_dst_days_have_23_and_25_hours(spark):
    year = hours(spark, "2024-01-01T00:00:00", 366 * 24)
    got = {str(r.delivery_date): r.hours for r in timeseries.dst_days(year).collect()}
    assert got == {"2024-03-31": 23, "2024-10-27": 25}


def test_lag_on_the_autumn_day_is_null_where_it_stays_on_the_date(spark):
    rows = timeseries.safe_lag(hours(spark, "2024-10-25T22:00:00", 80), "price", 24, "lag")
    bad = {r.timestamp_utc.isoformat() for r in rows.where("lag is null").collect()}
    assert "2024-10-27T22:00:00" in bad  # 23:00 local; a day before is 00:00 of the same date
    assert timeseries.information_set_violations(rows, {"lag": 24}).first().violations == 0
    with pytest.raises(ValueError):
        timeseries.safe_lag(rows, "price", 23, "x")
    with pytest.raises(ValueError):
        timeseries.information_set_safe(rows, {"price": 0})


def test_same_day_residuals_do_not_move_a_bound_and_earlier_ones_do(spark):
    base = hours(spark, "2024-01-01T00:00:00", 24 * 12, lambda i: float(i * 7 % 13))
    bound = lambda df: {str(r.delivery_date): (r.q10, r.q90) for r in uncertainty.day_safe_quantiles(df, "price", 3, 2).collect()}
    change = lambda day: base.withColumn("price", F.when(F.to_date(F.from_utc_timestamp("timestamp_utc", "Europe/Berlin")) == day, 999.0).otherwise(F.col("price")))
    before = bound(base)
    assert bound(change("2024-01-08"))["2024-01-08"] == before["2024-01-08"]
    assert bound(change("2024-01-07"))["2024-01-08"] != before["2024-01-08"]
    assert "2024-01-01" not in before and "2024-01-02" not in before


def test_best_pair_equals_all_pairs(spark):
    rng = random.Random(2)
    rows = [(f"d{d}", p, float(rng.randint(-5, 9)), float(rng.randint(-5, 9)), 0.85, rng.choice([0.0, 3.0, 50.0])) for d in range(60) for p in range(rng.choice([1, 23, 24, 25]))]
    cost = {}
    rows = [(d, p, b, a, e, cost.setdefault(d, c)) for d, p, b, a, e, c in rows]
    df = spark.createDataFrame(rows, "day string, pos int, bid double, ask double, eta double, cost double")
    fast, slow = (sorted(map(tuple, f(df, ["day"]).select("day", "i", "j").collect()), key=str) for f in (decisions.best_pair, decisions.best_pair_naive))
    assert fast == slow and any(r[1] is None for r in fast)


def test_expected_shortfall_weighs_the_boundary(spark):
    days = spark.createDataFrame([("x", "S1", -float(i)) for i in range(1, 13)], "series_id string, strategy string, net_pnl double")
    got = {r.level: r for r in reports.var_es(days, ["strategy"]).collect()}
    assert got[0.9].es == pytest.approx((12 + 0.2 * 11) / 1.2) and got[0.9].low_precision
    flat = spark.createDataFrame([("S", -2.0)] * 30, "strategy string, net_pnl double")
    assert all(r.es == pytest.approx(2.0) for r in reports.var_es(flat, ["strategy"]).collect())


def test_block_bootstrap_reruns_agree_and_hold_the_total(spark):
    delta = spark.createDataFrame([(datetime(2024, 1, 1).date() + timedelta(days=i), float(i % 5)) for i in range(40)], "delivery_date date, delta double")
    a, b = (reports.block_bootstrap(delta, 7, 300, 5).first() for _ in range(2))
    assert a == b and a.low < 80 < a.high
    same = delta.withColumn("delta", F.lit(2.0))
    assert reports.block_bootstrap(same, 7, 50, 5).first()[1:] == (80.0, 80.0)


def test_blocks_expand_and_bad_points_show(spark):
    periods = spark.createDataFrame([("p", "s", 1, "A03", "2024-01-01 00:00:00", "2024-01-01 01:00:00", "PT15M"), ("q", "s", 1, "A03", "2024-01-01 02:00:00", "2024-01-01 03:00:00", "PT15M")], "period_id string, ts_uid string, sequence int, curve_type string, start string, end string, resolution string")
    periods = periods.withColumns({c: F.to_timestamp(c) for c in ("start", "end")})
    points = spark.createDataFrame([("p", 1, 5.0), ("p", 3, 7.0), ("q", 2, 1.0)], "period_id string, position int, value double")
    got = [(r.value, r.is_synthesized) for r in documents.expand_blocks(periods, points).where("period_id = 'p'").orderBy("position").collect()]
    assert got == [(5.0, False), (5.0, True), (7.0, False), (7.0, True)]
    assert {tuple(r) for r in documents.point_violations(periods, points).collect()} == {("q", "a03_start")}
    assert [r.gap for r in documents.period_gaps(periods).orderBy("start").collect()] == [False, True]


def test_documents_flatten(spark):
    xml = """<Doc xmlns="urn:x"><mRID>1</mRID><TimeSeries><mRID>t</mRID><curveType>A03</curveType><Period><timeInterval><start>2024-01-01T00:00Z</start><end>2024-01-01T01:00Z</end></timeInterval>
    <resolution>PT60M</resolution><Point><position>1</position><price.amount>4.5</price.amount></Point></Period></TimeSeries></Doc>"""
    (r,) = documents.flatten(spark.createDataFrame([(1, xml)], "id int, xml string")).collect()
    assert (r.id, r.ts_uid, r.curve_type, r.position, r.value) == (1, "t", "A03", 1, 4.5)


def test_checks_find_what_is_wrong(spark):
    day = datetime(2024, 1, 1).date()
    rows = spark.createDataFrame([("S1", day, 24, True, 5, 3, 1.0, 1.0, 9.0), ("S0", day, 22, False, None, None, 0.0, 0.0, 9.0)], "strategy string, delivery_date date, n_hours int, traded boolean, i int, j int, gross_pnl double, net_pnl double, oracle_pnl double")
    assert {r.rule for r in checks.conditions(rows, checks.BACKTEST_RULES).collect()} == {"order", "n_hours"}
    with pytest.raises(ValueError):
        checks.raise_on(checks.conditions(rows, checks.BACKTEST_RULES))
    other = rows.withColumn("net_pnl", F.col("net_pnl") + 1e-3)
    got = {r.field: r.mismatches for r in checks.reproduction(rows, other, ["strategy", "delivery_date"], ["i", "j"], ["net_pnl"]).collect()}
    assert got == {"only_saved": 0, "only_computed": 0, "i": 0, "j": 0, "net_pnl": 2}
    assert checks.fingerprint(rows).first() == checks.fingerprint(rows.repartition(3)).first()


def test_folds_that_overlap_show(spark):
    folds = splits.fold_table(spark, [("a", "2024-01-01", "2024-01-09", "2024-01-08", "2024-01-15"), ("b", "2024-01-01", "2024-01-08", "2024-01-14", "2024-01-20")])
    assert {(r.name, r.rule) for r in splits.violations(folds).collect()} == {("a", "order"), ("a", "overlap")}


def test_drawdown_starts_at_the_first_value(spark):
    days = spark.createDataFrame([("S", datetime(2024, 1, 1 + i).date(), v) for i, v in enumerate([-5.0, 2.0, -4.0])], "strategy string, delivery_date date, net_pnl double")
    r = reports.drawdown(days, ["strategy"]).first()
    assert r.max_drawdown == 4.0 and r.worst_span is None


def test_hourly_means_on_a_stream(spark, tmp_path):
    hours(spark, "2024-01-01T00:00:00", 48).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, timestamp_utc timestamp, price double").parquet(str(tmp_path / "in"))
    q = resample_hourly_stream(stream, "price").writeStream.format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.timestamp_utc.isoformat(): (r.price, r.n) for r in spark.table("hourly").collect()}
    # the watermark is two hours before the last row, so the hours that end by then are given out
    assert got == {(datetime(2024, 1, 1) + timedelta(hours=i)).isoformat(): (float(i), 1) for i in range(45)}


def test_one_row_a_key_on_a_stream(spark, tmp_path):
    at = datetime(2024, 1, 1)
    table = spark.createDataFrame([("a", at, 1.0), ("a", at, 2.0), ("b", at, 3.0), ("a", at + timedelta(hours=1), 4.0)], "series_id string, timestamp_utc timestamp, price double")
    table.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = dedupe_stream(stream, ["series_id", "timestamp_utc"]).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.series_id, r.timestamp_utc.hour) for r in spark.table("once").collect())
    assert got == [("a", 0), ("a", 1), ("b", 0)]


def test_registry(spark):
    found = __spark_entry__.queries()
    assert set(registry.queries()) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).count() > 0


def test_row_folds(spark):
    rows = spark.range(8).selectExpr("'a' AS series_id", "timestamp_seconds(id * 3600) AS timestamp_utc")
    folds = sorted((r.fold, r.train_rows, r.test_rows) for r in splits.row_cv(rows, 3).collect())
    assert folds == [(0, 2, 2), (1, 4, 2), (2, 6, 2)]


def test_written_tables_come_back_and_versions_stay(spark):
    import pytest

    from tidemark.sources import tables

    path = tables.scratch(spark)
    rows = spark.createDataFrame([("x", 1.5), ("y", None)], "k string, v double")
    tables.write_version(rows, path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("x", 1.5), ("y", None)]
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_version(rows, path)


def test_draw_depends_on_texts_alone(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (1, None)], "n int, t string")
    got = [r[0] for r in rows.select(draw(F.col("n"), F.col("t"))).collect()]
    assert got == [int(hashlib.md5(t).hexdigest()[:15], 16) for t in (b"1/a", b"2/a", b"1")]


def test_availability_of_derived_columns(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None), (2.0, 3.0)], "a double, b double").withColumn("ab", F.col("a") + F.col("b"))
    got = {r["column"]: (r["tier"], r["n_present"]) for r in checks.availability(rows, {"a": 1, "b": 2}, {"ab": ["a", "b"]}).collect()}
    assert got == {"a": (1, 2), "b": (2, 1), "ab": (2, 1)}


def test_coefficients_are_ordered_by_magnitude(spark):
    rows = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i - 50.0 * (i % 3)) for i in range(30)], "a double, b double, y double")
    got = forecast.coefficients(forecast.elastic_net(rows, ["a", "b"], "y", 0.0, 0.5), ["a", "b"]).orderBy("rank").collect()
    sd = {c: rows.agg(F.stddev_samp(c)).first()[0] for c in "ab"}
    assert [(r["rank"], r["feature"]) for r in got] == [(1, "b"), (2, "a")]
    assert abs(got[0]["weight"] + 50 * sd["b"]) < 1e-6 and abs(got[1]["weight"] - 2 * sd["a"]) < 1e-6


def test_frontier_thresholds_the_decision_score(spark):
    at = lambda n: datetime(2024, 1, n).date()
    days = [("a", at(1), "S2", True, 70.0, 10.0), ("a", at(2), "S2", True, 45.0, -30.0), ("a", at(3), "S2", True, 10.0, 200.0), ("a", at(4), "S2", False, None, 0.0)]
    days += [("a", at(n), "S4", n in (2, 3), 5.0 if n in (2, 3) else None, 1.0) for n in range(1, 5)]
    table = spark.createDataFrame(days, "series_id string, delivery_date date, strategy string, traded boolean, score double, net_pnl double").withColumn("gross_pnl", F.lit(500.0))
    got = {r.tau: r for r in reports.threshold_frontier(table, "score", [0.0, 42.5, 60.0], ["series_id", "strategy"], "S4").where("strategy = 'S2'").collect()}
    cells = lambda r: (r.trades, r.pnl, r.hit_rate, r.worst, r.max_drawdown, r.overlap, r.threshold_only, r.other_only)
    assert cells(got[0.0]) == (3, 180.0, 2 / 3, -30.0, -30.0, 2, 1, 0)
    assert cells(got[42.5]) == (2, -20.0, 0.5, -30.0, -30.0, 1, 1, 1)
    assert cells(got[60.0]) == (1, 10.0, 1.0, 0.0, 0.0, 0, 1, 2)
    hours_of = spark.createDataFrame([("a", at(1), datetime(2024, 1, 1, i), p, f) for i, (p, f) in enumerate([(10.0, 0.0), (5.0, 100.0)])], "series_id string, delivery_date date, timestamp_utc timestamp, price double, f double")
    one = decisions.backtest(hours_of, {"S1": ("f", "f")}, spark.createDataFrame([(1.0, 10.0)], "eta double, c double")).where("strategy = 'S1'").first()
    assert (one.score, one.net_pnl) == (80.0, -25.0)


def test_audit_dates_put_dst_days_first_and_space_the_rest(spark):
    day = lambda n: (datetime(2024, 3, 1) + timedelta(days=n)).date()
    gaps = {n: 1.0 + n % 7 / 10 for n in range(40)} | {5: 9.0, 20: 0.5}
    rows = spark.createDataFrame([("a", day(n), g) for n, g in gaps.items()] + [("a", day(0), 0.1)], "series_id string, delivery_date date, abs_diff double")
    dst = spark.createDataFrame([(day(30),), (datetime(2023, 3, 26).date(),)], "delivery_date date")
    got = {r.delivery_date: r.reason for r in checks.disagreement_dates(rows, dst, 8).collect()}
    assert got == {day(30): "dst", day(0): "first", day(39): "last", day(5): "largest", day(20): "smallest", day(6): "spaced", day(11): "spaced", day(17): "spaced"}
    assert [r.reason for r in checks.disagreement_dates(rows, dst, 1).collect()] == ["dst"]
    assert checks.disagreement_dates(rows.limit(0), dst, 8).count() == 0


def test_common_start_is_the_latest_and_profile_gains_are_shares(spark):
    at = lambda n: datetime(2024, 1, n)
    cand = spark.createDataFrame([(5, at(3), 1.0), (5, at(9), 1.0), (7, at(4), None), (7, at(6), 1.0)], "window_days int, timestamp_utc timestamp, L double")
    assert {(r.window_days, r.first_valid, r.common_start) for r in uncertainty.common_start(cand, 2).collect()} == {(5, at(3), at(6)), (7, at(6), at(6))}
    assert {r.common_start for r in uncertainty.common_start(cand, 3).collect()} == {None}
    days = spark.createDataFrame([("S1", 10.0), ("S2", 30.0), ("S2", 20.0), ("p3", 25.0), ("p5", 5.0)], "strategy string, net_pnl double")
    assert {tuple(r) for r in reports.profile_gains(days, {"p3": 3, "p5": 5}, "S2", "S1").collect()} == {(3, 25.0, 25.0, 15.0, 0.375), (5, 5.0, 45.0, -5.0, -0.125)}


def by_time(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("timestamp_utc").collect()]


def test_rolling_statistics_stand_where_a_rows_own_lag_is_missing(spark):
    rows = hours(spark, "2024-01-01T00:00:00", 72).where("hour(timestamp_utc) <> 5 or day(timestamp_utc) <> 2")
    lagged = timeseries.safe_lag(timeseries.regularize(rows), "price", 24, "lag")
    got = {r.timestamp_utc: r for r in timeseries.rolling_stats(lagged, "lag", 24, "roll").collect()}
    gap = got[datetime(2024, 1, 3, 5)]  # its lag is the missing hour; 23 of 24 values are there
    assert gap.lag is None and gap.roll_mean == pytest.approx(sum(i for i in range(6, 30) if i != 29) / 23)
    assert got[datetime(2024, 1, 2, 17)].roll_mean is None  # 18 values of 24
    assert got[datetime(2024, 1, 2, 18)].roll_mean == pytest.approx(9.0)  # 19


def test_rolling_statistics_are_null_where_a_rows_own_lag_is_unsafe(spark):
    rows = timeseries.safe_lag(hours(spark, "2024-10-20T22:00:00", 24 * 9), "price", 24, "lag")
    got = {r.timestamp_utc.isoformat(): r for r in timeseries.rolling_stats(rows, "lag", 24, "roll").collect()}
    assert got["2024-10-27T22:00:00"].roll_mean is None and got["2024-10-27T21:00:00"].roll_mean is not None
    after = got["2024-10-27T23:00:00"]  # the unsafe hour is in no later window either
    assert after.roll_mean == pytest.approx(sum(i for i in range(122, 146) if i != 144) / 23)


def test_regularize_fills_gaps_in_one_pass(spark):
    rows = hours(spark, "2024-01-01T00:00:00", 6).where("hour(timestamp_utc) not in (2, 3)").unionByName(spark.createDataFrame([("b", datetime(2024, 1, 5), 9.0)], "series_id string, timestamp_utc timestamp, price double"))
    got = timeseries.regularize(rows)
    assert by_time(got.where("series_id = 'a'"), "price") == [(0.0,), (1.0,), (None,), (None,), (4.0,), (5.0,)]
    assert got.where("series_id = 'b'").count() == 1 and timeseries.regularize(rows.limit(0)).count() == 0
    twice = timeseries.regularize(rows.unionByName(rows))
    assert twice.count() == 2 * 4 + 2 + 2


def test_infinite_residuals_do_not_count(spark):
    inf = float("inf")
    base = hours(spark, "2024-01-01T00:00:00", 24 * 5)
    bad = base.withColumn("price", F.when(F.col("price") == 30, inf).when(F.col("price") == 31, -inf).when(F.col("price") == 32, float("nan")).otherwise(F.col("price")))
    got = {str(r.delivery_date): (r.q10, r.q90) for r in uncertainty.day_safe_quantiles(bad, "price", 3, 1).collect()}
    want = {str(r.delivery_date): (r.q10, r.q90) for r in uncertainty.day_safe_quantiles(base.where("price not in (30, 31, 32)"), "price", 3, 1).collect()}
    assert got == want
    bounds = uncertainty.with_day_safe_bounds(bad.withColumn("p", F.lit(0.0)), "p", "price", 3, 1)
    same = uncertainty.attach_bounds(bad.withColumn("p", F.lit(0.0)), "p", uncertainty.day_safe_quantiles(bad, "price", 3, 1))
    assert by_time(bounds, "timestamp_utc", "L", "U") == by_time(same, "timestamp_utc", "L", "U")
    few = uncertainty.with_day_safe_bounds(bad.withColumn("p", F.lit(0.0)), "p", "price", 3, 3)
    assert {str(r.delivery_date) for r in few.where("L is not null").collect()} == {"2024-01-04", "2024-01-05", "2024-01-06"}


def test_dedupe_refuses_too_many_duplicates(spark):
    rows = hours(spark, "2024-01-01T00:00:00", 100)
    assert timeseries.dedupe(rows.unionByName(rows.limit(1)), ["timestamp_utc"], [F.col("price")]).count() == 100
    with pytest.raises(ValueError, match="repeat"):
        timeseries.dedupe(rows.unionByName(rows.limit(2)), ["timestamp_utc"], [F.col("price")])
    assert timeseries.dedupe(rows.unionByName(rows), ["timestamp_utc"], [F.col("price")], None).count() == 100
    assert timeseries.dedupe(rows.limit(0), ["timestamp_utc"], [F.col("price")]).count() == 0


def test_both_resolutions_are_selected_by_time(spark):
    at, cut = datetime(2024, 1, 1), F.to_timestamp(F.lit("2024-01-01 02:00:00"))
    table = [(at + timedelta(hours=h), m, float(h)) for h in range(4) for m in (15, 60)] + [(at + timedelta(hours=2, minutes=15), 15, 9.0), (at + timedelta(minutes=15), 15, 9.0)]
    rows = spark.createDataFrame(table, "timestamp_utc timestamp, resolution_min int, price double")
    got = {(r.timestamp_utc.hour, r.timestamp_utc.minute, r.resolution_min) for r in documents.select_resolution(rows, cut).collect()}
    assert got == {(0, 0, 60), (1, 0, 60), (2, 0, 15), (2, 15, 15), (3, 0, 15)}


def results(spark, rows):
    """``series, day of January 2024, strategy, traded, i, j, net``."""
    table = [(s, datetime(2024, 1, d).date(), n, t, i, j, p) for s, d, n, t, i, j, p in rows]
    return spark.createDataFrame(table, "series_id string, delivery_date date, strategy string, traded boolean, i int, j int, net_pnl double")


def test_decomposition_has_all_categories_for_each_group(spark):
    days = [(1, True, 1, 5, 10.0, False, None, None, 0.0), (2, True, 1, 5, -4.0, False, None, None, 0.0), (3, False, None, None, 0.0, True, 2, 6, 3.0), (4, True, 1, 5, 7.0, True, 1, 5, 7.0), (5, True, 1, 5, 7.0, True, 2, 5, 9.0), (6, False, None, None, 0.0, False, None, None, 0.0)]
    rows = [(s, d, n, *x) for s in "ab" for d, *rest in days for n, x in (("P", rest[:4]), ("U", rest[4:]))]
    got = reports.decompose(results(spark, rows), "P", "U", ["series_id"]).collect()
    assert {r.series_id for r in got} == {"a", "b"}
    for r in got:
        assert (r.n_days, r.n_both_abstain, r.n_point_only, r.n_uncertainty_only, r.n_same_pair, r.n_different_pair) == (6, 1, 2, 1, 1, 1)
        assert (r.profits_forgone, r.losses_avoided, r.pair_effect, r.reverse_effect, r.same_pair_difference, r.total_gap, r.reconciles) == (10.0, 4.0, 2.0, 3.0, 0.0, -1.0, True)
    off = [("a", 1, "P", True, 1, 5, 7.0), ("a", 1, "U", True, 1, 5, 7.5)]
    assert not reports.decompose(results(spark, off), "P", "U", []).first().reconciles


def test_backtest_rules_catch_each_damage(spark):
    day = datetime(2024, 1, 1).date()
    good = ("a", day, "S1", "true", "2", "5", 24, 1.0, 9.0)
    schema = "series_id string, delivery_date date, strategy string, traded string, i string, j string, n_hours int, net_pnl double, oracle_pnl double"
    change = lambda **to: tuple(to.get(n, v) for n, v in zip([x.split()[0] for x in schema.split(", ")], good))
    cases = {
        "null_day": change(delivery_date=None), "n_hours": change(n_hours=22), "traded_no_flag": change(traded="yes!"), "not_finite": change(net_pnl=float("nan")),
        "trade_without_pair": change(i=None), "pair_without_trade": change(traded="false", net_pnl=0.0), "pair_no_number": change(i="x"), "pair_not_whole": change(i="2.5"),
        "order": change(i="5"), "bounds": change(j="24"), "idle_pnl": change(traded="false", i=None, j=None), "above_oracle": change(net_pnl=9.1), "s0_trades": change(strategy="S0"),
    }
    assert set(cases) == set(checks.BACKTEST_RULES)
    assert checks.backtest_violations(spark.createDataFrame([good], schema)).count() == 0
    for rule, row in cases.items():
        assert {r.rule for r in checks.backtest_violations(spark.createDataFrame([row], schema)).collect()} == {rule}, rule
    assert [tuple(r) for r in checks.backtest_violations(spark.createDataFrame([good] * 3, schema)).collect()] == [("duplicate_day", 2)]
    late = {r.rule: r.violations for r in checks.pnl_violations(spark.createDataFrame([good, good, change(strategy="S0")], schema), "2024-01-01").collect()}
    assert late == {"holdout": 3, "s0": 1, "duplicate_day": 1}


def test_coverage_tells_missing_extra_and_bad_hours(spark):
    whole = hours(spark, "2023-12-31T23:00:00", 48)  # the local days of January 1 and 2
    assert checks.coverage_violations(whole, "2024-01-01", "2024-01-03").count() == 0
    broken = whole.where("price <> 7").withColumn("price", F.when(F.col("price") == 9, float("nan")).otherwise(F.col("price")))
    broken = broken.unionByName(whole.where("price = 3")).unionByName(hours(spark, "2024-01-03T05:00:00", 2))
    got = {r.rule: r.violations for r in checks.coverage_violations(broken, "2024-01-01", "2024-01-03").collect()}
    assert got == {"missing_hours": 1, "bad_targets": 1, "duplicate_hours": 1, "extra_hours": 2, "extra_days": 1}
    assert {r.rule for r in checks.coverage_violations(whole, "2024-01-01", "2024-01-04").collect()} == {"missing_hours", "missing_days"}


def test_exact_quantiles_equal_percentile(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["x", "y", None]), rng.choice([rng.uniform(-5, 5), float(rng.randint(0, 3)), None])) for _ in range(500)] + [("z", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for p in (0.0, 0.05, 0.5, 0.77, 1.0):
        got = {r.g: r.q for r in quantiles.quantiles(df, ["g"], "v", {"q": p}).collect()}
        want = {r.g: r.q for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", F.lit(p)).alias("q")).collect()}
        assert got == pytest.approx(want)
    assert quantiles.quantiles(df, [], "v", {"q": 0.5}).first().q == pytest.approx(df.agg(F.median("v")).first()[0])
    assert quantiles.quantiles(df.limit(0), ["g"], "v", {"q": 0.5}).count() == 0 and quantiles.quantiles(df.limit(0), [], "v", {"q": 0.5}).first().q is None
    days = spark.createDataFrame([(datetime(2024, 1, d).date(),) for d in (9, 2, 30, 4)], "d date")
    assert {(r.d.day, r.k) for r in quantiles.numbered(days, "d", "k").collect()} == {(2, 0), (4, 1), (9, 2), (30, 3)}


def test_correlation_of_average_ranks(spark):
    x, y = [1.0, 2.0, 2.0, 4.0, 5.0], [2.0, 1.0, 1.0, 5.0, 4.0]
    r = metrics.correlations(spark.createDataFrame(list(zip(x, y)), "x double, y double"), [], "x", "y").first()
    rx, ry = [1, 2.5, 2.5, 4, 5], [3, 1.5, 1.5, 5, 4]
    n = lambda a: [v - sum(a) / 5 for v in a]
    want = sum(p * q for p, q in zip(n(rx), n(ry))) / (sum(p * p for p in n(rx)) * sum(q * q for q in n(ry))) ** 0.5
    assert r.spearman == pytest.approx(want) and r.n == 5


def test_elastic_net_equals_coordinate_descent(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 3)) * [1, 5, 2] + [0, 3, -1]
    y = x @ [3.0, -0.4, 0.0] + rng.standard_normal(200) * 2 + 10
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    z = (x - x.mean(0)) / x.std(0)
    for alpha, ratio in ((0.5, 0.5), (1.0, 1.0), (2.0, 0.0), (0.01, 0.1)):
        w = np.zeros(3)
        for _ in range(2000):  # minimizes |y - zw|^2 / 2n + alpha * (ratio * |w|_1 + (1 - ratio) / 2 * |w|^2)
            for j in range(3):
                c = z[:, j] @ (y - y.mean() - z @ w + z[:, j] * w[j]) / 200
                w[j] = np.sign(c) * max(abs(c) - alpha * ratio, 0) / (1 + alpha * (1 - ratio))
        made = forecast.elastic_net(df, ["a", "b", "c"], "y", alpha, ratio).transform(df).select("a", "prediction").collect()
        want = dict(zip(x[:, 0], y.mean() + z @ w))
        assert max(abs(r.prediction - want[r.a]) for r in made) < 1e-3


def test_search_takes_the_cell_of_the_lowest_error(spark):
    table = [("a", datetime(2024, 1, 1) + timedelta(hours=i), float(i % 24), float(i % 7), 3.0 * (i % 24) + (i % 5)) for i in range(480)]
    df = spark.createDataFrame(table, "series_id string, timestamp_utc timestamp, f double, g double, y double")
    grid = forecast.cells(alpha=[50.0, 0.01], l1_ratio=[0.5])
    model, best, scores = forecast.search(df, ["f", "g"], "y", forecast.elastic_net, grid, 3, "days")
    assert best == {"alpha": 0.01, "l1_ratio": 0.5} and scores.count() == 6
    parts = {(r.part, r.n) for r in forecast.with_parts(df, 3, "days").groupBy("part").agg(F.count("*").alias("n")).collect()}
    # 21 local days, cut into 4: 5 test days in each part; the first and the last day are short
    assert {p for p, _ in parts} == {-1, 0, 1, 2} and dict(parts)[0] == 120
    rows = {(r.part, r.n) for r in forecast.with_parts(df, 3, "rows").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert rows == {(p, 120) for p in (-1, 0, 1, 2)}
    trees, cell, _ = forecast.search(df, ["f", "g"], "y", forecast.boosted_trees, forecast.cells(maxDepth=[1, 3], maxIter=[5]), 2, "days")
    assert cell["maxDepth"] == 3
    naive = df.withColumns({"fold": F.when(F.col("timestamp_utc") >= datetime(2024, 1, 11), 2), "p": F.lit(30.0)})
    fits = {"trees": lambda t: forecast.boosted_trees(t, ["f", "g"], "y", maxDepth=3, maxIter=5), "flat": lambda t: forecast.Naive("p")}
    made = {r.model: r for r in metrics.point_metrics(forecast.evaluate_folds(naive, ["f", "g"], "y", fits, [2], ["p"]), ["model"], "y").collect()}
    assert made["trees"].mae < made["flat"].mae and made["trees"].n == made["flat"].n == 240
    with pytest.raises(ValueError, match="fewer"):
        forecast.search(df.limit(50), ["f", "g"], "y", forecast.elastic_net, grid)
    with pytest.raises(ValueError, match="twice"):
        forecast.search(df.unionByName(df), ["f", "g"], "y", forecast.elastic_net, grid)
    assert [len(forecast.cells(**p)) for p in forecast.LINEAR_PROFILES.values()] == [60, 95]


def test_folds_that_overlap_cannot_be_stacked(spark):
    rows = hours(spark, "2024-01-01T00:00:00", 10)
    assert splits.stack_folds({"1": rows.where("price < 5"), "2": rows.where("price >= 5")}).count() == 10
    with pytest.raises(ValueError, match="overlap"):
        splits.stack_folds({"1": rows.where("price < 6"), "2": rows.where("price >= 5")})


def test_pivot_refuses_a_type_twice(spark):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(at, "a", 1.0), (at, "b", 2.0), (at + timedelta(hours=1), "b", 3.0)], "timestamp_utc timestamp, type string, value double")
    got = timeseries.pivot_types(rows, ["a", "b", "c"])
    assert by_time(got, "a", "b", "c") == [(1.0, 2.0, None), (None, 3.0, None)]
    with pytest.raises(ValueError):
        timeseries.pivot_types(rows.unionByName(rows.limit(1)), ["a", "b"])


def test_windows_are_scored_from_their_common_start(spark):
    rows = hours(spark, "2024-01-01T00:00:00", 24 * 20, lambda i: float(i * 7 % 13)).withColumns({"p": F.lit(5.0), "r": F.col("price") - 5})
    cand = uncertainty.window_candidates(rows, "p", "r", [3, 8])
    first = {r.window_days: r.first_valid for r in uncertainty.common_start(cand, 2).collect()}
    assert first[3] == datetime(2024, 1, 1, 23) and first[8] == datetime(2024, 1, 2, 23)  # 1 and 2 days are needed
    found = {r.window_days: (r.n, r.n_warmup) for r in uncertainty.window_scores(cand).collect()}
    assert found == {3: (480 - 23, 23), 8: (480 - 47, 47)}
    common = uncertainty.window_scores(uncertainty.from_common_start(cand, 2))
    assert {r.n for r in common.collect()} == {480 - 47} and uncertainty.select_window(common).first().equal_n
    assert not uncertainty.select_window(uncertainty.window_scores(cand)).first().equal_n
    assert uncertainty.from_common_start(cand, 3).count() == 0


def test_sequences_are_compared_and_judged(spark):
    at = datetime(2024, 1, 1)
    one = spark.createDataFrame([(at, 1.0), (at + timedelta(hours=1), 2.0), (at + timedelta(hours=2), 3.0)], "timestamp_utc timestamp, price double")
    two = spark.createDataFrame([(at, 1.005), (at + timedelta(hours=1), 5.0), (at + timedelta(hours=3), 3.0)], "timestamp_utc timestamp, price double")
    got = documents.compare_sequences(one, two)
    assert by_time(got, "coverage", "disagrees") == [("both", False), ("both", True), ("seq1_only", False), ("seq2_only", False)]
    assert tuple(documents.sequence_coverage(got).first()) == (2, 1, 1, 1)
    with pytest.raises(ValueError):
        documents.compare_sequences(one.unionByName(one), two)
    told = lambda *n: documents.reference_verdict(spark.createDataFrame([(m,) for m, k in zip(("seq1", "seq2", "neither", "no_data"), n) for _ in range(k)], "match string")).first().verdict
    assert [told(96, 0, 4, 50), told(95, 0, 5, 0), told(0, 97, 3, 0), told(0, 0, 0, 9), told(50, 50, 0, 0)] == ["seq1", "mixed", "seq2", "nothing", "mixed"]


def test_sequence_fields_differ_or_are_ambiguous(spark):
    span = "<timeInterval><start>2024-01-01T00:00Z</start><end>{}</end></timeInterval>"
    series = lambda seq, mrid, res="PT15M", end="2024-01-02T00:00Z": f"<TimeSeries><mRID>{mrid}</mRID><curveType>A03</curveType><classificationSequence_AttributeInstanceComponent.position>{seq}</classificationSequence_AttributeInstanceComponent.position><Period>{span.format(end)}<resolution>{res}</resolution></Period></TimeSeries>"
    cases = {1: series(1, "a") + series(2, "b"), 2: series(1, "a") + series(2, "a"), 3: series(1, "a") + series(2, "b") + series(2, "c"), 4: series(1, "a") + series(2, "b", "PT60M"), 5: series(1, "a") + series(2, "b", end="2024-01-01T12:00Z") + series(3, "z")}
    table = spark.createDataFrame([(n, f'<Doc xmlns="urn:y">{x}</Doc>') for n, x in cases.items()], "n int, xml string")
    day = (F.to_timestamp(F.lit("2024-01-01 12:00:00")), F.to_timestamp(F.lit("2024-01-02 12:00:00")))
    got = {(r.n, r.path, r.text, r.n_a, r.n_b) for r in documents.sequence_diff(documents.paths(table, ["n"], day=day), ["n"]).collect()}
    assert got == {(1, "mRID", "a", 1, 0), (1, "mRID", "b", 0, 1), (3, None, None, 1, 2)}


def test_display_and_day_flags(spark):
    from tidemark.functions.columns import display

    r = spark.createDataFrame([(1234.5, 0.1234, 1200, None, float("nan"))], "a double, b double, c long, d double, e double").select(
        display(F.col("a"), "eur").alias("a"), display(F.col("b"), "percent").alias("b"), display(F.col("c"), "count").alias("c"), display(F.col("d"), "eur").alias("d"), display(F.col("e"), "percent").alias("e")).first()
    assert tuple(r) == ("EUR 1,234.50", "12.3%", "1,200", "N/A", "N/A")
    rows = hours(spark, "2024-01-01T00:00:00", 48, lambda i: {3: -1.0, 30: 201.0}.get(i, 100.0))
    flags = {str(f.delivery_date): (f.any_negative, f.any_above_200, f.any_above_500) for f in metrics.day_flags(rows).collect()}
    assert flags["2024-01-01"] == (True, False, False) and flags["2024-01-02"] == (False, True, False)


def test_backtest_reads_its_input_once(spark):
    from tidemark.plans import adapters

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(adapters.a7(spark, "/root/testdata/sf0.001")).count("Relation [") == 1
    rows = adapters.a5(spark, "/root/testdata/sf0.001")
    assert plan(uncertainty.window_candidates(rows, "pred_full", "residual", [5, 7, 10])).count("Relation [") == 1


def test_windows_in_buckets_equal_windows_over_the_series(spark):
    rows = timeseries.regularize(hours(spark, "2024-03-01T00:00:00", 24 * 60, lambda i: float(i * 37 % 101)).where("hour(timestamp_utc) <> 3 or day(timestamp_utc) % 4 <> 0"))
    f = lambda df: timeseries.rolling_stats(timeseries.safe_lag(df, "price", 24, "lag"), "lag", 168, "r")
    whole, cut = (by_time(x, "series_id", "timestamp_utc", "price", "lag", "r_mean", "r_std") for x in (f(rows), timeseries.in_buckets(rows, 14, 24 + 168, f)))
    assert len(whole) == len(cut) == 24 * 60
    for a, b in zip(whole, cut):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])
    with pytest.raises(ValueError):
        timeseries.in_buckets(rows, 1, 48, f)


def test_joins_by_time_and_day(spark):
    a, b = hours(spark, "2024-01-01T00:00:00", 5), hours(spark, "2024-01-01T02:00:00", 5, lambda i: 10.0 * i)
    both = joins.two_models(a, b, ("x", "y"), "price")
    assert by_time(both, "x", "y") == [(2.0, 0.0), (3.0, 10.0), (4.0, 20.0)]
    assert [(r.timestamp_utc.hour, r.side) for r in joins.one_sided(a.unionByName(a), b, ["timestamp_utc"]).orderBy("timestamp_utc").collect()] == [(0, "left"), (1, "left"), (5, "right"), (6, "right")]
    assert by_time(joins.only_in(a, b, ["timestamp_utc"]), "price") == [(0.0,), (1.0,)]
    assert by_time(joins.lag_join(a, "price", 2, "lag"), "lag") == [(None,), (None,), (0.0,), (1.0,), (2.0,)]
    days = {str(r.delivery_date): (r.n, r.total) for r in joins.trailing_days(hours(spark, "2024-01-01T23:00:00", 48), "price", 2).collect()}
    assert days == {"2024-01-03": (24, 276.0), "2024-01-04": (48, 1128.0), "2024-01-05": (24, 852.0)}
    cells = joins.with_cells(a.limit(1), [(0.8, 5.0), (0.9, 5.0)])
    assert sorted((r.eta, r.c) for r in cells.collect()) == [(0.8, 5.0), (0.9, 5.0)]
    with pytest.raises(ValueError):
        joins.with_cells(a, [(0.8, 5.0)] * 10_001)
    assert joins.distinct_days(hours(spark, "2024-01-01T22:00:00", 3)).first().n == 2
    table = spark.createDataFrame([("x", "p", 2.0), ("x", "o", 2.0), ("y", "q", 1.0), ("y", "a", 5.0)], "k string, l string, v double")
    assert sorted(map(tuple, joins.lowest(table, ["k"], "l", F.col("v")).collect())) == [("x", "o", 2.0), ("y", "q", 1.0)]


def test_cleaning_of_several_sources(spark):
    at = datetime(2024, 1, 1)
    table = lambda rows: spark.createDataFrame([(at + timedelta(minutes=m), n, v) for m, n, v in rows], "timestamp_utc timestamp, order long, value double")
    raw = {"price": table([(0, 1, 10.0), (60, 2, 20.0), (120, 3, 1.0), (135, 4, 3.0), (135, 5, 99.0), (240, 6, 5.0)]), "load": table([(0, 1, 4.0), (30, 2, 6.0), (120, 3, 8.0), (300, 4, 9.0)])}
    cut = F.to_timestamp(F.lit("2024-01-01 02:00:00"))
    got = timeseries.build_clean(raw, "price", cut, F.to_timestamp(F.lit("2024-01-01")), F.to_timestamp(F.lit("2024-01-01 05:00:00")), most=0.5)
    # prices pass as they are before the cutover and are hourly means after it; one row a time, the first in order
    assert by_time(got, "price", "load", "post", "hour_local") == [(10.0, 5.0, 0, 1), (20.0, None, 0, 2), (2.0, 8.0, 1, 3), (None, None, 1, 4), (5.0, None, 1, 5)]
    report = {r.dataset: tuple(r)[1:] for r in timeseries.cleaning_report(raw, got).collect()}
    assert report == {"price": (6, 5, 1, 4, 1), "load": (4, 4, 0, 2, 3)}
    with pytest.raises(ValueError):
        timeseries.build_clean(raw, "price", cut, cut, cut)


def test_artifacts_of_one_run_agree_or_differ(spark):
    day = datetime(2024, 1, 2).date()
    hourly = hours(spark, "2024-01-01T23:00:00", 24).withColumn("delivery_date", F.lit(day))
    days = spark.createDataFrame([("a", day, "S1", 24, 5.0), ("a", day, "S2", 24, 7.0)], "series_id string, delivery_date date, strategy string, n_hours int, net_pnl double")
    grid = spark.createDataFrame([("a", "S1", 5.0), ("a", "S2", 7.0)], "series_id string, strategy string, net_pnl double")
    assert checks.artifact_differences(hourly, days, grid).count() == 0
    off = grid.withColumn("net_pnl", F.col("net_pnl") + 1e-3)
    got = {(r.rule, r.n) for r in checks.artifact_differences(hourly.limit(23), days, off).collect()}
    assert got == {("n_hours", 1), ("totals", 2)}
    later = days.withColumn("delivery_date", F.date_add("delivery_date", 1))
    assert {(r.rule, r.n) for r in checks.artifact_differences(hourly, later, grid).collect()} == {("days", 2)}


def test_splits_by_flags_and_frontier_use_market_days(spark):
    rows = [("a", d, s, s != "S0", None, None, p) for d, per in ((1, {"S0": 0.0, "S1": 1.0, "S2": 4.0}), (2, {"S0": 0.0, "S1": 2.0, "S2": 1.0})) for s, p in per.items()]
    days = results(spark, rows)
    flags = spark.createDataFrame([("a", datetime(2024, 1, 1).date(), True)], "series_id string, delivery_date date, any_negative boolean")
    table = reports.split_by_flags(reports.with_day_flags(days, flags, "2024-01-02"), ["any_negative", "post"])
    got = {(r.flag, r.is_set): (r.n_days, r.delta_S2_S1) for r in table.collect()}
    assert got == {("any_negative", True): (1, 3.0), ("any_negative", False): (1, -1.0), ("post", False): (1, 3.0), ("post", True): (1, -1.0)}



def test_hourly_quantiles_leave_out_what_is_not_finite(spark):
    """One NaN and one infinite residual of 24: 22 are fewer than a day has, and 23 of 25 too; 24 finite ones are enough."""
    at = datetime(2024, 1, 1)
    value = lambda h: float("nan") if h == 3 else float("inf") if h == 7 else float(h)
    rows = spark.createDataFrame([("a", at + timedelta(hours=h), value(h)) for h in range(40)], "series_id string, timestamp_utc timestamp, r double")
    got = {r.timestamp_utc: (r.q10, r.q90) for r in uncertainty.hourly_quantiles(rows, "r", 1, 1).collect()}
    assert all(got[at + timedelta(hours=h)] == (None, None) for h in range(32))
    np.testing.assert_allclose(got[at + timedelta(hours=32)], np.quantile(np.arange(8.0, 32), [0.1, 0.9]))
