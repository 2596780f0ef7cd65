"""Views over the driver's tables that stand for the library's inputs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import local_date
from tidemark.operators import decisions, timeseries, uncertainty
from tidemark.sources.tables import read_table

WINDOW_DAYS, LEAST_DAYS, ETA, C = 7, 1, 0.85, 10.0
RULES = {
    "S1": ("pred_full", "pred_full"), "S2": ("pred_alt", "pred_alt"), "S3": ("(pred_full + pred_alt) / 2", "(pred_full + pred_alt) / 2"),
    "S4": ("L", "U"), "S5": ("(L + pred_alt) / 2", "(U + pred_alt) / 2"),
}
REQUIRED = ["price", "pred_full", "pred_alt", "L", "U"]


def events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def a1(spark: SparkSession, d: str, minutes: int = 60) -> DataFrame:
    s = minutes * 60
    at = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / s) * s)
    return events(spark, d).groupBy(F.col("event_type").alias("series_id"), at.alias("timestamp_utc")).agg(F.round(F.avg("value") - 40, 6).alias("price"))


def a2(spark: SparkSession, d: str) -> DataFrame:
    cut = F.to_timestamp(F.lit("2024-01-14 23:00:00"))
    return a1(spark, d, 15).withColumn("resolution_min", F.when(F.col("timestamp_utc") < cut, 60).otherwise(15))


def a2_both(spark: SparkSession, d: str) -> DataFrame:
    """Hours and quarter-hours side by side over the whole time, as where two products are published."""
    return a1(spark, d).withColumn("resolution_min", F.lit(60)).unionByName(a1(spark, d, 15).withColumn("resolution_min", F.lit(15)))


def typed(spark: SparkSession, d: str) -> DataFrame:
    """``timestamp_utc, type, value``: hourly means of each event type."""
    at = F.date_trunc("hour", "ts").alias("timestamp_utc")
    return events(spark, d).groupBy(at, F.col("event_type").alias("type")).agg(F.round(F.avg("value"), 6).alias("value"))


#: Event types as the columns of the three sources.
TYPES = {"purchase": "price", "view": "load_mw", "click": "wind_on_mw", "signup": "wind_off_mw", "error": "solar_mw"}


def a3(spark: SparkSession, d: str) -> DataFrame:
    wide = events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("timestamp_utc")).pivot("event_type", list(TYPES)).agg(F.round(F.avg("value"), 6))
    return wide.withColumnsRenamed(TYPES)


def a4(spark: SparkSession, d: str) -> DataFrame:
    ends = read_table(spark, d, "orders").agg(F.min("o_orderdate").cast("timestamp").alias("lo"), F.max("o_orderdate").cast("timestamp").alias("hi"))
    return ends.select(F.lit("orders").alias("series_id"), F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("timestamp_utc"))


def a5(spark: SparkSession, d: str) -> DataFrame:
    """One pass: all of it is windows over the series."""
    filled = timeseries.carry_forward(timeseries.regularize(a1(spark, d)), "price")
    lagged = timeseries.safe_lag(filled, "price", 24, "pred_full")
    rolled = timeseries.rolling_stats(lagged, "pred_full", 24, "r").withColumnRenamed("r_mean", "pred_alt").drop("r_std")
    week = F.floor(F.datediff(local_date(F.col("timestamp_utc")), F.lit("2024-01-01")) / 7) + 1
    rows = rolled.withColumns({"residual": F.col("price") - F.col("pred_full"), "fold": F.when(week.between(2, 4), week.cast("int"))})
    return uncertainty.with_day_safe_bounds(rows, "pred_full", "residual", WINDOW_DAYS, LEAST_DAYS)


def a6(spark: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 900) * 900)
    odd = F.col("event_id") % 2 == 1
    return events(spark, d).groupBy(at.alias("timestamp_utc")).agg(
        F.round(F.avg(F.when(odd, F.col("value"))), 6).alias("price_seq1"), F.round(F.avg(F.when(~odd, F.col("value"))), 6).alias("price_seq2"),
        F.max_by("value", "event_id").alias("price_ref"),
    )


def complete(spark: SparkSession, d: str) -> DataFrame:
    return decisions.on_common_days(a5(spark, d), REQUIRED)


def a7(spark: SparkSession, d: str, cells: list[tuple[float, float]] | None = None) -> DataFrame:
    return decisions.backtest(complete(spark, d), RULES, cells or [(ETA, C)])


def broken(days: DataFrame) -> DataFrame:
    """Per-day results as a damaged file has them, flags and pairs as text: by the day of the month and the strategy,
    repeated days, missing days and pairs, pairs out of order and out of bounds, fractions, words and infinite
    results."""
    day, text = F.dayofmonth("delivery_date"), {c: F.col(c).cast("string") for c in ("traded", "i", "j")}
    of = lambda s, n: (F.col("strategy") == s) & (day % 7 == n)
    out = days.withColumns({
        "traded": F.when(of("S1", 1), "perhaps").otherwise(text["traded"]),
        "i": F.when(of("S1", 2), F.lit(None)).when(of("S2", 1), F.lit("2.5")).when(of("S2", 2), F.lit("x")).when(of("S2", 3), F.lit("30")).when(of("S0", 1), F.lit("3")).otherwise(text["i"]),
        "j": F.when(of("S3", 1), F.lit("99")).otherwise(text["j"]),
        "net_pnl": F.when(of("S3", 2), F.lit(float("inf"))).when(of("S0", 2), F.lit(5.0)).when(of("S4", 1), F.col("oracle_pnl") + 1).otherwise(F.col("net_pnl")),
        "n_hours": F.when(of("S4", 2), 22).otherwise(F.col("n_hours")), "delivery_date": F.when(of("S5", 1), F.lit(None).cast("date")).otherwise(F.col("delivery_date")),
    })
    return out.unionByName(out.where(of("S5", 2)))


_LOCAL = "AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin'"


def berlin(c: str) -> str:
    return f"({c} {_LOCAL})"


A1 = "a1 AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS t, round(avg(value) - 40, 6) AS price FROM events GROUP BY ALL)"
REG = f"""{A1},
grid AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS t FROM (SELECT series_id, min(t) AS lo, max(t) AS hi FROM a1 GROUP BY series_id)),
reg AS (SELECT g.series_id, g.t, a1.price FROM grid g LEFT JOIN a1 ON a1.series_id = g.series_id AND a1.t = g.t)"""
A3 = """a3 AS (SELECT date_trunc('hour', ts) AS t, round(avg(value) FILTER (event_type = 'purchase'), 6) AS price, round(avg(value) FILTER (event_type = 'view'), 6) AS load_mw,
  round(avg(value) FILTER (event_type = 'click'), 6) AS wind_on_mw, round(avg(value) FILTER (event_type = 'signup'), 6) AS wind_off_mw, round(avg(value) FILTER (event_type = 'error'), 6) AS solar_mw
  FROM events GROUP BY 1)"""
A4 = "a4 AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS t FROM (SELECT min(o_orderdate)::TIMESTAMP AS lo, max(o_orderdate)::TIMESTAMP AS hi FROM orders))"
A5 = f"""{REG},
filled AS (SELECT series_id, t, last_value(price IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS price FROM reg),
lagged AS (SELECT f.series_id, f.t, f.price, CASE WHEN {berlin('(f.t - INTERVAL 24 HOUR)')}::DATE < {berlin('f.t')}::DATE THEN p.price END AS pred_full, {berlin('f.t')}::DATE AS d FROM filled f LEFT JOIN filled p ON p.series_id = f.series_id AND p.t + INTERVAL 24 HOUR = f.t),
rolled AS (SELECT *, CASE WHEN {berlin('(t - INTERVAL 24 HOUR)')}::DATE < d AND count(pred_full) OVER w >= 19 THEN avg(pred_full) OVER w END AS pred_alt, price - pred_full AS residual,
  CASE WHEN (d - DATE '2024-01-01') // 7 + 1 BETWEEN 2 AND 4 THEN (d - DATE '2024-01-01') // 7 + 1 END AS fold
  FROM lagged WINDOW w AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)),
sent AS (SELECT series_id, d, residual AS r, unnest(generate_series(1, 7)) AS k FROM rolled WHERE isfinite(residual)),
q AS (SELECT series_id, (d + k::INT)::DATE AS d, quantile_cont(r, 0.1) AS q10, quantile_cont(r, 0.5) AS q50, quantile_cont(r, 0.9) AS q90 FROM sent GROUP BY 1, 2),
a5 AS (SELECT r.*, q10, q50, q90, pred_full + q10 AS l, pred_full + q90 AS u FROM rolled r LEFT JOIN q ON q.series_id = r.series_id AND q.d = r.d)"""
#: Quantiles of the other model's residuals, by day.
QA = """sa AS (SELECT series_id, d, price - pred_alt AS r, unnest(generate_series(1, 7)) AS k FROM rolled WHERE isfinite(price - pred_alt)),
qa AS (SELECT series_id, (d + k::INT)::DATE AS d, quantile_cont(r, 0.1) AS a10, quantile_cont(r, 0.9) AS a90 FROM sa GROUP BY 1, 2)"""
#: The damage of broken() in SQL, over a7.
BROKEN = """bk AS (SELECT series_id, CASE WHEN strategy = 'S5' AND day(d) % 7 = 1 THEN NULL ELSE d END AS d, strategy,
  CASE WHEN strategy = 'S1' AND day(d) % 7 = 1 THEN 'perhaps' ELSE traded::VARCHAR END AS traded,
  CASE WHEN strategy = 'S1' AND day(d) % 7 = 2 THEN NULL WHEN strategy = 'S2' AND day(d) % 7 = 1 THEN '2.5' WHEN strategy = 'S2' AND day(d) % 7 = 2 THEN 'x' WHEN strategy = 'S2' AND day(d) % 7 = 3 THEN '30' WHEN strategy = 'S0' AND day(d) % 7 = 1 THEN '3' ELSE i::VARCHAR END AS i,
  CASE WHEN strategy = 'S3' AND day(d) % 7 = 1 THEN '99' ELSE j::VARCHAR END AS j,
  CASE WHEN strategy = 'S3' AND day(d) % 7 = 2 THEN 'inf'::DOUBLE WHEN strategy = 'S0' AND day(d) % 7 = 2 THEN 5 WHEN strategy = 'S4' AND day(d) % 7 = 1 THEN oracle_pnl + 1 ELSE net_pnl END AS net_pnl,
  CASE WHEN strategy = 'S4' AND day(d) % 7 = 2 THEN 22 ELSE n_hours END AS n_hours, oracle_pnl, strategy = 'S5' AND day(d) % 7 = 2 AS again FROM a7),
br AS (SELECT * FROM bk UNION ALL SELECT * FROM bk WHERE again)"""
A6 = """a6 AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS t, round(avg(value) FILTER (event_id % 2 = 1), 6) AS price_seq1, round(avg(value) FILTER (event_id % 2 = 0), 6) AS price_seq2,
  arg_max(value, event_id) AS price_ref FROM events GROUP BY 1)"""
A7 = f"""{A5},
days AS (SELECT series_id, d, count(*) AS n_hours FROM a5 GROUP BY ALL HAVING bool_and(price IS NOT NULL AND pred_full IS NOT NULL AND pred_alt IS NOT NULL AND l IS NOT NULL AND u IS NOT NULL)),
placed AS (SELECT a5.*, n_hours, row_number() OVER (PARTITION BY a5.series_id, a5.d ORDER BY t) - 1 AS pos FROM a5 JOIN days ON days.series_id = a5.series_id AND days.d = a5.d),
long AS (
  SELECT series_id, d, n_hours, pos, price, 'S1' AS strategy, pred_full AS bid, pred_full AS ask FROM placed
  UNION ALL SELECT series_id, d, n_hours, pos, price, 'S2', pred_alt, pred_alt FROM placed
  UNION ALL SELECT series_id, d, n_hours, pos, price, 'S3', (pred_full + pred_alt) / 2, (pred_full + pred_alt) / 2 FROM placed
  UNION ALL SELECT series_id, d, n_hours, pos, price, 'S4', l, u FROM placed
  UNION ALL SELECT series_id, d, n_hours, pos, price, 'S5', (l + pred_alt) / 2, (u + pred_alt) / 2 FROM placed
  UNION ALL SELECT series_id, d, n_hours, pos, price, 'oracle', price, price FROM placed),
cells AS (SELECT * FROM (VALUES @CELLS@) c(eta, c)),
pairs AS (SELECT a.series_id, a.d, a.strategy, eta, c, a.n_hours, a.pos AS i, b.pos AS j, a.price AS p_i, b.price AS p_j, eta * b.bid - a.ask - c * (1 + eta) AS score
  FROM long a JOIN long b ON a.series_id = b.series_id AND a.d = b.d AND a.strategy = b.strategy AND a.pos < b.pos CROSS JOIN cells),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, d, strategy, eta, c ORDER BY score DESC, i, j) AS rn FROM pairs) WHERE rn = 1),
done AS (SELECT series_id, d, n_hours, strategy, eta, c, score > 0 AS traded, CASE WHEN score > 0 THEN score END AS score, CASE WHEN score > 0 THEN i END AS i, CASE WHEN score > 0 THEN j END AS j,
  CASE WHEN score > 0 THEN eta * p_j - p_i ELSE 0 END AS gross_pnl, CASE WHEN score > 0 THEN eta * p_j - p_i - c * (1 + eta) ELSE 0 END AS net_pnl FROM best),
a7 AS (SELECT x.*, o.net_pnl AS oracle_pnl FROM (
    SELECT * FROM done WHERE strategy <> 'oracle'
    UNION ALL SELECT series_id, d, n_hours, 'S0', eta, c, false, NULL, NULL, NULL, 0, 0 FROM done WHERE strategy = 'oracle') x
  JOIN done o ON o.strategy = 'oracle' AND o.series_id = x.series_id AND o.d = x.d AND o.eta = x.eta AND o.c = x.c)"""


def a7_sql(cells: list[tuple[float, float]] | None = None) -> str:
    return A7.replace("@CELLS@", ", ".join(f"({e}::DOUBLE, {c}::DOUBLE)" for e, c in cells or [(ETA, C)]))
