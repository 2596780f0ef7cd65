"""Registered queries: each applies operators to the driver's tables, with SQL that gives the same rows.

A query's column list ("name:kind ...") fixes how both sides are written out: t timestamp and d date as
text, f number rounded to 4 places, i whole number, b flag as 0 or 1, s text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.operators import checks, decisions, forecast, joins, metrics, reports, splits, timeseries, uncertainty
from tidemark.operators import documents as docs
from tidemark.sources.tables import read_contract, read_table, saved

from . import adapters as ad

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_SPECS: dict[str, str] = {}
KEY = "series_id:s timestamp_utc:t"
ROWS = ["series_id", "timestamp_utc"]
#: Added before rounding, so that a number halfway between two results rounds up in both engines.
NUDGE = 1.2345e-9


def _spark_out(c: str, kind: str):
    x = F.col(c)
    return {
        "t": F.date_format(x, "yyyy-MM-dd HH:mm:ss") if kind == "t" else None, "d": F.date_format(x, "yyyy-MM-dd") if kind == "d" else None,
        "f": F.round(x.cast("double") + NUDGE, 4) + F.lit(0.0), "i": x.cast("long"), "b": x.cast("boolean").cast("long"), "s": x.cast("string"),
    }[kind].alias(c)


def _sql_out(c: str, kind: str) -> str:
    q = f'"{c}"'
    return {
        "t": f"strftime({q}, '%Y-%m-%d %H:%M:%S')", "d": f"strftime({q}, '%Y-%m-%d')", "f": f"round(CAST({q} AS DOUBLE) + {NUDGE}, 4) + 0.0",
        "i": f"CAST({q} AS BIGINT)", "b": f"CAST(CAST({q} AS BOOLEAN) AS BIGINT)", "s": f"CAST({q} AS VARCHAR)",
    }[kind] + f" AS {q}"


def register(name: str, spec: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """``sql``: "CTEs ;; SELECT", the CTEs without WITH."""
    kinds = [x.split(":") for x in spec.split()]
    _SPECS[name] = spec
    _QUERIES[name] = lambda spark, d: run(spark, d).select(*[_spark_out(c, k) for c, k in kinds])
    if sql:
        ctes, _, body = sql.rpartition(";;")
        _SQL[name] = (f"WITH {ctes.strip()} " if ctes.strip() else "") + f"SELECT {', '.join(_sql_out(c, k) for c, k in kinds)} FROM ({body.strip()}) last_step"


def register_like(name: str, other: str, run: Callable[[SparkSession, str], DataFrame], instead: dict[str, str] | None = None) -> None:
    """Another way to the rows of a registered query, held against the same SQL, or against that with parts of it replaced."""
    register(name, _SPECS[other], run)
    _SQL[name] = _SQL[other]
    for old, new in (instead or {}).items():
        if old not in _SQL[name]:
            raise ValueError(f"{name}: nothing to replace")
        _SQL[name] = _SQL[name].replace(old, new)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["st_backtest"](spark, sf_dir)


ts = lambda s: F.to_timestamp(F.lit(s))
B = ad.berlin

#: fn.draw() in SQL, for an expression of the columns' texts.
DRAW = lambda text: f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
_SECOND = "series_id || '/' || strftime(t, '%Y-%m-%d %H:%M:%S') || '/42'"

# --- sources, cleaning, time ------------------------------------------------------------------------
register("src_parquet_contract", "o_orderkey:i o_orderdate:d o_totalprice:f", lambda s, d: read_contract(s, f"{d}/orders.parquet", ["o_orderkey", "o_orderdate", "o_totalprice"]),
         "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
register("cln_dedupe", "series_id:s timestamp_utc:t event_id:i value:f",
         lambda s, d: timeseries.dedupe(saved(timeseries.one_of_copies(ad.events(s, d).select(F.col("event_type").alias("series_id"), F.date_trunc("second", "ts").alias("timestamp_utc"), "event_id", "value"), "event_id")), ROWS, [F.col("event_id")]),
         "SELECT event_type AS series_id, date_trunc('second', ts) AS timestamp_utc, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
register("aud_duplicate_split", "grouping_key:s level:i n_keys:i n_rows:i n_identical:i n_different:i",
         lambda s, d: docs.duplicate_split(docs.duplicate_profile(ad.events(s, d).select(F.col("event_type").alias("series_id"), F.date_trunc("minute", "ts").alias("timestamp_utc"), "value"), ROWS, "value")),
         """p AS (SELECT event_type, date_trunc('minute', ts) AS t, count(*) AS n, count(DISTINCT value) <= 1 AS same FROM events GROUP BY 1, 2 HAVING count(*) > 1),
u AS (SELECT 'overall' AS grouping_key, NULL::INT AS level, n, same FROM p UNION ALL SELECT 'year', year(t), n, same FROM p UNION ALL SELECT 'minute', minute(t), n, same FROM p)
;; SELECT grouping_key, level, count(*) AS n_keys, sum(n) AS n_rows, count(*) FILTER (same) AS n_identical, count(*) FILTER (NOT same) AS n_different FROM u GROUP BY 1, 2""")
register("aud_duplicate_profile", "series_id:s timestamp_utc:t n:i n_values:i lo:f hi:f identical:b",
         lambda s, d: docs.duplicate_profile(ad.events(s, d).select(F.col("event_type").alias("series_id"), F.date_trunc("minute", "ts").alias("timestamp_utc"), "value"), ROWS, "value"),
         "SELECT event_type AS series_id, date_trunc('minute', ts) AS timestamp_utc, count(*) AS n, count(DISTINCT value) AS n_values, min(value) AS lo, "
         "max(value) AS hi, count(DISTINCT value) <= 1 AS identical FROM events GROUP BY 1, 2 HAVING count(*) > 1")
register("chk_unique_key", "series_id:s timestamp_utc:t n:i",
         lambda s, d: checks.duplicate_keys(ad.events(s, d).select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("timestamp_utc")), ROWS),
         "SELECT event_type AS series_id, date_trunc('hour', ts) AS timestamp_utc, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
register("cln_duplicate_fraction", "n_rows:i n_keys:i duplicate_fraction:f too_many:b",
         lambda s, d: timeseries.duplicate_fraction(ad.events(s, d).select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("timestamp_utc")), ROWS),
         "SELECT sum(n) AS n_rows, count(*) AS n_keys, 1 - count(*) / sum(n) AS duplicate_fraction, 1 - count(*) / sum(n) > 0.01 AS too_many FROM (SELECT count(*) AS n "
         "FROM events GROUP BY event_type, date_trunc('hour', ts))")
register("cln_resample_hourly", f"{KEY} value:f user_id:i",
         lambda s, d: timeseries.resample_hourly(ad.events(s, d).groupBy(F.col("event_type").alias("series_id"), F.col("ts").alias("timestamp_utc")).agg(F.avg("value").alias("value"), F.min("user_id").alias("user_id")), "value", ("user_id",)),
         """e AS (SELECT event_type AS series_id, ts, avg(value) AS value, min(user_id) AS user_id FROM events GROUP BY 1, 2),
h AS (SELECT series_id, date_trunc('hour', ts) AS t, avg(value) AS value, arg_min(user_id, ts) AS user_id FROM e GROUP BY 1, 2),
g AS (SELECT series_id, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM h GROUP BY 1)
;; SELECT g.series_id, g.t AS timestamp_utc, value, user_id FROM g LEFT JOIN h ON h.series_id = g.series_id AND h.t = g.t""")
register("cln_resample_after_cutover", f"{KEY} price:f", lambda s, d: timeseries.resample_after(ad.a2(s, d), "price", ts("2024-01-14 23:00:00")),
         """a2 AS (SELECT event_type AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS t, round(avg(value) - 40, 6) AS price FROM events GROUP BY 1, 2),
h AS (SELECT series_id, date_trunc('hour', t) AS t, avg(price) AS price FROM a2 WHERE t >= TIMESTAMP '2024-01-14 23:00:00' GROUP BY 1, 2),
g AS (SELECT series_id, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM h GROUP BY 1)
;; SELECT series_id, t AS timestamp_utc, price FROM a2 WHERE t < TIMESTAMP '2024-01-14 23:00:00' UNION ALL SELECT g.series_id, g.t, price FROM g LEFT JOIN h ON h.series_id = g.series_id AND h.t = g.t""")
register("sel_resolution", f"{KEY} price:f resolution_min:i", lambda s, d: docs.select_resolution(ad.a2_both(s, d), ts("2024-01-14 23:00:00")),
         """bo AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS t, round(avg(value) - 40, 6) AS price, 60 AS r FROM events GROUP BY 1, 2
  UNION ALL SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts), round(avg(value) - 40, 6), 15 FROM events GROUP BY 1, 2)
;; SELECT series_id, t AS timestamp_utc, price, r AS resolution_min FROM bo WHERE (t < TIMESTAMP '2024-01-14 23:00:00' AND r = 60) OR (t >= TIMESTAMP '2024-01-14 23:00:00' AND r = 15)""")
register("cln_regime_flag", f"{KEY} post:i", lambda s, d: timeseries.regime_flag(ad.a1(s, d), ts("2024-01-14 23:00:00")),
         f"{ad.A1} ;; SELECT series_id, t AS timestamp_utc, (t >= TIMESTAMP '2024-01-14 23:00:00')::INT AS post FROM a1")
_LOCAL_SPEC = f"{KEY} delivery_timestamp_local:t delivery_date:d hour_local:i dow_local:i month_local:i weekend:i"
_LOCAL_SQL = "series_id, t AS timestamp_utc, lt AS delivery_timestamp_local, lt::DATE AS delivery_date, hour(lt) AS hour_local, isodow(lt) - 1 AS dow_local, month(lt) AS month_local, (isodow(lt) >= 6)::INT AS weekend"
register("cln_local_time", _LOCAL_SPEC, lambda s, d: timeseries.add_local_columns(ad.a4(s, d)), f"{ad.A4} ;; SELECT {_LOCAL_SQL} FROM (SELECT 'orders' AS series_id, t, "
    f"{B('t')} AS lt FROM a4)")
register("ts_dst_days", "delivery_date:d offsets:i hours:i", lambda s, d: timeseries.dst_days(ad.a4(s, d)),
         f"{ad.A4} ;; SELECT {B('t')}::DATE AS delivery_date, count(DISTINCT epoch({B('t')}) - epoch(t)) AS offsets, count(DISTINCT t) AS hours FROM a4 "
         f"GROUP BY 1 HAVING offsets > 1")
register("ts_decision_cutoff", "delivery_date:d cutoff:t start_utc:t",
         lambda s, d: ad.a4(s, d).select(fn.local_date(F.col("timestamp_utc")).alias("delivery_date")).distinct().withColumns({"cutoff": fn.decision_cutoff(F.col("delivery_date")), "start_utc": fn.local_midnight(F.col("delivery_date"))}),
         f"{ad.A4} ;; SELECT d AS delivery_date, ((d - INTERVAL 1 DAY + INTERVAL '11:45' HOUR TO MINUTE) AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' AS cutoff, "
         f"(d::TIMESTAMP AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' AS start_utc FROM (SELECT DISTINCT {B('t')}::DATE AS d "
         f"FROM a4)".replace("INTERVAL '11:45' HOUR TO MINUTE", "INTERVAL 705 MINUTE"))
register("ts_date_range", "first_day:d start_utc:t end_utc:t",
         lambda s, d: ad.a4(s, d).agg(F.min("timestamp_utc").alias("lo"), F.max("timestamp_utc").alias("hi")).select(fn.local_date(F.col("lo")).alias("first_day"), fn.local_midnight(fn.local_date(F.col("lo"))).alias("start_utc"), fn.local_midnight(F.trunc(fn.local_date(F.col("hi")), "month")).alias("end_utc")),
         f"{ad.A4} ;; SELECT lo::DATE AS first_day, (lo::DATE::TIMESTAMP AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' AS start_utc, (date_trunc('month', "
         f"hi)::TIMESTAMP AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' AS end_utc FROM (SELECT {B('min(t)')} AS lo, {B('max(t)')} AS hi FROM a4)")
register("ts_chunk_windows", "chunk_start:t chunk_end:t", lambda s, d: timeseries.chunk_windows(ad.a4(s, d).agg(F.min("timestamp_utc").alias("start"), F.max("timestamp_utc").alias("end")), 365),
         f"{ad.A4} ;; SELECT x AS chunk_start, least(x + INTERVAL 365 DAY, hi) AS chunk_end FROM (SELECT hi, unnest(generate_series(lo, hi - INTERVAL 1 SECOND, "
         f"INTERVAL 365 DAY)) AS x FROM (SELECT min(t) AS lo, max(t) AS hi FROM a4))")
register("ts_interval_position", f"{KEY} position:i", lambda s, d: timeseries.interval_position(ad.a2(s, d)),
         f"SELECT event_type AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS timestamp_utc, "
         f"(epoch({B('time_bucket(INTERVAL 15 MINUTE, ts)')}) - epoch({B('time_bucket(INTERVAL 15 MINUTE, ts)')}::DATE::TIMESTAMP)) / 900 + 1 AS position FROM events "
         f"GROUP BY ALL")
register("ts_regularize_grid", f"{KEY} price:f", lambda s, d: timeseries.regularize(ad.a1(s, d)), f"{ad.REG} ;; SELECT series_id, t AS timestamp_utc, price FROM reg")
register("cln_coverage_gaps", KEY, lambda s, d: timeseries.coverage_gaps(ad.a1(s, d), ts("2024-01-01"), ts("2024-01-31")),
         f"{ad.A1}, h AS (SELECT DISTINCT series_id, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS t FROM a1) "
         f";; SELECT series_id, t AS timestamp_utc FROM h EXCEPT SELECT series_id, t FROM a1")
register("cln_clip_range", f"{KEY} price:f", lambda s, d: timeseries.clip_range(ad.a1(s, d), ts("2024-01-05"), ts("2024-01-20")),
         f"{ad.A1} ;; SELECT series_id, t AS timestamp_utc, price FROM a1 WHERE t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-20'")
register("prj_pivot_types", "timestamp_utc:t price:f load_mw:f wind_on_mw:f wind_off_mw:f solar_mw:f", lambda s, d: timeseries.pivot_types(ad.typed(s, d), list(ad.TYPES)).withColumnsRenamed(ad.TYPES), f"{ad.A3} "
    f";; SELECT t AS timestamp_utc, price, load_mw, wind_on_mw, wind_off_mw, solar_mw FROM a3")


def _outer_merge(s: SparkSession, d: str) -> DataFrame:
    rows = ad.a1(s, d)
    return timeseries.outer_merge({n: rows.where(F.col("series_id") == t) for t, n in (("purchase", "p"), ("view", "l"), ("click", "w"))})


register("cln_outer_merge", "timestamp_utc:t p:f l:f w:f", _outer_merge,
         f"{ad.A1}, p AS (SELECT t, price AS p FROM a1 WHERE series_id = 'purchase'), l AS (SELECT t, price AS l FROM a1 WHERE series_id = 'view'), w AS (SELECT t, "
         f"price AS w FROM a1 WHERE series_id = 'click') ;; SELECT t AS timestamp_utc, p, l, w FROM p FULL JOIN l USING (t) FULL JOIN w USING (t)")
register("set_distinct_days", "series_id:s n:i", lambda s, d: joins.distinct_days(ad.a1(s, d)),
         f"{ad.A1} ;; SELECT series_id, count(DISTINCT {B('t')}::DATE) AS n FROM a1 GROUP BY 1")

# --- features ---------------------------------------------------------------------------------------
register("fn_fundamentals", "timestamp_utc:t wind_total:f solar_filled:f residual_load:f renewable_share:f", lambda s, d: timeseries.fundamentals(ad.a3(s, d)),
         f"{ad.A3} ;; SELECT t AS timestamp_utc, wind_on_mw + wind_off_mw AS wind_total, coalesce(solar_mw, 0) AS solar_filled, "
         f"load_mw - (wind_on_mw + wind_off_mw) - coalesce(solar_mw, 0) AS residual_load, CASE WHEN load_mw > 0 THEN (wind_on_mw + wind_off_mw + coalesce(solar_mw, "
         f"0)) / load_mw END AS renewable_share FROM a3")
_TERMS = [f"{n}_{f}" for n in ("hour", "dow", "month", "weekend_hour") for f in ("sin", "cos")]
register("fn_cyclic", f"{KEY} " + " ".join(f"{n}:f" for n in _TERMS), lambda s, d: timeseries.calendar_terms(timeseries.add_local_columns(ad.a4(s, d))),
         f"{ad.A4}, l AS (SELECT t, hour({B('t')}) AS h, isodow({B('t')}) - 1 AS w, month({B('t')}) AS m FROM a4) ;; SELECT 'orders' AS series_id, t AS timestamp_utc, "
         + ", ".join(f"{f}(2 * pi() * {v} / {p}) AS {n}_{f}" for n, v, p in (("hour", "h", 24), ("dow", "w", 7), ("month", "m", 12)) for f in ("sin", "cos"))
         + ", " + ", ".join(f"(w >= 5)::INT * {f}(2 * pi() * h / 24) AS weekend_hour_{f}" for f in ("sin", "cos")) + " FROM l")
register("fn_conditional_bucket", f"{KEY} negative:b above_200:b above_500:b", lambda s, d: ad.a1(s, d).withColumns(fn.buckets(F.col("price"))),
         f"{ad.A1} ;; SELECT series_id, t AS timestamp_utc, price < 0 AS negative, price > 200 AS above_200, price > 500 AS above_500 FROM a1")
for _h in (24, 48):
    register("win_safe_lag" if _h == 24 else f"win_safe_lag_{_h}", f"{KEY} price:f lagged:f", lambda s, d, h=_h: timeseries.safe_lag(timeseries.regularize(ad.a1(s, d)), "price", h, "lagged"),
             f"{ad.REG} ;; SELECT r.series_id, r.t AS timestamp_utc, r.price, "
             f"CASE WHEN {B(f'(r.t - INTERVAL {_h} HOUR)')}::DATE < {B('r.t')}::DATE THEN p.price END AS lagged FROM reg r LEFT JOIN reg p ON p.series_id = r.series_id "
             f"AND p.t + INTERVAL {_h} HOUR = r.t")
register("win_rolling_mean_std", f"{KEY} roll_mean:f roll_std:f",
         lambda s, d: timeseries.rolling_stats(timeseries.safe_lag(timeseries.regularize(ad.a1(s, d)), "price", 24, "lagged"), "lagged", 24, "roll"),
         f"{ad.REG}, lg AS (SELECT r.series_id, r.t, {B('(r.t - INTERVAL 24 HOUR)')}::DATE < {B('r.t')}::DATE AS safe, "
         f"CASE WHEN {B('(r.t - INTERVAL 24 HOUR)')}::DATE < {B('r.t')}::DATE THEN p.price END AS lagged FROM reg r LEFT JOIN reg p ON p.series_id = r.series_id "
         f"AND p.t + INTERVAL 24 HOUR = r.t) ;; SELECT series_id, t AS timestamp_utc, CASE WHEN safe AND count(lagged) OVER w >= 19 THEN avg(lagged) "
         f"OVER w END AS roll_mean, CASE WHEN safe AND count(lagged) OVER w >= 19 THEN stddev_samp(lagged) OVER w END AS roll_std FROM lg WINDOW w "
         f"AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)")
register("win_ffill", f"{KEY} price:f", lambda s, d: timeseries.carry_forward(timeseries.regularize(ad.a1(s, d)), "price"),
         f"{ad.REG} ;; SELECT series_id, t AS timestamp_utc, last_value(price IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS price FROM reg")
register("chk_information_set", "column:s violations:i", lambda s, d: timeseries.information_set_violations(timeseries.safe_lag(timeseries.regularize(ad.a1(s, d)), "price", 24, "lag_24"), {"lag_24": 24, "price": 0}),
         f"{ad.REG} ;; SELECT 'lag_24' AS \"column\", 0 AS violations UNION ALL SELECT 'price', count(price) FROM reg")

# --- splits -----------------------------------------------------------------------------------------
_FOLDS = [("f1", "2024-01-01", "2024-01-08", "2024-01-08", "2024-01-15"), ("f2", "2024-01-01", "2024-01-15", "2024-01-15", "2024-01-22"), ("f3", "2024-01-01", "2024-01-22", "2024-01-22", "2024-01-29")]
_FOLD_SQL = "folds AS (SELECT n AS fold, a::TIMESTAMP AS a, b::TIMESTAMP AS b, c::TIMESTAMP AS c, e::TIMESTAMP AS e FROM (VALUES " + ", ".join(str(f) for f in _FOLDS) + ") v(n, a, b, c, e))"
register("spl_fold_assign", "fold:s role:s series_id:s n:i price:f", lambda s, d: splits.assign(ad.a1(s, d), splits.fold_table(s, _FOLDS)).groupBy("fold", "role", "series_id").agg(F.count("*").alias("n"), F.sum("price").alias("price")),
         f"{ad.A1}, {_FOLD_SQL} ;; SELECT fold, CASE WHEN t < b THEN 'train' ELSE 'val' END AS role, series_id, count(*) AS n, sum(price) AS price FROM a1 "
         f"JOIN folds ON (t >= a AND t < b) OR (t >= c AND t < e) GROUP BY ALL")
register("spl_day_aligned_cv", "series_id:s fold:i test_start:d test_end:d train_days:i test_days:i", lambda s, d: splits.day_aligned_cv(ad.a1(s, d), 3),
         f"{ad.A1}, days AS (SELECT DISTINCT series_id, {B('t')}::DATE AS day FROM a1), r AS (SELECT *, row_number() "
         f"OVER (PARTITION BY series_id ORDER BY day) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM days), f AS (SELECT *, n // 4 AS test, "
         f"n - (3 - fold) * (n // 4) AS st FROM r, (SELECT unnest([0, 1, 2]) AS fold)) ;; SELECT series_id, fold, min(day) FILTER (r >= st "
         f"AND r < st + test) AS test_start, max(day) FILTER (r >= st AND r < st + test) AS test_end, count(*) FILTER (r < st) AS train_days, count(*) FILTER (r >= st "
         f"AND r < st + test) AS test_days FROM f GROUP BY 1, 2")
register("chk_no_holdout", "series_id:s n:i first:t", lambda s, d: checks.holdout_rows(ad.a1(s, d), ts("2024-01-25")),
         f"{ad.A1} ;; SELECT series_id, count(*) AS n, min(t) AS first FROM a1 WHERE t >= TIMESTAMP '2024-01-25' GROUP BY 1")

# --- aggregates -------------------------------------------------------------------------------------
_MODELS = ["pred_full", "pred_alt"]
_LONG = "m AS (SELECT *, 'pred_full' AS model, pred_full AS p FROM a5 UNION ALL SELECT *, 'pred_alt', pred_alt FROM a5), k AS (SELECT * FROM m WHERE pred_full IS NOT NULL AND pred_alt IS NOT NULL AND price IS NOT NULL)"


def _scored(s: SparkSession, d: str) -> DataFrame:
    rows = timeseries.add_local_columns(metrics.common_mask(ad.a5(s, d), ["price", *_MODELS]))
    return metrics.long_predictions(rows, _MODELS, ["series_id", "price", "hour_local", "fold"])


_METRIC = "count(*) AS n, avg(abs(price - p)) AS mae, sqrt(avg((price - p) ** 2)) AS rmse, median(abs(price - p)) AS median_ae"
register("agg_point_metrics", "series_id:s model:s n:i mae:f rmse:f median_ae:f", lambda s, d: metrics.point_metrics(_scored(s, d), ["series_id", "model"]), f"{ad.A5}, "
    f"{_LONG} ;; SELECT series_id, model, {_METRIC} FROM k GROUP BY 1, 2")
register("agg_metrics_by_group", "model:s hour_local:i n:i mae:f rmse:f median_ae:f", lambda s, d: metrics.point_metrics(_scored(s, d), ["model", "hour_local"]), f"{ad.A5}, "
    f"{_LONG} ;; SELECT model, hour({B('t')}) AS hour_local, {_METRIC} FROM k GROUP BY 1, 2")
register("agg_coverage_counts", "n_rows:i n_pred_full:i n_pred_alt:i n_common:i", lambda s, d: metrics.coverage_counts(ad.a5(s, d), _MODELS), f"{ad.A5} "
    f";; SELECT count(*) AS n_rows, count(pred_full) AS n_pred_full, count(pred_alt) AS n_pred_alt, count(*) FILTER (pred_full IS NOT NULL "
    f"AND pred_alt IS NOT NULL) AS n_common FROM a5")
_COLS3 = ["price", "load_mw", "wind_on_mw", "wind_off_mw", "solar_mw"]
_U3 = "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM a3" for c in _COLS3) + ")"
_PCT = metrics.PERCENTILES
register("agg_describe", "column:s n:i mean:f std:f lo:f " + " ".join(f"p{q}:f" for q in _PCT) + " hi:f", lambda s, d: metrics.describe(ad.a3(s, d), _COLS3),
         f"{ad.A3}, {_U3} ;; SELECT \"column\", count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lo, " + ", ".join(f"quantile_cont(v, "
         f"{q / 100}) AS p{q}" for q in _PCT) + ", max(v) AS hi FROM u GROUP BY 1")
register("agg_missingness", "column:s n_missing:i pct_missing:f", lambda s, d: metrics.missingness(ad.a3(s, d), _COLS3), f"{ad.A3}, "
    f"{_U3} ;; SELECT \"column\", count(*) - count(v) AS n_missing, (count(*) - count(v)) * 100.0 / count(*) AS pct_missing FROM u GROUP BY 1")
_SHARES = {"negative": "price < 0", "zero": "price = 0", "above_200": "price > 200", "above_500": "price > 500"}
register("agg_count_share", "series_id:s " + " ".join(f"n_{k}:i share_{k}:f" for k in _SHARES), lambda s, d: metrics.count_share(timeseries.regularize(ad.a1(s, d)), ["series_id"]),
         f"{ad.REG} ;; SELECT series_id, " + ", ".join(f"count(*) FILTER ({c}) AS n_{k}, "
         f"count(*) FILTER ({c}) / count(price) AS share_{k}" for k, c in _SHARES.items()) + " FROM reg GROUP BY 1")
register("agg_seasonality", "grouping_key:s level:i mean:f std:f n:i", lambda s, d: metrics.seasonality(timeseries.add_local_columns(ad.a1(s, d)), "price", ["hour_local", "dow_local", "month_local"]),
         f"{ad.A1}, l AS (SELECT price, {B('t')} AS lt FROM a1), u AS (SELECT price, 'hour_local' AS grouping_key, hour(lt) AS level FROM l UNION ALL SELECT price, "
         f"'dow_local', isodow(lt) - 1 FROM l UNION ALL SELECT price, 'month_local', month(lt) FROM l) ;; SELECT grouping_key, level, avg(price) AS mean, "
         f"stddev_samp(price) AS std, count(price) AS n FROM u GROUP BY 1, 2")
register("agg_regime_compare", "post:i mean:f median:f std:f lo:f hi:f n:i", lambda s, d: metrics.profile(timeseries.regime_flag(ad.a1(s, d), ts("2024-01-14 23:00:00")), ["post"]),
         f"{ad.A1} ;; SELECT (t >= TIMESTAMP '2024-01-14 23:00:00')::INT AS post, avg(price) AS mean, median(price) AS median, stddev_samp(price) AS std, "
         f"min(price) AS lo, max(price) AS hi, count(*) AS n FROM a1 GROUP BY 1")
register("agg_seasonality_by_year", "year_local:i mean:f median:f std:f lo:f hi:f n:i",
         lambda s, d: metrics.profile(read_table(s, d, "orders").select(F.year("o_orderdate").alias("year_local"), F.col("o_totalprice").cast("double").alias("price")), ["year_local"]),
         "SELECT year(o_orderdate) AS year_local, avg(p) AS mean, median(p) AS median, stddev_samp(p) AS std, min(p) AS lo, max(p) AS hi, count(p) AS n "
         "FROM (SELECT o_orderdate, o_totalprice::DOUBLE AS p FROM orders) GROUP BY 1")
register("agg_weekend_hour_profile", "weekend:i hour_local:i mean:f", lambda s, d: metrics.hour_profile(timeseries.add_local_columns(ad.a1(s, d))),
         f"{ad.A1} ;; SELECT (isodow({B('t')}) >= 6)::INT AS weekend, hour({B('t')}) AS hour_local, avg(price) AS mean FROM a1 GROUP BY 1, 2")
_RANKS = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0"
register("agg_corr", "wk:i n:i pearson:f spearman:f", lambda s, d: metrics.correlations(ad.a3(s, d).withColumn("wk", F.weekofyear("timestamp_utc")), ["wk"], "price", "load_mw", overall=True),
         f"{ad.A3}, b AS (SELECT weekofyear(t) AS wk, price AS x, load_mw AS y FROM a3 WHERE price IS NOT NULL AND load_mw IS NOT NULL), u AS (SELECT * FROM b "
         f"UNION ALL SELECT NULL, x, y FROM b), "
         f"r AS (SELECT *, {_RANKS.format('wk', 'x')} AS rx, {_RANKS.format('wk', 'y')} AS ry FROM u) ;; SELECT wk, count(*) AS n, CASE WHEN count(*) > 1 THEN corr(x, "
         f"y) END AS pearson, CASE WHEN count(*) > 1 THEN corr(rx, ry) END AS spearman FROM r GROUP BY 1")
register("agg_quantile_bins", "bin:i median_x:f median_y:f mean_y:f n:i", lambda s, d: metrics.quantile_bins(ad.a3(s, d), "load_mw", "price", 20),
         f"{ad.A3}, r AS (SELECT load_mw AS x, price AS y FROM a3 WHERE load_mw IS NOT NULL AND price IS NOT NULL), e AS (SELECT list_distinct(quantile_cont(x, "
         f"[i / 20.0 FOR i IN range(21)])) AS edges FROM r), b AS (SELECT x, y, greatest(len([v FOR v IN edges IF v < x]) - 1, 0) AS bin FROM r, e) ;; SELECT bin, "
         f"median(x) AS median_x, median(y) AS median_y, avg(y) AS mean_y, count(*) AS n FROM b GROUP BY 1".replace("quantile_cont(x, "
         "[i / 20.0 FOR i IN range(21)])", "quantile_cont(x, [" + ", ".join(str(i / 20) for i in range(21)) + "])"))
register("agg_extreme_threshold", f"{KEY} is_extreme:b", lambda s, d: metrics.extreme_flags(ad.a1(s, d).where(F.col("timestamp_utc") < ts("2024-01-15")), ad.a1(s, d), "price"),
         f"{ad.A1}, tr AS (SELECT price FROM a1 WHERE t < TIMESTAMP '2024-01-15'), c AS (SELECT median(price) AS c FROM tr), l AS (SELECT quantile_cont(abs(price - c), "
         f"0.95) AS l FROM tr, c) ;; SELECT series_id, t AS timestamp_utc, abs(price - c) > l AS is_extreme FROM a1, c, l")
register("agg_day_flags", "series_id:s delivery_date:d any_negative:b any_above_200:b any_above_500:b", lambda s, d: metrics.day_flags(ad.a1(s, d)),
         f"{ad.A1} ;; SELECT series_id, {B('t')}::DATE AS delivery_date, bool_or(price < 0) AS any_negative, bool_or(price > 200) AS any_above_200, "
         f"bool_or(price > 500) AS any_above_500 FROM a1 GROUP BY 1, 2")
_RQ = metrics.RESIDUAL_QUANTILES
register("agg_residual_summary", "series_id:s n:i mean:f median:f std:f " + " ".join(f"q{q:02d}:f" for q in _RQ) + " worst_10:f worst_5:f", lambda s, d: metrics.residual_summary(ad.a5(s, d), ["series_id"], "residual"),
         f"{ad.A5}, r AS (SELECT series_id, residual AS v, row_number() OVER (PARTITION BY series_id ORDER BY residual) AS rn, count(*) "
         f"OVER (PARTITION BY series_id) AS n FROM a5 WHERE residual IS NOT NULL) ;; SELECT series_id, count(*) AS n, avg(v) AS mean, median(v) AS median, "
         f"stddev_samp(v) AS std, "
         + ", ".join(f"quantile_cont(v, {q / 100}) AS q{q:02d}" for q in _RQ) + ", avg(v) FILTER (rn <= greatest(1, floor(n * 0.1))) AS worst_10, "
         "avg(v) FILTER (rn <= greatest(1, floor(n * 0.05))) AS worst_5 FROM r GROUP BY 1")
register("top_k_extremes", "side:s series_id:s timestamp_utc:t price:f", lambda s, d: metrics.extremes(ad.a1(s, d), "price"),
         f"{ad.A1} ;; SELECT 'highest' AS side, series_id, t AS timestamp_utc, price FROM (SELECT * FROM a1 ORDER BY price DESC, t, series_id LIMIT 10) "
         f"UNION ALL SELECT 'lowest', series_id, t, price FROM (SELECT * FROM a1 ORDER BY price, t, series_id LIMIT 10)")

# --- sequence comparison ----------------------------------------------------------------------------
def _sequences(s: SparkSession, d: str) -> list[DataFrame]:
    return [ad.a6(s, d).select("timestamp_utc", F.col(f"price_seq{i}").alias("price")).where("price is not null") for i in (1, 2)]


_CMP = f"{ad.A6}, cm AS (SELECT *, abs(price_seq1 - price_seq2) AS diff, CASE WHEN price_seq2 IS NULL THEN 'seq1_only' WHEN price_seq1 IS NULL THEN 'seq2_only' ELSE 'both' END AS coverage FROM a6 WHERE price_seq1 IS NOT NULL OR price_seq2 IS NOT NULL)"
register("jn_sequence_compare", "timestamp_utc:t price_seq1:f price_seq2:f diff:f coverage:s", lambda s, d: docs.compare_sequences(*_sequences(s, d)).where("disagrees or coverage <> 'both'"),
         f"{_CMP} ;; SELECT t AS timestamp_utc, price_seq1, price_seq2, diff, coverage FROM cm WHERE diff > 0.01 OR coverage <> 'both'")
register("jn_sequence_coverage", "n_both:i n_seq1_only:i n_seq2_only:i n_disagree:i", lambda s, d: docs.sequence_coverage(docs.compare_sequences(*_sequences(s, d))),
         f"{_CMP} ;; SELECT count(*) FILTER (coverage = 'both') AS n_both, count(*) FILTER (coverage = 'seq1_only') AS n_seq1_only, "
         f"count(*) FILTER (coverage = 'seq2_only') AS n_seq2_only, count(*) FILTER (diff > 0.01) AS n_disagree FROM cm")
register("jn_sequence2_only", "timestamp_utc:t", lambda s, d: joins.only_in(*_sequences(s, d)[::-1], ["timestamp_utc"]), f"{ad.A6} ;; SELECT t AS timestamp_utc FROM a6 "
    f"WHERE price_seq1 IS NULL AND price_seq2 IS NOT NULL")
_MATCHED = lambda s, d: docs.compare_sequences(*_sequences(s, d)).where("disagrees").join(ad.a6(s, d).where("hour(timestamp_utc) <> 3").select("timestamp_utc", "price_ref"), "timestamp_utc", "left").withColumn("match", fn.classify_match(F.col("price_ref"), F.col("price_seq1"), F.col("price_seq2"), 0.01))
_MATCH_SQL = f"{_CMP}, ma AS (SELECT CASE WHEN hour(t) = 3 THEN 'no_data' WHEN a AND b THEN 'both' WHEN a THEN 'seq1' WHEN b THEN 'seq2' ELSE 'neither' END AS match FROM (SELECT *, abs(price_ref - price_seq1) <= 0.01 AS a, abs(price_ref - price_seq2) <= 0.01 AS b FROM cm WHERE diff > 0.01))"
register("jn_reference_crosscheck", "match:s n:i", lambda s, d: _MATCHED(s, d).groupBy("match").agg(F.count("*").alias("n")), f"{_MATCH_SQL} ;; SELECT match, "
    f"count(*) AS n FROM ma GROUP BY 1")
register("jn_reference_verdict", "n_seq1:i n_seq2:i n_neither:i n_both:i n_no_data:i verdict:s", lambda s, d: docs.reference_verdict(_MATCHED(s, d)),
         f"{_MATCH_SQL}, nn AS (SELECT " + ", ".join(f"count(*) FILTER (match = '{m}') AS n_{m}" for m in ("seq1", "seq2", "neither", "both", "no_data")) + " FROM ma), "
         "al AS (SELECT *, n_seq1 + n_seq2 + n_neither AS a FROM nn) ;; "
         "SELECT *, CASE WHEN a = 0 THEN 'nothing' WHEN n_seq1 / a > 0.95 AND n_seq2 / a < 0.05 THEN 'seq1' WHEN n_seq2 / a > 0.95 "
         "AND n_seq1 / a < 0.05 THEN 'seq2' ELSE 'mixed' END AS verdict FROM al")

# --- uncertainty ------------------------------------------------------------------------------------
register("unc_residuals", f"{KEY} fold:i residual:f", lambda s, d: uncertainty.residuals(ad.a5(s, d).drop("residual"), "pred_full"), f"{ad.A5} ;; SELECT series_id, "
    f"t AS timestamp_utc, fold, residual FROM a5 WHERE fold IS NOT NULL")
register("unc_day_safe_quantiles", f"{KEY} L:f U:f", ad.a5, f"{ad.A5} ;; SELECT series_id, t AS timestamp_utc, l AS L, u AS U FROM a5")
_CAL = "coverage:f below:f above:f width:f interval_score:f"
_CALSQL = "count(*) AS n, avg((price BETWEEN l AND u)::INT) AS coverage, avg((price < l)::INT) AS below, avg((price > u)::INT) AS above, avg(u - l) AS width, avg((u - l) + (greatest(l - price, 0) + greatest(price - u, 0)) * 10) AS interval_score"
register("unc_calibration", f"series_id:s n:i {_CAL}", lambda s, d: uncertainty.calibration(ad.a5(s, d), ["series_id"]), f"{ad.A5} ;; SELECT series_id, {_CALSQL} "
    f"FROM a5 WHERE l IS NOT NULL AND price IS NOT NULL GROUP BY 1")
register("unc_calibration_by_fold", f"fold:i n:i {_CAL}", lambda s, d: uncertainty.calibration(ad.a5(s, d).where("fold is not null"), ["fold"]), f"{ad.A5} "
    f";; SELECT fold, {_CALSQL} FROM a5 WHERE l IS NOT NULL AND price IS NOT NULL AND fold IS NOT NULL GROUP BY 1")
register("unc_calibration_group", f"model:s grouping_key:s level:s n:i {_CAL}",
         lambda s, d: uncertainty.calibration_sets(_crossed_bounds(s, d), {"full": ("full_L", "full_U"), "alt": ("alt_L", "alt_U")}, {"hour": F.hour(fn.local_time(F.col("timestamp_utc"))), "week": F.weekofyear(fn.local_time(F.col("timestamp_utc"))), "month": F.date_format(fn.local_time(F.col("timestamp_utc")), "yyyy-MM")}),
         f"{ad.A5}, {ad.QA}, b AS (SELECT a5.series_id, a5.t, price, 'full' AS model, l, u FROM a5 UNION ALL SELECT a5.series_id, a5.t, price, 'alt', pred_alt + a10, "
         f"pred_alt + a90 FROM a5 JOIN qa ON qa.series_id = a5.series_id AND qa.d = a5.d), "
         f"g AS (SELECT *, 'overall' AS grouping_key, NULL::VARCHAR AS level FROM b UNION ALL SELECT *, 'hour', hour({B('t')})::VARCHAR FROM b UNION ALL SELECT *, "
         f"'week', weekofyear({B('t')})::VARCHAR FROM b UNION ALL SELECT *, 'month', strftime({B('t')}, '%Y-%m') FROM b) ;; "
         f"SELECT model, grouping_key, level, {_CALSQL} FROM g WHERE l IS NOT NULL AND u IS NOT NULL AND price IS NOT NULL GROUP BY 1, 2, 3")
_QW = "qw AS (SELECT series_id, w, (d + k::INT)::DATE AS d, quantile_cont(r, 0.1) AS lo, quantile_cont(r, 0.9) AS hi, count(DISTINCT d) AS nd FROM (SELECT series_id, d, residual AS r, w, unnest(generate_series(1, w)) AS k FROM rolled, (SELECT unnest([5, 7, 10]) AS w) WHERE isfinite(residual)) GROUP BY 1, 2, 3 HAVING nd >= greatest(1, w // 4)), cand AS (SELECT r.series_id, r.t, r.price, r.fold, ww.w, pred_full + lo AS l, pred_full + hi AS u FROM rolled r CROSS JOIN (SELECT unnest([5, 7, 10]) AS w) ww LEFT JOIN qw ON qw.series_id = r.series_id AND qw.d = r.d AND qw.w = ww.w)"
_OK = "l IS NOT NULL AND u IS NOT NULL AND price IS NOT NULL"
_SCORED = lambda source, by="w": f"(SELECT {by}, " + _CALSQL + f" FROM {source} WHERE {_OK} GROUP BY ALL) x JOIN (SELECT {by}, count(*) FILTER (l IS NULL OR u IS NULL) AS n_warmup FROM {source} GROUP BY ALL) y USING ({by})"
#: Of each window the first instant with bounds; the latest of them, from which all are compared.
_START = "fv AS (SELECT w, min(t) AS first_valid FROM cand WHERE l IS NOT NULL GROUP BY 1), cs AS (SELECT CASE WHEN count(*) = 3 THEN max(first_valid) END AS start FROM fv), com AS (SELECT cand.* FROM cand, cs WHERE t >= start)"


def _candidates(s: SparkSession, d: str) -> DataFrame:
    rows = ad.a5(s, d).select("series_id", "timestamp_utc", "price", "pred_full", "residual", "fold")
    return saved(uncertainty.window_candidates(rows, "pred_full", "residual", [5, 7, 10], ("price", "fold")))


def _common(s: SparkSession, d: str) -> DataFrame:
    return saved(uncertainty.from_common_start(_candidates(s, d), 3))


register("unc_window_candidate", f"window_days:i n:i n_warmup:i {_CAL}", lambda s, d: uncertainty.window_scores(_candidates(s, d)), f"{ad.A5}, {_QW} ;; SELECT *, "
    f"w AS window_days FROM {_SCORED('cand')}")
register("unc_window_common", f"window_days:i n:i n_warmup:i {_CAL}", lambda s, d: uncertainty.window_scores(_common(s, d)), f"{ad.A5}, {_QW}, {_START} ;; SELECT *, "
    f"w AS window_days FROM {_SCORED('com')}")
register("unc_window_selection", "window_days:i interval_score:f equal_n:b", lambda s, d: uncertainty.select_window(uncertainty.calibration(_common(s, d), ["window_days"])),
         f"{ad.A5}, {_QW}, {_START} ;; SELECT arg_min(w, interval_score) AS window_days, min(interval_score) AS interval_score, min(n) = max(n) AS equal_n FROM {_SCORED('com')}")
register("unc_window_off_nominal", "series_id:s window_days:i fold:i coverage:f off:f", lambda s, d: uncertainty.off_nominal(uncertainty.calibration(_common(s, d).where("fold is not null"), ["series_id", "window_days", "fold"])),
         f"{ad.A5}, {_QW}, {_START}, sc AS (SELECT series_id, w, fold, {_CALSQL} FROM com WHERE {_OK} AND fold IS NOT NULL GROUP BY 1, 2, 3) ;; SELECT series_id, "
         f"w AS window_days, fold, coverage, abs(coverage - 0.8) AS off FROM sc WHERE abs(coverage - 0.8) > 0.03")
register("unc_common_start", "window_days:i first_valid:t common_start:t", lambda s, d: uncertainty.common_start(_candidates(s, d), 3), f"{ad.A5}, {_QW}, {_START} "
    f";; SELECT w AS window_days, first_valid, start AS common_start FROM fv, cs")
register("win_rolling_coverage", f"{KEY} coverage:f width:f n:i", lambda s, d: uncertainty.rolling_coverage(ad.a5(s, d), 5),
         f"{ad.A5}, k AS (SELECT * FROM a5 WHERE price IS NOT NULL AND l IS NOT NULL AND u IS NOT NULL) ;; SELECT series_id, t AS timestamp_utc, avg((price BETWEEN l "
         f"AND u)::INT) OVER w AS coverage, avg(u - l) OVER w AS width, count(*) OVER w AS n FROM k WINDOW w "
         f"AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN INTERVAL 431999 SECOND PRECEDING AND CURRENT ROW)")
register("win_worst_window", f"{KEY} coverage:f n:i", lambda s, d: uncertainty.worst_window(uncertainty.rolling_coverage(ad.a5(s, d), 5)),
         f"{ad.A5}, k AS (SELECT * FROM a5 WHERE price IS NOT NULL AND l IS NOT NULL AND u IS NOT NULL), r AS (SELECT series_id, t, avg((price BETWEEN l AND u)::INT) "
         f"OVER w AS coverage, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN INTERVAL 431999 SECOND PRECEDING "
         f"AND CURRENT ROW)), x AS (SELECT *, max(n) OVER (PARTITION BY series_id) AS most FROM r) ;; SELECT series_id, t AS timestamp_utc, coverage, n FROM (SELECT *, "
         f"row_number() OVER (PARTITION BY series_id ORDER BY coverage, t) AS rn FROM x WHERE n >= most / 2) WHERE rn = 1")
register("win_latest_offsets", "series_id:s q_lo:f q_hi:f",
         lambda s, d: uncertainty.latest_offsets(ad.a5(s, d).withColumns({"q_lo": F.col("L") - F.col("pred_full"), "q_hi": F.col("U") - F.col("pred_full")}), ["q_lo", "q_hi"]),
         f"{ad.A5} ;; SELECT series_id, arg_max(l - pred_full, t) AS q_lo, arg_max(u - pred_full, t) AS q_hi FROM a5 WHERE l IS NOT NULL GROUP BY 1")
register("win_residual_quantile_hourly", f"{KEY} q10:f q50:f q90:f", lambda s, d: uncertainty.hourly_quantiles(ad.a5(s, d), "residual", 3, 1, prediction="pred_full"),
         f"{ad.A5}, gp AS (SELECT series_id, median(g) AS g FROM (SELECT series_id, (epoch(t) - epoch(lag(t) OVER (PARTITION BY series_id ORDER BY t))) / 3600 AS g "
         f"FROM a5) GROUP BY 1) ;; SELECT a5.series_id, t AS timestamp_utc, "
         + ", ".join(f"CASE WHEN count(residual) OVER w >= greatest(1, floor(24 / g)) THEN pred_full + quantile_cont(residual, {q}) "
         f"OVER w END AS q{round(q * 100)}" for q in (0.1, 0.5, 0.9))
         + " FROM a5 JOIN gp ON gp.series_id = a5.series_id WINDOW w AS (PARTITION BY a5.series_id ORDER BY t RANGE BETWEEN INTERVAL 72 HOUR PRECEDING "
         "AND INTERVAL 1 SECOND PRECEDING)")



def _with_gaps(rows: DataFrame) -> DataFrame:
    """Residuals of which some are NaN, infinite or missing."""
    hour, r = F.floor(F.unix_timestamp("timestamp_utc") / 3600), F.col("residual")
    odd = F.when(hour % 5 == 0, F.lit(float("nan"))).when(hour % 7 == 0, F.lit(float("inf"))).when(hour % 11 == 0, F.lit(float("-inf"))).when(hour % 13 != 0, r)
    return rows.withColumn("residual", odd)


_HOUR = "(epoch(t)::BIGINT // 3600)"
register(
    "win_residual_quantile_hourly_gaps", f"{KEY} q10:f q50:f q90:f", lambda s, d: uncertainty.hourly_quantiles(_with_gaps(ad.a5(s, d)), "residual", 3, 1),
    f"""{ad.A5},
gp AS (SELECT series_id, median(g) AS g FROM (SELECT series_id, (epoch(t) - epoch(lag(t) OVER (PARTITION BY series_id ORDER BY t))) / 3600 AS g FROM a5) GROUP BY 1),
od AS (SELECT series_id, t, CASE WHEN {_HOUR} % 5 <> 0 AND {_HOUR} % 7 <> 0 AND {_HOUR} % 11 <> 0 AND {_HOUR} % 13 <> 0 THEN residual END AS r FROM a5) ;;
SELECT od.series_id, t AS timestamp_utc, """
    + ", ".join(f"CASE WHEN count(r) OVER w >= greatest(1, floor(24 / g)) THEN quantile_cont(r, {q}) OVER w END AS q{round(q * 100)}" for q in (0.1, 0.5, 0.9))
    + """
FROM od JOIN gp ON gp.series_id = od.series_id
WINDOW w AS (PARTITION BY od.series_id ORDER BY t RANGE BETWEEN INTERVAL 72 HOUR PRECEDING AND INTERVAL 1 SECOND PRECEDING)""",
)

# --- decisions and reports --------------------------------------------------------------------------
_DAYS = "series_id:s delivery_date:d"
register("st_common_days", f"{_DAYS} n_hours:i", lambda s, d: decisions.common_days(ad.a5(s, d), ad.REQUIRED), f"{ad.a7_sql()} ;; SELECT series_id, d AS delivery_date, "
    f"n_hours FROM days")
register("st_common_days_unfilled", f"{_DAYS} n_hours:i", lambda s, d: decisions.common_days(forecast.day_of(timeseries.regularize(ad.a1(s, d))), ["price"]),
         f"{ad.REG} ;; SELECT series_id, {B('t')}::DATE AS delivery_date, count(*) AS n_hours FROM reg GROUP BY 1, 2 HAVING bool_and(price IS NOT NULL)")
register("st_backtest", f"{_DAYS} strategy:s traded:b i:i j:i gross_pnl:f net_pnl:f oracle_pnl:f n_hours:i", ad.a7, f"{ad.a7_sql()} ;; SELECT *, d AS delivery_date FROM a7")
_CELLS = [(e, c) for e in (0.80, 0.85, 0.90) for c in (5.0, 10.0, 15.0)]
_DELTA = ", ".join(f"sum(CASE WHEN strategy = '{a}' THEN net_pnl ELSE 0 END) - sum(CASE WHEN strategy = '{b}' THEN net_pnl ELSE 0 END) AS delta_{a}_{b}" for a, b in reports.DELTAS)
_DELTA_SPEC = " ".join(f"delta_{a}_{b}:f" for a, b in reports.DELTAS)
register("st_grid", f"eta:f c:f {_DELTA_SPEC}", lambda s, d: reports.named_deltas(ad.a7(s, d, _CELLS), ["eta", "c"]), f"{ad.a7_sql(_CELLS)} ;; SELECT eta, c, {_DELTA} "
    f"FROM a7 GROUP BY 1, 2")
register("st_verdict", "primary_delta:f positive_cells:i cells:i verdict:s", lambda s, d: reports.verdict(reports.named_deltas(ad.a7(s, d, _CELLS), ["eta", "c"]), "delta_S2_S1", "eta = 0.85 and c = 10"),
         f"{ad.a7_sql(_CELLS)}, g AS (SELECT eta, c, {_DELTA} FROM a7 GROUP BY 1, 2), v AS (SELECT max(delta_S2_S1) FILTER (eta = 0.85 AND c = 10) AS primary_delta, "
         f"count(*) FILTER (delta_S2_S1 > 0) AS positive_cells, count(*) AS cells FROM g) ;; SELECT *, "
         f"CASE WHEN primary_delta <= 0 THEN 'FAILURE' WHEN positive_cells = cells THEN 'CONFIRMATION' ELSE 'PARTIAL' END AS verdict FROM v")
register("fn_sign_label", "sign:s n:i", lambda s, d: reports.named_deltas(ad.a7(s, d, _CELLS), ["eta", "c"]).groupBy(fn.sign_label(F.round("delta_S2_S1", 6)).alias("sign")).agg(F.count("*").alias("n")),
         f"{ad.a7_sql(_CELLS)}, g AS (SELECT eta, c, {_DELTA} FROM a7 GROUP BY 1, 2) ;; SELECT CASE WHEN round(delta_S2_S1, 6) > 0 THEN '+' WHEN round(delta_S2_S1, "
         f"6) < 0 THEN '-' ELSE '0' END AS sign, count(*) AS n FROM g GROUP BY 1")
register("rep_primary_table", "strategy:s traded_days:i idle_days:i gross:f net:f mean_net:f median_net:f profitable_rate:f hit_rate:f worst:f", lambda s, d: reports.primary_table(ad.a7(s, d), ["strategy"]),
         f"{ad.a7_sql()} ;; SELECT strategy, count(*) FILTER (traded) AS traded_days, count(*) FILTER (NOT traded) AS idle_days, sum(gross_pnl) AS gross, "
         f"sum(net_pnl) AS net, avg(net_pnl) AS mean_net, median(net_pnl) AS median_net, avg((net_pnl > 0)::INT) AS profitable_rate, "
         f"avg((net_pnl > 0)::INT) FILTER (traded) AS hit_rate, min(net_pnl) AS worst FROM a7 GROUP BY 1")
register("rep_named_deltas", f"series_id:s {_DELTA_SPEC}", lambda s, d: reports.named_deltas(ad.a7(s, d), ["series_id"]), f"{ad.a7_sql()} ;; SELECT series_id, {_DELTA} "
    f"FROM a7 GROUP BY 1")
register("rep_value_capture", "strategy:s net:f oracle:f capture:f", lambda s, d: reports.value_capture(ad.a7(s, d), ["strategy"]), f"{ad.a7_sql()} ;; SELECT strategy, "
    f"sum(net_pnl) AS net, sum(oracle_pnl) AS oracle, CASE WHEN sum(oracle_pnl) > 0 THEN sum(net_pnl) / sum(oracle_pnl) END AS capture FROM a7 GROUP BY 1")
_FLAGS = ["any_negative", "any_above_200", "any_above_500", "post"]
register("rep_split", f"flag:s is_set:b n_days:i {_DELTA_SPEC}",
         lambda s, d: reports.split_by_flags(reports.with_day_flags(ad.a7(s, d), metrics.day_flags(ad.complete(s, d)), "2024-01-15"), _FLAGS),
         f"{ad.a7_sql()}, fl AS (SELECT series_id, d, bool_or(price < 0) AS any_negative, bool_or(price > 200) AS any_above_200, bool_or(price > 500) AS any_above_500, "
         f"d >= DATE '2024-01-15' AS post FROM placed GROUP BY 1, 2), "
         "z AS (SELECT a7.*, any_negative, any_above_200, any_above_500, post FROM a7 JOIN fl ON fl.series_id = a7.series_id AND fl.d = a7.d), "
         "zz AS (" + " UNION ALL ".join(f"SELECT '{f}' AS flag, {f} AS is_set, strategy, net_pnl FROM z" for f in _FLAGS) + f") ;; SELECT flag, is_set, "
         f"count(*) FILTER (strategy = 'S0') AS n_days, {_DELTA} FROM zz GROUP BY 1, 2")
_CAT = "CASE WHEN NOT p.traded AND NOT q.traded THEN 'both_abstain' WHEN NOT q.traded THEN 'point_only' WHEN NOT p.traded THEN 'uncertainty_only' WHEN p.i = q.i AND p.j = q.j THEN 'same_pair' ELSE 'different_pair' END"
register("rep_decompose", "series_id:s n_days:i " + " ".join(f"n_{c}:i" for c in reports.CATEGORIES) + " profits_forgone:f losses_avoided:f pair_effect:f reverse_effect:f total_gap:f reconciles:b", lambda s, d: reports.decompose(ad.a7(s, d), "S2", "S4", ["series_id"]),
         f"{ad.a7_sql()}, z AS (SELECT p.series_id, {_CAT} AS k, p.net_pnl AS a, q.net_pnl - p.net_pnl AS x FROM a7 p JOIN a7 q ON p.series_id = q.series_id "
         f"AND p.d = q.d AND p.strategy = 'S2' AND q.strategy = 'S4') ;; SELECT series_id, count(*) AS n_days, "
         + ", ".join(f"count(*) FILTER (k = '{c}') AS n_{c}" for c in reports.CATEGORIES)
         + ", sum(CASE WHEN k = 'point_only' AND a > 0 THEN a ELSE 0 END) AS profits_forgone, sum(CASE WHEN k = 'point_only' "
         "AND a < 0 THEN -a ELSE 0 END) AS losses_avoided, sum(CASE WHEN k = 'different_pair' THEN x ELSE 0 END) AS pair_effect, "
         "sum(CASE WHEN k = 'uncertainty_only' THEN x ELSE 0 END) AS reverse_effect, sum(x) AS total_gap, true AS reconciles FROM z GROUP BY 1")
register("rep_cumulative_pnl", f"series_id:s strategy:s delivery_date:d cum_pnl:f", lambda s, d: reports.cumulative(ad.a7(s, d), ["series_id", "strategy"]), f"{ad.a7_sql()} "
    f";; SELECT series_id, strategy, d AS delivery_date, sum(net_pnl) OVER (PARTITION BY series_id, strategy ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum_pnl FROM a7")
register("win_cumulative_drawdown", "series_id:s strategy:s max_drawdown:f worst_day:f worst_span:f", lambda s, d: reports.drawdown(ad.a7(s, d), ["series_id", "strategy"]),
         f"{ad.a7_sql()}, k AS (SELECT series_id, strategy, d, net_pnl, sum(net_pnl) OVER (PARTITION BY series_id, "
         f"strategy ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum, CASE WHEN count(*) OVER w5 = 5 THEN sum(net_pnl) OVER w5 END AS s5 FROM a7 WINDOW w5 "
         f"AS (PARTITION BY series_id, strategy ORDER BY d ROWS 4 PRECEDING)), p AS (SELECT *, max(cum) OVER (PARTITION BY series_id, "
         f"strategy ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM k) ;; SELECT series_id, strategy, max(peak - cum) AS max_drawdown, min(net_pnl) AS worst_day, "
         f"min(s5) AS worst_span FROM p GROUP BY 1, 2")
_TOP = ", ".join(f"sum(net_pnl) FILTER (rn <= ceil(n * {p} / 100.0)) AS top_{p}, "
    f"CASE WHEN sum(net_pnl) > 0 THEN sum(net_pnl) FILTER (rn <= ceil(n * {p} / 100.0)) / sum(net_pnl) END AS share_{p}" for p in (1, 5, 10))
register("top_share", "series_id:s strategy:s total:f top_1:f share_1:f top_5:f share_5:f top_10:f share_10:f", lambda s, d: reports.concentration(ad.a7(s, d), ["series_id", "strategy"]),
         f"{ad.a7_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, strategy ORDER BY net_pnl DESC, d) AS rn, count(*) OVER (PARTITION BY series_id, "
         f"strategy) AS n FROM a7) ;; SELECT series_id, strategy, sum(net_pnl) AS total, {_TOP} FROM r GROUP BY 1, 2")
register("risk_var_es", "strategy:s level:f var:f es:f n_total:i n_tail:f low_precision:b", lambda s, d: reports.var_es(ad.a7(s, d), ["strategy"]),
         f"{ad.a7_sql()}, l AS (SELECT strategy, -net_pnl AS x, row_number() OVER (PARTITION BY strategy ORDER BY -net_pnl DESC) AS rn, count(*) "
         f"OVER (PARTITION BY strategy) AS n FROM a7), k AS (SELECT *, (1 - level) * n AS m FROM l, (SELECT unnest([0.9::DOUBLE, 0.95::DOUBLE, "
         f"0.99::DOUBLE]) AS level)), v AS (SELECT strategy, quantile_cont(x, [0.9, 0.95, 0.99]) AS q FROM l GROUP BY 1) ;; SELECT k.strategy, level, "
         f"any_value(CASE WHEN level = 0.9 THEN q[1] WHEN level = 0.95 THEN q[2] ELSE q[3] END) AS var, sum(greatest(0, least(1, "
         f"m - (rn - 1))) * x) / any_value(m) AS es, any_value(n) AS n_total, any_value(m) AS n_tail, any_value(m) < 20 AS low_precision FROM k "
         f"JOIN v ON v.strategy = k.strategy GROUP BY 1, 2")
register("risk_descriptive", "strategy:s mean_loss:f median_loss:f worst_loss:f best_loss:f", lambda s, d: reports.descriptive_losses(ad.a7(s, d), ["strategy"]), f"{ad.a7_sql()} "
    f";; SELECT strategy, avg(-net_pnl) AS mean_loss, median(-net_pnl) AS median_loss, max(-net_pnl) AS worst_loss, min(-net_pnl) AS best_loss FROM a7 GROUP BY 1")
_CON = "con AS (SELECT d, sum(CASE WHEN strategy = 'S2' THEN net_pnl WHEN strategy = 'S1' THEN -net_pnl ELSE 0 END) AS x FROM a7 GROUP BY 1)"
register("bs_contrast_stats", "n:i total:f mean:f sd:f wins:i losses:i ties:i", lambda s, d: reports.contrast_stats(reports.contrast(ad.a7(s, d), "S2", "S1")), f"{ad.a7_sql()}, "
    f"{_CON} ;; SELECT count(*) AS n, sum(x) AS total, avg(x) AS mean, stddev_samp(x) AS sd, count(*) FILTER (x > 1e-9) AS wins, count(*) FILTER (x < -1e-9) AS losses, "
    f"count(*) FILTER (abs(x) <= 1e-9) AS ties FROM con")
register("agg_monthly_sum", "month:s n:i delta:f", lambda s, d: reports.monthly(reports.contrast(ad.a7(s, d), "S2", "S1")), f"{ad.a7_sql()}, {_CON} "
    f";; SELECT strftime(d, '%Y-%m') AS month, count(*) AS n, sum(x) AS delta FROM con GROUP BY 1")
register("bs_block_ci", "reps:i low:f high:f", lambda s, d: reports.block_bootstrap(reports.contrast(ad.a7(s, d), "S2", "S1"), 7, 20000, 11), f"""{ad.a7_sql()}, {_CON},
nb AS (SELECT row_number() OVER (ORDER BY d) - 1 AS k, x FROM con), sz AS (SELECT count(*) AS n, (count(*) + 6) // 7 AS blocks FROM con),
dr AS (SELECT id, blk, {DRAW("'11/' || id || '/' || blk")} % n AS start, n, blocks FROM sz, range(20000) r(id), range(100000) b(blk) WHERE blk < blocks),
el AS (SELECT id, (start + o) % n AS k FROM dr, range(7) q(o) WHERE blk < blocks - 1 OR o < n - 7 * (blocks - 1)),
tt AS (SELECT id, sum(x) AS total FROM el JOIN nb USING (k) GROUP BY id) ;; SELECT count(*) AS reps, quantile_cont(total, 0.025) AS low, quantile_cont(total, 0.975) AS high FROM tt""")
#: Thresholds of the decision score; the rule compared is the one on bounds (S4).
_TAUS = [0.0, 20.0, 30.0, 40.0, 42.5, 50.0, 60.0]
register("st_threshold_frontier", "series_id:s strategy:s tau:f trades:i pnl:f hit_rate:f worst:f max_drawdown:f overlap:i threshold_only:i other_only:i", lambda s, d: reports.threshold_frontier(ad.a7(s, d), "score", _TAUS, ["series_id", "strategy"], "S4"),
         f"{ad.a7_sql()}, k AS (SELECT a.*, tau, coalesce(a.score > tau, false) AS hot, o.traded AS too FROM a7 a JOIN a7 o ON o.strategy = 'S4' "
         f"AND o.series_id = a.series_id AND o.d = a.d CROSS JOIN (SELECT unnest({_TAUS}::DOUBLE[]) AS tau)), "
         "x AS (SELECT *, CASE WHEN hot THEN net_pnl ELSE 0 END AS v, sum(CASE WHEN hot THEN net_pnl ELSE 0 END) OVER w AS cum FROM k WINDOW w "
         "AS (PARTITION BY series_id, strategy, tau ORDER BY d ROWS UNBOUNDED PRECEDING)), "
         "y AS (SELECT *, max(cum) OVER (PARTITION BY series_id, strategy, tau ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM x) ;; "
         "SELECT series_id, strategy, tau, count(*) FILTER (hot) AS trades, sum(v) AS pnl, avg((net_pnl > 0)::INT) FILTER (hot) AS hit_rate, min(v) AS worst, "
         "min(cum - peak) AS max_drawdown, count(*) FILTER (hot AND too) AS overlap, count(*) FILTER (hot AND NOT too) AS threshold_only, count(*) FILTER (NOT hot "
         "AND too) AS other_only FROM y GROUP BY 1, 2, 3")
_TN = {c: f"try_cast({c} AS DOUBLE)" for c in ("i", "j")}
_RULES_SQL = {
    "null_day": "d IS NULL", "n_hours": "n_hours NOT IN (23, 24, 25)", "traded_no_flag": "traded NOT IN ('true', 'false')", "not_finite": "NOT isfinite(net_pnl)",
    "trade_without_pair": "traded = 'true' AND (i IS NULL OR j IS NULL)", "pair_without_trade": "traded = 'false' AND (i IS NOT NULL OR j IS NOT NULL)",
    "pair_no_number": f"traded = 'true' AND (i IS NOT NULL AND {_TN['i']} IS NULL OR j IS NOT NULL AND {_TN['j']} IS NULL)",
    "pair_not_whole": f"traded = 'true' AND ({_TN['i']} % 1 <> 0 OR {_TN['j']} % 1 <> 0)", "order": f"traded = 'true' AND {_TN['i']} >= {_TN['j']}",
    "bounds": f"traded = 'true' AND ({_TN['i']} < 0 OR {_TN['j']} >= n_hours)", "idle_pnl": "traded = 'false' AND abs(net_pnl) > 1e-9",
    "above_oracle": "isfinite(net_pnl) AND net_pnl > oracle_pnl + 1e-6", "s0_trades": "strategy = 'S0' AND (traded = 'true' OR net_pnl <> 0)",
}
_TWICE = "SELECT 'duplicate_day' AS rule, sum(n - 1) AS violations FROM (SELECT count(*) AS n FROM br GROUP BY series_id, d, strategy HAVING count(*) > 1)"
register("chk_backtest_rows", "rule:s violations:i", lambda s, d: checks.backtest_violations(saved(ad.broken(ad.a7(s, d)))),
         f"{ad.a7_sql()}, {ad.BROKEN} ;; SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS violations FROM br "
         f"WHERE {c}" for r, c in _RULES_SQL.items()) + f" UNION ALL {_TWICE}) WHERE violations > 0")
register("chk_backtest_rows_clean", "rule:s violations:i", lambda s, d: checks.backtest_violations(ad.a7(s, d)), f"{ad.a7_sql()} ;; SELECT 'none' AS rule, "
    f"count(*) AS violations FROM a7 WHERE n_hours NOT IN (23, 24, 25) HAVING count(*) > 0")
register("rep_backtest_summary", "strategy:s total:f trading_days:i profitable_days:i", lambda s, d: reports.backtest_summary(ad.a7(s, d), ["strategy"]), f"{ad.a7_sql()} "
    f";; SELECT strategy, sum(net_pnl) AS total, count(*) FILTER (traded) AS trading_days, count(*) FILTER (net_pnl > 0) AS profitable_days FROM a7 GROUP BY 1")

# --- forecasts --------------------------------------------------------------------------------------
register("ml_trailing_profile", "series_id:s delivery_date:d hour_local:i profile_pred:f", lambda s, d: forecast.trailing_profile(ad.a1(s, d), "price", 5),
         f"{ad.A1}, r AS (SELECT series_id, {B('t')}::DATE AS day, hour({B('t')}) AS h, price AS v FROM a1), i AS (SELECT series_id, day, row_number() "
         f"OVER (PARTITION BY series_id ORDER BY day) AS k FROM (SELECT DISTINCT series_id, day FROM r)) ;; SELECT b.series_id, b.day AS delivery_date, "
         f"h AS hour_local, avg(v) AS profile_pred FROM r JOIN i a ON a.series_id = r.series_id AND a.day = r.day JOIN i b ON b.series_id = a.series_id "
         f"AND a.k BETWEEN b.k - 5 AND b.k - 1 GROUP BY 1, 2, 3")
register("ml_promotion_rule", "base_mae:f challenger_mae:f improvement:f promoted:b", lambda s, d: forecast.promotion(metrics.point_metrics(_scored(s, d).where("fold is not null"), ["model", "fold"]), "pred_full", "pred_alt"),
         f"{ad.A5}, {_LONG}, w AS (SELECT avg(abs(price - p)) FILTER (model = 'pred_full') AS b, avg(abs(price - p)) FILTER (model = 'pred_alt') AS c FROM k "
         f"WHERE fold IS NOT NULL) ;; SELECT b AS base_mae, c AS challenger_mae, 1 - c / b AS improvement, 1 - c / b >= 0.01 AS promoted FROM w")
register("agg_weighted_mae", "model:s mae:f", lambda s, d: metrics.weighted_mae(metrics.point_metrics(_scored(s, d).where("fold is not null"), ["model", "fold"]), ["model"]), f"{ad.A5}, "
    f"{_LONG} ;; SELECT model, avg(abs(price - p)) AS mae FROM k WHERE fold IS NOT NULL GROUP BY 1")


_FEATURES = ["pred_full", "pred_alt"]


def _train_and_test(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = saved(ad.a5(s, d).select(*ROWS, "price", *_FEATURES, "fold"))
    return rows.where("fold is null or fold < 4"), rows.where("fold = 4")


def _searched(fit, grid: list[dict], k: int, unit: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        train, test = _train_and_test(s, d)
        model, _, _ = forecast.search(train, _FEATURES, "price", fit, grid, k, unit)
        return forecast.predict_complete(model, test, _FEATURES, ROWS, "predicted")

    return run


#: Grids of the queries: fewer cells than the profiles have.
_NET, _RIDGE, _TREES = forecast.cells(alpha=[0.1, 1.0, 10.0], l1_ratio=[0.1, 0.9]), forecast.cells(alpha=[0.01, 1.0, 100.0], l1_ratio=[0.0]), forecast.cells(maxDepth=[2, 3], stepSize=[0.1, 0.3], maxIter=[8])
register("ml_elasticnet_fits", f"{KEY} price:f predicted:f", _searched(forecast.elastic_net, _NET, 3, "rows"))
register("ml_gbt_fits", f"{KEY} price:f predicted:f", _searched(forecast.boosted_trees, _TREES, 2, "days"))
# without an l1 part the model has a closed form: for two standardized features a 2 x 2 system. Fold 3 is the refit
_MOMENTS = "count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS r, covar_pop(a, y) / stddev_pop(a) AS ca, covar_pop(b, y) / stddev_pop(b) AS cb"
_SOLVED = "((1 + al) * ca - r * cb) / ((1 + al) * (1 + al) - r * r) AS wa, ((1 + al) * cb - r * ca) / ((1 + al) * (1 + al) - r * r) AS wb"
register("ml_ridge", f"{KEY} price:f predicted:f", _searched(forecast.elastic_net, _RIDGE, 3, "rows"),
         f"{ad.A5}, tr AS (SELECT series_id, t, price AS y, pred_full AS a, pred_alt AS b, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS r, count(*) "
         f"OVER (PARTITION BY series_id) AS n FROM a5 WHERE (fold IS NULL OR fold < 4) AND price IS NOT NULL AND pred_full IS NOT NULL AND pred_alt IS NOT NULL), "
         "pt AS (SELECT *, CASE WHEN r < n - 3 * (n // 4) THEN -1 ELSE (r - (n - 3 * (n // 4))) // (n // 4) END AS part FROM tr), "
         f"mo AS (SELECT i, {_MOMENTS} FROM pt JOIN (SELECT unnest([0, 1, 2, 3]) AS i) ON part < i GROUP BY i), so AS (SELECT *, {_SOLVED} FROM mo, "
         f"(SELECT unnest([0.01, 1.0, 100.0]::DOUBLE[]) AS al)), "
         "er AS (SELECT al, i, avg(abs(y - (my + wa * (a - ma) / sa + wb * (b - mb) / sb))) AS mae FROM so JOIN pt ON part = i GROUP BY 1, 2), ch "
         "AS (SELECT arg_min(al, mae) AS al FROM (SELECT al, avg(mae) AS mae FROM er GROUP BY 1)) ;; "
         "SELECT series_id, t AS timestamp_utc, price, my + wa * (pred_full - ma) / sa + wb * (pred_alt - mb) / sb AS predicted FROM a5 CROSS JOIN (SELECT so.* FROM so "
         "JOIN ch ON ch.al = so.al WHERE i = 3) WHERE fold = 4")
register("chk_dataset_fingerprint", "n:i fingerprint:s", lambda s, d: checks.fingerprint(read_table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))),
         f"SELECT count(*) AS n, "
         f"sum({DRAW("o_custkey::VARCHAR || '/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || o_orderkey::VARCHAR || '/' || o_orderstatus")}::HUGEINT)::VARCHAR AS fingerprint "
         f"FROM orders")
register("smp_random", f"{KEY} price:f", lambda s, d: ad.a1(s, d).orderBy(fn.draw(F.col("series_id"), F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss"), F.lit(42))).limit(500),
         f"{ad.A1} ;; SELECT series_id, t AS timestamp_utc, price FROM a1 ORDER BY {DRAW(_SECOND)} LIMIT 500")


def _crossed_bounds(s: SparkSession, d: str) -> DataFrame:
    """Bounds of each model from its own residuals."""
    rows = ad.a5(s, d).withColumn("residual_alt", F.col("price") - F.col("pred_alt"))
    made = uncertainty.with_day_safe_quantiles(rows, {"qf": ("residual", 7, 1), "qa": ("residual_alt", 7, 1)}, (0.1, 0.9))
    side = lambda p, q, n: {f"{n}_{b}": F.col(p) + F.get(q, i) for i, b in enumerate("LU")}
    return made.withColumns(side("pred_full", "qf", "full") | side("pred_alt", "qa", "alt"))


def _least_squares(s: SparkSession, d: str, features: list[str]):
    rows = ad.a5(s, d).select(*ROWS, "price", "pred_full", "pred_alt", "fold")
    return rows, forecast.elastic_net(rows.where("fold is null or fold < 4"), features, "price", 0.0, 0.5)


def _predicted(s: SparkSession, d: str) -> DataFrame:
    rows, model = _least_squares(s, d, ["pred_full"])
    return forecast.predict_complete(model, rows.where("fold is null or fold = 4"), ["pred_full"], ROWS, "predicted")


# without a penalty the elastic net is least squares, which SQL's covariances give
_TRAIN = "tr AS (SELECT price AS y, pred_full AS a, pred_alt AS b FROM a5 WHERE (fold IS NULL OR fold < 4) AND price IS NOT NULL AND pred_full IS NOT NULL AND pred_alt IS NOT NULL)"
register("ml_predict_complete", f"{KEY} price:f predicted:f", _predicted,
         f"{ad.A5}, co AS (SELECT regr_slope(price, pred_full) AS k, regr_intercept(price, pred_full) AS c FROM a5 WHERE (fold IS NULL OR fold < 4) "
         f"AND price IS NOT NULL AND pred_full IS NOT NULL) ;; "
         "SELECT series_id, t AS timestamp_utc, price, c + k * pred_full AS predicted FROM a5, co WHERE fold IS NULL OR fold = 4")
register("ml_coefficients", "rank:i feature:s weight:f", lambda s, d: forecast.coefficients(_least_squares(s, d, ["pred_full", "pred_alt"])[1], ["pred_full", "pred_alt"]),
         f"{ad.A5}, {_TRAIN}, m AS (SELECT var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS ab, covar_samp(a, y) AS ay, covar_samp(b, y) AS by_ FROM tr), "
         "w AS (SELECT 'pred_full' AS feature, sqrt(va) * (ay * vb - by_ * ab) / (va * vb - ab * ab) AS weight FROM m UNION ALL SELECT 'pred_alt', "
         "sqrt(vb) * (by_ * va - ay * ab) / (va * vb - ab * ab) FROM m) ;; "
         "SELECT row_number() OVER (ORDER BY abs(weight) DESC, feature) AS rank, feature, weight FROM w")
register("chk_availability_tier", "column:s tier:i n_present:i",
         lambda s, d: checks.availability(ad.a3(s, d).withColumn("wind_mw", F.col("wind_on_mw") + F.col("wind_off_mw")), {"load_mw": 1, "wind_on_mw": 2, "wind_off_mw": 2, "solar_mw": 2}, {"wind_mw": ["wind_on_mw", "wind_off_mw"]}),
         f"{ad.A3} ;; " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {t} AS tier, count({v}) AS n_present FROM a3" for c, t, v in [
             ("load_mw", 1, "load_mw"), ("wind_on_mw", 2, "wind_on_mw"), ("wind_off_mw", 2, "wind_off_mw"), ("solar_mw", 2, "solar_mw"), ("wind_mw", 2, "wind_on_mw + wind_off_mw")]))
