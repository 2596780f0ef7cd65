"""Registered queries of model search and of the evaluation of folds, on the full list of predictors."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.functions.columns import local_date
from tidemark.operators import boosting, forecast, linear, metrics, reports, timeseries, uncertainty
from tidemark.sources.tables import saved

from . import adapters as ad
from . import more
from .registry import _FEATURES, _METRIC, _MOMENTS, _RIDGE, _SOLVED, KEY, ROWS, _train_and_test, register, register_like

B = ad.berlin

#: Predictors known when a day is decided on, and those of the full information set besides them.
TIER1 = [
    "load_mw", "price_lag_24", "price_lag_48", "price_lag_168", "roll_24_mean", "roll_24_std", "roll_168_mean", "roll_168_std", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "month_sin", "month_cos", "weekend", "weekend_hour_sin", "weekend_hour_cos", "post",
]
FULL = ["renewables", "residual_load", "renewable_share", *TIER1]


def a8(spark: SparkSession, d: str) -> DataFrame:
    """Five price series, one of them with prices above 500, with all predictors; folds are weeks 3 to 5."""
    price = F.when(F.col("series_id") == "error", F.col("price") * 3).otherwise(F.col("price"))
    filled = saved(timeseries.carry_forward(timeseries.regularize(ad.a1(spark, d)), "price"))
    of = lambda s: F.max(F.when(F.col("series_id") == s, F.col("price")))
    sources = filled.groupBy("timestamp_utc").agg((of("view") + 340).alias("load_mw"), (of("click") + 40).alias("wind_on_mw"), (of("signup") + 40).alias("wind_off_mw"), (of("error") + 40).alias("solar_mw"))
    known = timeseries.fundamentals(sources).withColumn("renewables", F.col("wind_total") + F.col("solar_filled"))
    rows = timeseries.build_features(filled.withColumn("price", price)).join(known, "timestamp_utc")
    week = F.floor(F.datediff(local_date(F.col("timestamp_utc")), F.lit("2024-01-01")) / 7) + 1
    return rows.withColumns({"post": (F.col("timestamp_utc") >= F.to_timestamp(F.lit("2024-01-14 23:00:00"))).cast("int"), "fold": F.when(week >= 3, week.cast("int"))})


_HOURS = {"24": 24, "48": 48, "168": 168}
_ROLL = ", ".join(
    f"CASE WHEN {B('(t - INTERVAL 24 HOUR)')}::DATE < {B('t')}::DATE AND count(price_lag_24) OVER w{h} >= {least} THEN {f}(price_lag_24) OVER w{h} END AS roll_{h}_{n}"
    for h, least in ((24, 19), (168, 134)) for f, n in (("avg", "mean"), ("stddev_samp", "std"))
)
_LAGS = ", ".join(f"CASE WHEN {B(f'(f.t - INTERVAL {h} HOUR)')}::DATE < {B('f.t')}::DATE THEN p{h}.price END AS price_lag_{h}" for h in _HOURS)
_LAG_JOINS = " ".join(f"LEFT JOIN pr p{h} ON p{h}.series_id = f.series_id AND p{h}.t + INTERVAL {h} HOUR = f.t" for h in _HOURS)
_CYCLIC = ", ".join(f"{f}(2 * pi() * {v} / {p}) AS {n}_{f}" for n, v, p in (("hour", "h", 24), ("dow", "w", 7), ("month", "m", 12)) for f in ("sin", "cos"))
A8 = f"""{ad.REG},
filled AS (SELECT series_id, t, last_value(price IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS price FROM reg),
pr AS (SELECT series_id, t, CASE WHEN series_id = 'error' THEN price * 3 ELSE price END AS price FROM filled),
src AS (
  SELECT t, max(price) FILTER (series_id = 'view') + 340 AS load_mw, max(price) FILTER (series_id = 'click') + 40 + max(price) FILTER (series_id = 'signup') + 40 AS wind,
    coalesce(max(price) FILTER (series_id = 'error') + 40, 0) AS solar
  FROM filled GROUP BY t),
known AS (
  SELECT t, load_mw, wind + solar AS renewables, load_mw - wind - solar AS residual_load, CASE WHEN load_mw > 0 THEN (wind + solar) / load_mw END AS renewable_share FROM src),
lg AS (SELECT f.series_id, f.t, f.price, {_LAGS}, hour({B('f.t')}) AS h, isodow({B('f.t')}) - 1 AS w, month({B('f.t')}) AS m FROM pr f {_LAG_JOINS}),
rl AS (
  SELECT *, {_ROLL}, {_CYCLIC}, (w >= 5)::INT AS weekend, (w >= 5)::INT * sin(2 * pi() * h / 24) AS weekend_hour_sin, (w >= 5)::INT * cos(2 * pi() * h / 24) AS weekend_hour_cos,
    (t >= TIMESTAMP '2024-01-14 23:00:00')::INT AS post, ({B('t')}::DATE - DATE '2024-01-01') // 7 + 1 AS week
  FROM lg
  WINDOW w24 AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW),
    w168 AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN INTERVAL 167 HOUR PRECEDING AND CURRENT ROW)),
a8 AS (SELECT rl.*, known.* EXCLUDE t, CASE WHEN week >= 3 THEN week END AS fold, h AS hour_local FROM rl JOIN known ON known.t = rl.t)"""
_ALL_THERE = " AND ".join(f"{c} IS NOT NULL" for c in [*FULL, "price"])

# --- moments: of the parts of an expanding cross-validation, of all predictors and the target
_COLUMNS = [*FULL, "price"]


def _moments(s: SparkSession, d: str) -> DataFrame:
    rows = a8(s, d).dropna(subset=_COLUMNS).select(*ROWS, *_COLUMNS)
    return linear.covariances(saved(forecast.with_parts(rows, 4)), _COLUMNS, "part")


register(
    "ml_moments", "part:s a:s b:s n:i mean_a:f mean_b:f covariance:f", _moments,
    f"""{A8},
cr AS (
  SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in _COLUMNS)}, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n,
    row_number() OVER () AS id
  FROM a8 WHERE {_ALL_THERE}),
pt AS (SELECT *, CASE WHEN r < n - 4 * (n // 5) THEN -1 ELSE (r - (n - 4 * (n // 5))) // (n // 5) END AS part FROM cr),
lo AS (SELECT id, part, name, list_position({_COLUMNS}, name) AS k, v FROM (UNPIVOT pt ON {', '.join(_COLUMNS)} INTO NAME name VALUE v)) ;;
SELECT x.part, x.name AS a, y.name AS b, count(*) AS n, avg(x.v) AS mean_a, avg(y.v) AS mean_b, covar_pop(x.v, y.v) AS covariance
FROM lo x JOIN lo y ON x.id = y.id AND x.k <= y.k GROUP BY 1, 2, 3""",
)

# --- search: the whole profiles on all predictors, refitted and applied to the last folds


def _searched(features: list[str], profile: str, unit: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = saved(a8(s, d).select(*ROWS, "price", "fold", *features))
        model, _, _ = linear.profile_search(rows.where("fold is null or fold < 4"), features, "price", forecast.LINEAR_PROFILES[profile], 4, unit)
        return forecast.predict_complete(model, rows.where("fold >= 4"), features, ROWS, "predicted")

    return run


register("ml_elasticnet", f"{KEY} price:f predicted:f", _searched(FULL, "v1", "rows"))
register("ml_elasticnet_v2", f"{KEY} price:f predicted:f", _searched(TIER1, "v2", "rows"))


def _boosted(s: SparkSession, d: str) -> DataFrame:
    """The whole grid over day-aligned folds, refitted and applied to the last folds."""
    rows = saved(a8(s, d).select(*ROWS, "price", "fold", *FULL))
    model, _, _ = boosting.search(rows.where("fold is null or fold < 4"), FULL, "price")
    return forecast.predict_complete(model, rows.where("fold >= 4"), FULL, ROWS, "predicted")


register("ml_gbt", f"{KEY} price:f predicted:f", _boosted)


def _cell_scores(s: SparkSession, d: str) -> DataFrame:
    """Errors of each cell and fold; without an l1 part, so that SQL can solve the same systems."""
    train, _ = _train_and_test(s, d)
    return linear.search(train, _FEATURES, "price", _RIDGE, 3)[2]


register(
    "ml_cell_scores", "cell:i fold:i mae:f alpha:f", _cell_scores,
    f"""{ad.A5},
tr AS (
  SELECT series_id, t, price AS y, pred_full AS a, pred_alt AS b, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n
  FROM a5 WHERE (fold IS NULL OR fold < 4) AND price IS NOT NULL AND pred_full IS NOT NULL AND pred_alt IS NOT NULL),
pt AS (SELECT *, CASE WHEN r < n - 3 * (n // 4) THEN -1 ELSE (r - (n - 3 * (n // 4))) // (n // 4) END AS part FROM tr),
mo AS (SELECT i, {_MOMENTS} FROM pt JOIN (SELECT unnest([0, 1, 2]) AS i) ON part < i GROUP BY i),
so AS (SELECT *, {_SOLVED} FROM mo, (SELECT unnest([0, 1, 2]) AS cell, unnest([0.01, 1.0, 100.0]::DOUBLE[]) AS al)) ;;
SELECT cell, i AS fold, avg(abs(y - (my + wa * (a - ma) / sa + wb * (b - mb) / sb))) AS mae, any_value(al) AS alpha FROM so JOIN pt ON part = i GROUP BY 1, 2""",
)

# --- evaluation of folds: two naive rules, and the searched net on both information sets
_SEARCH = partial(linear.profile_search, profile=forecast.LINEAR_PROFILES["v1"])
_NETS = {"net_full": (_SEARCH, FULL), "net_tier1": (_SEARCH, TIER1)}
_NAIVE = {"lag_24": "price_lag_24", "lag_168": "price_lag_168"}
_MODELS = [*_NAIVE, *_NETS]
_FOLDS = (3, 4)


def _predicted(s: SparkSession, d: str, variants: dict = _NETS, folds: tuple[int, ...] = _FOLDS) -> tuple[DataFrame, DataFrame]:
    rows = a8(s, d).select(*ROWS, "price", "fold", "hour_local", *FULL)
    found, chosen = linear.predict_folds(rows, "price", variants, _NAIVE, list(folds), [*ROWS, "hour_local"])
    return saved(found), chosen


def _scores(s: SparkSession, d: str) -> DataFrame:
    return linear.fold_scores(_predicted(s, d)[0], "price", _MODELS)


_SCORES = "fold:i model:s grouping_key:s level:s n:i mae:f rmse:f median_ae:f"
register("ml_fold_scores", _SCORES, _scores)
register("ml_fold_cells", "fold:i model:s parameters:s", lambda s, d: _predicted(s, d)[1])
register(
    "ml_fold_coefficients", "fold:i model:s rank:i feature:s weight:f",
    lambda s, d: _predicted(s, d)[1].select("fold", "model", F.posexplode("coefficients").alias("rank", "c")).select("fold", "model", F.expr("rank + 1").alias("rank"), "c.*"),
)
# the same with boosted trees on both information sets, for the last fold
_TREES = {"trees_full": (boosting.search, FULL), "trees_tier1": (boosting.search, TIER1)}
register("ml_fold_scores_trees", _SCORES, lambda s, d: linear.fold_scores(_predicted(s, d, _NETS | _TREES, (4,))[0], "price", [*_MODELS, *_TREES]))
# which rows all models predict depends on the predictors alone, so that SQL gives the naive rules' scores
register(
    "ml_fold_scores_naive", _SCORES, lambda s, d: _scores(s, d).where(F.col("model").isin(*_NAIVE)),
    f"""{A8},
md AS (SELECT f, median(price) AS c FROM a8 JOIN (SELECT unnest({list(_FOLDS)}) AS f) ON fold IS NULL OR fold < f GROUP BY f),
li AS (SELECT md.f, any_value(c) AS c, quantile_cont(abs(price - c), 0.95) AS l FROM a8 JOIN md ON fold IS NULL OR fold < md.f GROUP BY md.f),
va AS (SELECT a8.*, abs(price - c) > l AS is_extreme FROM a8 JOIN li ON fold = f WHERE {_ALL_THERE}),
k AS (SELECT fold, 'lag_24' AS model, price, price_lag_24 AS p, hour_local, is_extreme FROM va UNION ALL SELECT fold, 'lag_168', price, price_lag_168, hour_local, is_extreme FROM va),
g AS (
  SELECT *, 'overall' AS grouping_key, NULL AS level FROM k UNION ALL SELECT *, 'hour', hour_local::VARCHAR FROM k UNION ALL SELECT *, 'extreme', is_extreme::VARCHAR FROM k
  UNION ALL SELECT *, 'bucket', 'negative' FROM k WHERE price < 0 UNION ALL SELECT *, 'bucket', 'above_200' FROM k WHERE price > 200
  UNION ALL SELECT *, 'bucket', 'above_500' FROM k WHERE price > 500) ;;
SELECT fold, model, grouping_key, level, {_METRIC} FROM g GROUP BY 1, 2, 3, 4""",
)
_TIER1_THERE = " AND ".join(f"{c} IS NOT NULL" for c in TIER1)
register(
    "ml_fold_coverage", "fold:i n_rows:i " + " ".join(f"n_{m}:i" for m in _MODELS) + " n_common:i", lambda s, d: linear.fold_coverage(_predicted(s, d)[0], "price", _MODELS),
    f"""{A8} ;; SELECT fold, count(*) AS n_rows, count(*) FILTER (price IS NOT NULL AND price_lag_24 IS NOT NULL) AS n_lag_24, count(*) FILTER (price IS NOT NULL AND price_lag_168 IS NOT NULL) AS n_lag_168,
  count(*) FILTER ({_ALL_THERE}) AS n_net_full, count(*) FILTER (price IS NOT NULL AND {_TIER1_THERE}) AS n_net_tier1, count(*) FILTER ({_ALL_THERE}) AS n_common
FROM a8 WHERE fold IN (3, 4) GROUP BY fold""",
)

# --- profiles of all windows in one pass
_WINDOWS = list(range(3, 29))
register(
    "ml_trailing_profiles", "series_id:s delivery_date:d hour_local:i window_days:i profile_pred:f", lambda s, d: forecast.trailing_profiles(ad.a1(s, d), "price", _WINDOWS),
    f"""{ad.A1},
r AS (SELECT series_id, {B('t')}::DATE AS day, hour({B('t')}) AS h, price AS v FROM a1),
i AS (SELECT series_id, day, row_number() OVER (PARTITION BY series_id ORDER BY day) AS k FROM (SELECT DISTINCT series_id, day FROM r)) ;;
SELECT b.series_id, b.day AS delivery_date, h AS hour_local, w AS window_days, avg(v) AS profile_pred
FROM r JOIN i a ON a.series_id = r.series_id AND a.day = r.day JOIN (SELECT unnest({_WINDOWS}) AS w) ON true JOIN i b ON b.series_id = a.series_id AND b.k > a.k AND b.k <= a.k + w
GROUP BY ALL""",
)

# --- running values of series of any length, held against the SQL of the plain windows
register_like("win_ffill_long", "win_ffill", lambda s, d: timeseries.carry_forward(saved(timeseries.regularize(ad.a1(s, d))), "price", long=True))
register_like("win_frontier_long", "win_frontier", lambda s, d: more._spans(s, d, long=True))
register_like("rep_cumulative_pnl_long", "rep_cumulative_pnl", lambda s, d: reports.cumulative(saved(ad.a7(s, d)), ["series_id", "strategy"], long=True))
register_like("win_cumulative_drawdown_long", "win_cumulative_drawdown", lambda s, d: reports.drawdown(saved(ad.a7(s, d)), ["series_id", "strategy"], long=True))
register_like("unc_day_safe_quantiles_long", "unc_sequential_update", lambda s, d: uncertainty.day_safe_quantiles_long(ad.a5(s, d).where("fold is not null"), "residual", 7, 1))
register_like("win_residual_quantile_hourly_long", "win_residual_quantile_hourly", lambda s, d: uncertainty.hourly_quantiles_long(saved(ad.a5(s, d)), "residual", 3, 1, prediction="pred_full"))

# --- thresholds that the plain prices never pass: one series three times as high
_HIGH = f"""{ad.A1.replace('a1 AS (', 'a0 AS (', 1)},
a1 AS (SELECT series_id, t, CASE WHEN series_id = 'error' THEN price * 3 ELSE price END AS price FROM a0)"""


def _high(s: SparkSession, d: str) -> DataFrame:
    return ad.a1(s, d).withColumn("price", F.when(F.col("series_id") == "error", F.col("price") * 3).otherwise(F.col("price")))


register_like("fn_conditional_bucket_high", "fn_conditional_bucket", lambda s, d: _high(s, d).withColumns(fn.buckets(F.col("price"))), {ad.A1: _HIGH})
register_like("agg_day_flags_high", "agg_day_flags", lambda s, d: metrics.day_flags(_high(s, d)), {ad.A1: _HIGH})
register_like("agg_count_share_high", "agg_count_share", lambda s, d: metrics.count_share(_high(s, d), ["series_id"]), {ad.A1: _HIGH})
