"""Empirical residual intervals that use only earlier local days."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import local_date, winkler
from tidemark.sources.tables import saved

from . import quantiles as exact
from . import scan

QUANTILES = (0.1, 0.5, 0.9)


def finite(c: str) -> Column:
    """A column where it is a finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))


def day_safe_quantiles(df: DataFrame, residual: str, window: int, least: int, quantiles=QUANTILES) -> DataFrame:
    """``series_id, delivery_date, q10, q50, ...``: quantiles of the finite residuals of local days in
    ``[D - window, D - 1]``, given at least ``least`` distinct days with one (null, NaN and infinite ones don't
    count). Each residual is sent to the days that may use it, so this is an equi-grouping, not a range join."""
    rows = df.select("series_id", local_date(F.col("timestamp_utc")).alias("day"), finite(residual).alias("r")).where("r is not null")
    sent = rows.select("series_id", "day", "r", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", window))).alias("delivery_date"))
    made = sent.groupBy("series_id", "delivery_date").agg(F.percentile("r", list(quantiles)).alias("q"), F.count_distinct("day").alias("n_days")).where(F.col("n_days") >= least)
    return made.select("series_id", "delivery_date", *[F.get("q", i).alias(f"q{round(q * 100)}") for i, q in enumerate(quantiles)])


def with_day_safe_quantiles(df: DataFrame, residuals: dict[str, tuple[str, int, int]], quantiles=QUANTILES) -> DataFrame:
    """``df`` with ``delivery_date`` and, for each ``name: (residual, window, least)``, an array ``name`` of the
    quantiles that day_safe_quantiles() gives for the row's day (null without enough days). All are windows over
    the series' days, so that any number of them takes one pass and no join."""
    out = df.withColumn("delivery_date", local_date(F.col("timestamp_utc"))).withColumn("__day", F.unix_date("delivery_date").cast("long"))
    made = {}
    for name, (residual, window, least) in residuals.items():
        w = Window.partitionBy("series_id").orderBy("__day").rangeBetween(-window, -1)
        r = finite(residual)
        days = F.size(F.collect_set(F.when(r.isNotNull(), F.col("__day"))).over(w))
        made[name] = F.when(days >= least, F.percentile(r, F.array(*map(F.lit, quantiles))).over(w))
    return out.withColumns(made).drop("__day")


def with_day_safe_bounds(df: DataFrame, prediction: str, residual: str, window: int, least: int, quantiles=(0.1, 0.9)) -> DataFrame:
    """``df`` with ``delivery_date`` and ``L, U``: the prediction plus its day's first and last quantile."""
    out = with_day_safe_quantiles(df, {"__q": (residual, window, least)}, quantiles)
    return out.withColumns({"L": F.col(prediction) + F.get("__q", 0), "U": F.col(prediction) + F.get("__q", len(quantiles) - 1)}).drop("__q")


def attach_bounds(df: DataFrame, prediction: str, offsets: DataFrame, low: str = "q10", high: str = "q90") -> DataFrame:
    """``df`` with ``L`` and ``U``: the prediction plus its day's offsets, null without any."""
    day = df.withColumn("delivery_date", local_date(F.col("timestamp_utc")))
    return day.join(offsets, ["series_id", "delivery_date"], "left").withColumns({"L": F.col(prediction) + F.col(low), "U": F.col(prediction) + F.col(high)}).drop(*[c for c in offsets.columns if c.startswith("q")])


def hourly_quantiles(df: DataFrame, residual: str, days: int, least_days: int, quantiles=QUANTILES, prediction: str | None = None) -> DataFrame:
    """``q10, q50, ...``: trailing quantiles of the finite residuals over ``[t - days, t)``, added to ``prediction`` if
    given. Null under as many finite residuals as ``least_days`` days have at the series' median gap between rows. A series of one row has
    no gap and no quantile."""
    along = Window.partitionBy("series_id").orderBy("timestamp_utc")
    w = Window.partitionBy("series_id").orderBy(F.unix_timestamp("timestamp_utc")).rangeBetween(-days * 86400, -1)
    gap = (F.unix_timestamp("timestamp_utc") - F.unix_timestamp(F.lag("timestamp_utc").over(along))) / 3600
    out = df.withColumn("__gap", gap).withColumn("__usual", F.median("__gap").over(Window.partitionBy("series_id")))
    least = F.greatest(F.lit(1), F.floor(F.lit(least_days * 24) / F.col("__usual")))
    r = finite(residual)
    q = F.when(F.count(r).over(w) >= least, F.percentile(r, F.array(*map(F.lit, quantiles))).over(w))
    base = F.col(prediction) if prediction else F.lit(0.0)
    return out.withColumn("__q", q).withColumns({f"q{round(p * 100)}": base + F.get("__q", i) for i, p in enumerate(quantiles)}).drop("__gap", "__usual", "__q")


def _sliding(at: np.ndarray, values: np.ndarray, asked: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted values of the places in ``[x - width, x)`` for each x of ``asked``; ``at`` and ``asked`` ascend. Each value is
    put in and taken out once."""
    low, high = np.searchsorted(at, asked - width), np.searchsorted(at, asked)
    held, lo, hi = np.empty(0), 0, 0
    for a, b in zip(low.tolist(), high.tolist()):
        if b > hi:
            new = np.sort(values[hi:b])
            held = np.insert(held, np.searchsorted(held, new), new)
        if a > lo:
            old = np.sort(values[lo:a])
            first = np.searchsorted(held, old)
            held = np.delete(held, first + np.arange(len(old)) - np.searchsorted(old, old))  # equal values one after the other
        lo, hi = max(a, lo), max(b, hi)
        yield held


def _interpolated(held: np.ndarray, quantiles: tuple[float, ...]) -> list[float]:
    place = np.array(quantiles) * (len(held) - 1)
    low = np.floor(place).astype(int)
    a, b = held[low], held[np.ceil(place).astype(int)]
    return (a + (b - a) * (place - low)).tolist()


def day_safe_quantiles_long(df: DataFrame, residual: str, window: int, least: int, quantiles=QUANTILES) -> DataFrame:
    """day_safe_quantiles() for long windows and series: work for each row does not grow with ``window``. Days are cut into
    blocks of ``window`` days; a day's residuals go to the two blocks whose days may use it, and a block's windows are
    one sorted run that each day enters and leaves once. A block holds two windows of one series, whatever its length."""
    rows = df.select("series_id", F.unix_date(local_date(F.col("timestamp_utc"))).alias("day"), finite(residual).alias("r")).where("r is not null")
    days = rows.groupBy("series_id", "day").agg(F.collect_list("r").alias("values"))  # a day's hours
    block = F.explode(F.array_distinct(F.array(F.floor((F.col("day") + 1) / window), F.floor((F.col("day") + window) / window))))
    names = [f"q{round(q * 100)}" for q in quantiles]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("day")
        sizes = part["values"].map(len).to_numpy()
        at, values = np.repeat(part["day"].to_numpy(np.int64), sizes), np.concatenate(part["values"].tolist())
        start = int(part["block"].iloc[0]) * window
        asked = np.arange(max(start, at[0] + 1), min(start + window, at[-1] + window + 1))
        known = part["day"].to_numpy()
        n_days = np.searchsorted(known, asked) - np.searchsorted(known, asked - window)
        out = [(d, *_interpolated(held, quantiles)) for d, n, held in zip(asked.tolist(), n_days.tolist(), _sliding(at, values, asked, window)) if n >= max(least, 1)]
        made = pd.DataFrame(out, columns=["day", *names]).astype({"day": "int32"})
        made.insert(0, "series_id", part["series_id"].iloc[0])
        return made

    made = days.select("*", block.alias("block")).groupBy("series_id", "block").applyInPandas(run, "series_id string, day int, " + ", ".join(f"{n} double" for n in names))
    return made.select("series_id", F.date_from_unix_date("day").alias("delivery_date"), *names)


def hourly_quantiles_long(df: DataFrame, residual: str, days: int, least_days: int, quantiles=QUANTILES, prediction: str | None = None) -> DataFrame:
    """``series_id, timestamp_utc, q10, q50, ...`` of hourly_quantiles() for long windows and series, cut into blocks of ``days``
    days as in day_safe_quantiles_long(); the usual gap between rows is found without a window over the series. ``df``
    is read several times: write what is costly before."""
    at = F.unix_timestamp("timestamp_utc")
    rows = saved(df.select("series_id", "timestamp_utc", at.alias("at"), finite(residual).alias("r"), *([F.col(prediction).alias("p")] if prediction else [F.lit(0.0).alias("p")])))
    gaps = scan.with_prefix(rows, ["series_id"], ["at"], {"before": scan.last_value("at", ["at"])}, own=False).select("series_id", ((F.col("at") - F.col("before")) / 3600).alias("gap"))
    usual = exact.quantiles(saved(gaps), ["series_id"], "gap", {"usual": 0.5}).withColumnRenamed("series_id", "of")
    least = F.greatest(F.lit(1), F.floor(F.lit(least_days * 24) / F.col("usual")))
    width = days * 86400
    # a row asks in its own block, and its residual is of use in that and the next
    own, use = F.floor(F.col("at") / width), F.explode(F.sequence(F.floor((F.col("at") + 1) / width), F.floor((F.col("at") + width) / width)))
    asks = rows.select("series_id", own.alias("block"), "at", "timestamp_utc", "p", F.lit(None).cast("double").alias("r"))
    gives = rows.where("r is not null").select("series_id", use.alias("block"), "at", F.lit(None).cast("timestamp").alias("timestamp_utc"), F.lit(None).cast("double").alias("p"), "r")
    names = [f"q{round(q * 100)}" for q in quantiles]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at", kind="stable")
        asking, giving = part[part["timestamp_utc"].notna()], part[part["timestamp_utc"].isna()]
        held = _sliding(giving["at"].to_numpy(np.int64), giving["r"].to_numpy(), asking["at"].to_numpy(np.int64), width)
        none = [None] * len(quantiles)
        out = [(len(h), *([p + x for x in _interpolated(h, quantiles)] if len(h) else none)) for p, h in zip(asking["p"].tolist(), held)]
        made = pd.DataFrame(out, columns=["n", *names], index=asking.index).astype({n: "float64" for n in names})
        return pd.concat([asking[["series_id", "timestamp_utc"]], made], axis=1)

    schema = "series_id string, timestamp_utc timestamp, n long, " + ", ".join(f"{n} double" for n in names)
    found = asks.unionByName(gives).groupBy("series_id", "block").applyInPandas(run, schema)
    return found.join(usual, F.col("series_id").eqNullSafe(F.col("of")), "left").select(
        "series_id", "timestamp_utc", *[F.when(F.col("n") >= least, F.when(~F.isnan(n), F.col(n))).alias(n) for n in names]
    )


def _scores(a: Column, lo: Column, hi: Column, alpha: float) -> list[Column]:
    return [
        F.count("*").alias("n"), F.avg(((a >= lo) & (a <= hi)).cast("double")).alias("coverage"), F.avg((a < lo).cast("double")).alias("below"),
        F.avg((a > hi).cast("double")).alias("above"), F.avg(hi - lo).alias("width"), F.avg(winkler(a, lo, hi, alpha)).alias("interval_score"),
    ]


def calibration(df: DataFrame, by: list[str], actual: str = "price", low: str = "L", high: str = "U", alpha: float = 0.2) -> DataFrame:
    """Coverage, misses, width and interval score of each group, over rows that have all three values."""
    a, lo, hi = F.col(actual), F.col(low), F.col(high)
    return df.where(a.isNotNull() & lo.isNotNull() & hi.isNotNull()).groupBy(*by).agg(*_scores(a, lo, hi, alpha))


def calibration_sets(df: DataFrame, models: dict[str, tuple[str, str]], keys: dict[str, Column], actual: str = "price", alpha: float = 0.2) -> DataFrame:
    """``model, grouping_key, level`` with the columns of calibration(): overall (level null) and by each of
    ``keys``, for each of ``models (name: lower and upper bound)``, in one scan."""
    sides = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(lo).alias("lo"), F.col(hi).alias("hi")) for m, (lo, hi) in models.items()])).alias("m")
    level = lambda k, c: F.named_struct(F.lit("grouping_key"), F.lit(k), F.lit("level"), c.cast("string"))
    levels = [level("overall", F.lit(None)), *[level(k, c) for k, c in keys.items()]]
    long = df.select(actual, F.array(*levels).alias("levels"), sides).select(actual, "m.*", F.explode("levels").alias("k")).select(actual, "model", "lo", "hi", "k.*")
    return calibration(long, ["model", "grouping_key", "level"], actual, "lo", "hi", alpha)


def rolling_coverage(df: DataFrame, days: int) -> DataFrame:
    """Coverage, width and n over ``(t - days, t]`` for each row with bounds."""
    w = Window.partitionBy("series_id").orderBy(F.unix_timestamp("timestamp_utc")).rangeBetween(-days * 86400 + 1, 0)
    rows = df.where("price is not null and L is not null and U is not null")
    inside = F.expr("cast(price between L and U as double)")
    return rows.select("series_id", "timestamp_utc", F.avg(inside).over(w).alias("coverage"), F.avg(F.col("U") - F.col("L")).over(w).alias("width"), F.count("*").over(w).alias("n"))


def worst_window(rolled: DataFrame) -> DataFrame:
    """Each series' lowest coverage with at least half the largest n; the first on ties."""
    most = rolled.groupBy("series_id").agg(F.max("n").alias("most"))
    ok = rolled.join(most, "series_id").where("n >= most / 2")
    best = F.min_by(F.struct("timestamp_utc", "coverage", "n"), F.struct("coverage", "timestamp_utc")).alias("b")
    return ok.groupBy("series_id").agg(best).select("series_id", "b.timestamp_utc", "b.coverage", "b.n")


def latest_offsets(df: DataFrame, columns: list[str]) -> DataFrame:
    got = df.where(F.col(columns[0]).isNotNull()).groupBy("series_id").agg(F.max_by(F.struct(*columns), "timestamp_utc").alias("o"))
    return got.select("series_id", *[F.col(f"o.{c}").alias(c) for c in columns])


def window_candidates(df: DataFrame, prediction: str, residual: str, windows: list[int], keep: tuple[str, ...] = ("price",)) -> DataFrame:
    """A row for each row of ``df`` and candidate window (least days: a quarter of it, at least 1) with its
    ``window_days, L, U`` (null while it warms up); one pass for all windows."""
    made = with_day_safe_quantiles(df, {f"__q{w}": (residual, w, max(1, w // 4)) for w in windows}, (0.1, 0.9))
    cells = F.explode(F.array(*[F.struct(F.lit(w).alias("window_days"), F.col(f"__q{w}").alias("q")) for w in windows])).alias("x")
    out = made.select("series_id", "timestamp_utc", "delivery_date", *keep, prediction, cells)
    return out.select("series_id", "timestamp_utc", "delivery_date", *keep, prediction, "x.window_days", *[(F.col(prediction) + F.get("x.q", i)).alias(n) for i, n in enumerate("LU")])


def window_scores(candidates: DataFrame, by: tuple[str, ...] = (), start: Column | None = None) -> DataFrame:
    """calibration() of each window with ``n_warmup``, its rows without bounds; of rows from ``start`` on."""
    rows = candidates if start is None else candidates.where(F.col("timestamp_utc") >= start)
    keys = ["window_days", *by]
    lacking = rows.groupBy(*keys).agg(F.sum((F.col("L").isNull() | F.col("U").isNull()).cast("long")).alias("n_warmup"))
    return calibration(rows, keys).join(lacking, keys)


def common_rows(candidates: DataFrame, n: int) -> DataFrame:
    """Candidate rows at the instants at which all ``n`` candidates have bounds."""
    full = candidates.where("L is not null and price is not null").groupBy("series_id", "timestamp_utc").agg(F.count("*").alias("k")).where(F.col("k") == n)
    return candidates.join(full.select("series_id", "timestamp_utc"), ["series_id", "timestamp_utc"], "left_semi")


def common_start(candidates: DataFrame, n_windows: int) -> DataFrame:
    """``window_days, first_valid, common_start``: each window's first bound and the latest of these, from which
    all ``n_windows`` can be compared; null if a window has no bound at all."""
    first = candidates.where("L is not null").groupBy("window_days").agg(F.min("timestamp_utc").alias("first_valid"))
    latest = first.agg(F.when(F.count("*") == n_windows, F.max("first_valid")).alias("common_start"))
    return first.crossJoin(F.broadcast(latest))  # a row


def from_common_start(candidates: DataFrame, n_windows: int) -> DataFrame:
    """The candidate rows from the instant on at which all windows have had their first bounds: all windows are
    scored on the same rows. None if a window has no bound at all."""
    start = common_start(candidates, n_windows).agg(F.max("common_start").alias("__start"))
    return candidates.crossJoin(F.broadcast(start)).where(F.col("timestamp_utc") >= F.col("__start")).drop("__start")  # a row


def select_window(scores: DataFrame) -> DataFrame:
    """``window_days, interval_score``: the window with the lowest score, the smaller on ties, and ``equal_n``:
    whether all windows were scored on as many rows, without which the choice is void."""
    return scores.agg(
        F.min_by("window_days", F.struct("interval_score", "window_days")).alias("window_days"), F.min("interval_score").alias("interval_score"), (F.min("n") == F.max("n")).alias("equal_n")
    )


def off_nominal(scores: DataFrame, nominal: float = 0.8, most: float = 0.03) -> DataFrame:
    """Groups whose coverage is further than ``most`` from ``nominal``, with the distance: told, not acted on."""
    off = F.abs(F.col("coverage") - nominal)
    return scores.withColumn("off", off).where(F.col("off") > most)


def residuals(df: DataFrame, prediction: str, actual: str = "price") -> DataFrame:
    """``df`` with ``residual``, the target less the prediction, on rows that a fold validates."""
    return df.where("fold is not null").withColumn("residual", F.col(actual) - F.col(prediction))
