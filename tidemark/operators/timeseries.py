"""Operators on hourly series keyed by ``series_id, timestamp_utc``. Order matters only within a
series (or a series and day), which is what windows are partitioned by; a lag is a one-point window frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ZONE, cyclic, local_date, local_midnight, local_time, share_of

from . import scan

KEY = ["series_id", "timestamp_utc"]


def seconds(c: str | Column) -> Column:
    return F.unix_timestamp(c) if isinstance(c, str) else c.cast("long")


def add_local_columns(df: DataFrame, zone: str = ZONE) -> DataFrame:
    """Local timestamp, delivery date, hour, Monday-based weekday, month and weekend flag."""
    local = local_time(F.col("timestamp_utc"), zone)
    return df.withColumns({
        "delivery_timestamp_local": local, "delivery_date": F.to_date(local), "hour_local": F.hour(local),
        "dow_local": F.weekday(local), "month_local": F.month(local), "weekend": (F.weekday(local) >= 5).cast("int"),
    })


#: Share of rows that may repeat a key before that is taken for a missing selection.
MOST_DUPLICATES = 0.01


def one_of_copies(df: DataFrame, number: str) -> DataFrame:
    """Of rows that are alike in all columns but ``number``, the one with the lowest. A reading that was delivered several times
    is no second product: with its copies gone, what still repeats a key is what dedupe() must judge."""
    return df.groupBy(*[c for c in df.columns if c != number]).agg(F.min(number).alias(number)).select(*df.columns)


def dedupe(df: DataFrame, keys: list[str], order: list[Column], most: float | None = MOST_DUPLICATES) -> DataFrame:
    """The first row of each key in the given order. If more than the share ``most`` of all rows repeat a key,
    which is no accident but a selection that is missing, a ValueError; None: whatever their share."""
    if most is not None:
        found = duplicate_fraction(df, keys, most).first()
        if found["too_many"]:
            raise ValueError(f"{found['duplicate_fraction']:.1%} of rows repeat {keys}: select one product first")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def duplicate_fraction(df: DataFrame, keys: list[str], most: float = MOST_DUPLICATES) -> DataFrame:
    """``n_rows, n_keys, duplicate_fraction, too_many``: a row; no fraction, and not too many, of no rows."""
    per = df.groupBy(*keys).count()
    share = 1 - F.count("*") / F.sum("count")
    return per.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), share.alias("duplicate_fraction"), F.coalesce(share > most, F.lit(False)).alias("too_many"))


def regularize(df: DataFrame, step: str = "1 hour") -> DataFrame:
    """``df``, whose times are whole steps apart, on a gap-free grid between each series' first and last time:
    null rows where it has none. Each row fills the gap up to the next one, so that the table is read once
    and stays partitioned by series for what follows."""
    one, ts = F.expr(f"interval {step}"), F.col("timestamp_utc")
    until = F.greatest(ts, F.lead(ts).over(Window.partitionBy("series_id").orderBy("timestamp_utc")) - one)
    filled = df.withColumn("__until", F.coalesce(until, ts)).select("*", F.posexplode(F.sequence(ts, F.col("__until"), one)).alias("__n", "__at"))
    rest = [F.when(F.col("__n") == 0, F.col(c)).alias(c) for c in df.columns if c not in KEY]
    return filled.select("series_id", F.col("__at").alias("timestamp_utc"), *rest)


def resample_hourly(df: DataFrame, value: str, others: tuple[str, ...] = ()) -> DataFrame:
    """Hourly mean of ``value`` (null values left out) and the first value of the others that is not
    null; hours without a row appear as null."""
    hourly = df.withColumn("__at", F.col("timestamp_utc")).withColumn("timestamp_utc", F.date_trunc("hour", "timestamp_utc"))
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c) for c in others]
    return regularize(hourly.groupBy(*KEY).agg(F.avg(value).alias(value), *firsts))


def resample_after(df: DataFrame, value: str, cutover: Column) -> DataFrame:
    """Rows before ``cutover`` as they are, hourly means from it on."""
    before = df.where(F.col("timestamp_utc") < cutover).select(*KEY, value)
    return before.unionByName(resample_hourly(df.where(F.col("timestamp_utc") >= cutover), value))


def coverage_gaps(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Hours of ``[start, end)`` that a series lacks."""
    hours = df.select("series_id").distinct().select("series_id", F.explode(F.sequence(start, end - F.expr("interval 1 hour"), F.expr("interval 1 hour"))).alias("timestamp_utc"))
    return hours.join(df, KEY, "left_anti")


def clip_range(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.where((F.col("timestamp_utc") >= start) & (F.col("timestamp_utc") < end))


def carry_forward(df: DataFrame, value: str, long: bool = False) -> DataFrame:
    """The last value up to each row; with ``long`` a series is cut over many tasks (see scan)."""
    if long:
        made = scan.with_prefix(df, ["series_id"], ["timestamp_utc"], {"__last": scan.last_value(value, ["timestamp_utc"])})
        return made.withColumn(value, F.col("__last")).drop("__last")
    w = Window.partitionBy("series_id").orderBy("timestamp_utc").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def unsafe_at(hours: int, zone: str = ZONE) -> Column:
    """Whether the instant ``hours`` before a row is not on an earlier local date, as on days of 25 hours."""
    return local_date(F.col("timestamp_utc") - F.expr(f"interval {hours} hours"), zone) >= local_date(F.col("timestamp_utc"), zone)


def safe_lag(df: DataFrame, value: str, hours: int, name: str, zone: str = ZONE) -> DataFrame:
    """``value`` as of ``hours`` before (of several rows at that instant the first), null where that instant
    is not on an earlier local date. A window over the series, with or without gaps, so that several lags
    and rolling statistics share one exchange."""
    if hours < 24:
        raise ValueError("a lag under 24 hours can read the day that is decided on")
    then = Window.partitionBy("series_id").orderBy(seconds("timestamp_utc")).rangeBetween(-hours * 3600, -hours * 3600)
    return df.withColumn(name, F.when(~unsafe_at(hours, zone), F.first(value).over(then)))


def rolling_stats(df: DataFrame, lagged: str, hours: int, prefix: str, lag: int = 24, zone: str = ZONE) -> DataFrame:
    """Mean and sample deviation over the last ``hours`` of a column that safe_lag() made with ``lag``; null
    under 80 % of values, and on rows whose own lag is unsafe. A row whose own lag is merely missing has them."""
    w = Window.partitionBy("series_id").orderBy(seconds("timestamp_utc")).rangeBetween(-(hours - 1) * 3600, 0)
    enough = (F.count(lagged).over(w) >= max(1, int(0.8 * hours))) & ~unsafe_at(lag, zone)
    return df.withColumns({
        f"{prefix}_mean": F.when(enough, F.avg(lagged).over(w)), f"{prefix}_std": F.when(enough, F.stddev_samp(lagged).over(w)),
    })


def in_buckets(df: DataFrame, days: int, lookback_hours: int, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``f(df)`` for an ``f`` that makes windows over series and looks back ``lookback_hours`` at most, with each
    series cut into buckets of ``days``: for series too long for a task. Rows are sent to the buckets that may
    look back to them, and each bucket's own rows are kept. Within ``f`` series_id is a struct of the series and
    its bucket."""
    size, at = days * 86400, seconds("timestamp_utc")
    if not 0 <= lookback_hours * 3600 <= size:
        raise ValueError("a bucket must be as long as the time looked back")
    spread = df.withColumn("__bucket", F.explode(F.sequence(F.floor(at / size), F.floor((at + lookback_hours * 3600) / size))))
    keyed = spread.withColumn("series_id", F.struct(F.col("series_id").alias("id"), F.col("__bucket").alias("bucket"))).drop("__bucket")
    return f(keyed).where(F.col("series_id.bucket") == F.floor(at / size)).withColumn("series_id", F.col("series_id.id"))


def interval_position(df: DataFrame, minutes: int = 15, zone: str = ZONE) -> DataFrame:
    """1-based position in the local day by elapsed minutes, so that a gap shifts nothing."""
    start = local_midnight(local_date(F.col("timestamp_utc"), zone), zone)
    return df.withColumn("position", ((seconds("timestamp_utc") - F.unix_timestamp(start)) / (60 * minutes) + 1).cast("int"))


def dst_days(df: DataFrame, zone: str = ZONE) -> DataFrame:
    """Local dates on which more than one offset from UTC holds."""
    local = local_time(F.col("timestamp_utc"), zone)
    offset = F.unix_timestamp(local) - seconds("timestamp_utc")
    return df.groupBy(F.to_date(local).alias("delivery_date")).agg(F.count_distinct(offset).alias("offsets"), F.count_distinct("timestamp_utc").alias("hours")).where("offsets > 1")


def chunk_windows(bounds: DataFrame, days: int) -> DataFrame:
    """``[start, end)`` rows cut into windows of at most ``days`` days."""
    cut = bounds.select("end", F.explode(F.sequence("start", F.col("end") - F.expr("interval 1 second"), F.expr(f"interval {days} days"))).alias("chunk_start"))
    return cut.select("chunk_start", F.least(F.col("chunk_start") + F.expr(f"interval {days} days"), "end").alias("chunk_end"))


def regime_flag(df: DataFrame, cutover: Column, name: str = "post") -> DataFrame:
    """1 from ``cutover`` on, 0 before."""
    return df.withColumn(name, (F.col("timestamp_utc") >= cutover).cast("int"))


def outer_merge(sides: dict[str, DataFrame], value: str = "price") -> DataFrame:
    """One row for each ``timestamp_utc`` of any side with each side's ``value`` under its name. One grouping, not
    a chain of joins: each side has a row a time (of several the mean)."""
    long = None
    for name, df in sides.items():
        one = df.select("timestamp_utc", F.lit(name).alias("side"), F.col(value).alias("v"))
        long = one if long is None else long.unionByName(one)
    return long.groupBy("timestamp_utc").agg(*[F.avg(F.when(F.col("side") == n, F.col("v"))).alias(n) for n in sides])


def pivot_types(df: DataFrame, types: list[str], value: str = "value", kind: str = "type") -> DataFrame:
    """A column for each of ``types`` (null where a time has none); a ValueError if a time has a type twice."""
    wide = df.groupBy("timestamp_utc").pivot(kind, types)
    twice = df.where(F.col(kind).isin(types)).groupBy("timestamp_utc", kind).count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"{twice[0]['timestamp_utc']} has {twice[0][kind]} {twice[0]['count']} times")
    return wide.agg(F.first(value))


def build_clean(raw: dict[str, DataFrame], price: str, cutover: Column, start: Column, end: Column, most: float | None = MOST_DUPLICATES) -> DataFrame:
    """The clean hourly table of several sources (``timestamp_utc, value``, and ``order`` which decides between
    rows of one time): deduplicated; hourly means, of ``price`` only from ``cutover`` on, so its earlier rows
    pass as they are; merged on time; flagged, clipped to ``[start, end)`` and with local time."""
    clean = {}
    for name, df in raw.items():
        one = dedupe(df.withColumn("series_id", F.lit(name)), KEY, [F.col("order")], most)
        clean[name] = resample_after(one, "value", cutover) if name == price else resample_hourly(one.select(*KEY, "value"), "value")
    return add_local_columns(clip_range(regime_flag(outer_merge(clean, "value"), cutover), start, end))


def cleaning_report(raw: dict[str, DataFrame], clean: DataFrame) -> DataFrame:
    """``dataset, n_raw, n_keys, n_duplicates, n_clean, n_missing``: rows of each source as read and its distinct
    times, and how many rows of ``clean`` have it and lack it."""
    out = None
    for name, df in raw.items():
        one = df.agg(F.count("*").alias("n_raw"), F.count_distinct("timestamp_utc").alias("n_keys")).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    counts = clean.agg(*[F.count(c).alias(c) for c in raw], F.count("*").alias("__all"))
    left = counts.unpivot(["__all"], list(raw), "dataset", "n_clean")
    return out.join(left, "dataset").select("dataset", "n_raw", "n_keys", (F.col("n_raw") - F.col("n_keys")).alias("n_duplicates"), "n_clean", (F.col("__all") - F.col("n_clean")).alias("n_missing"))


def fundamentals(df: DataFrame, load: str = "load_mw", wind: tuple[str, str] = ("wind_on_mw", "wind_off_mw"), solar: str = "solar_mw") -> DataFrame:
    """``wind_total`` (null if either part is), ``solar_filled`` (null is 0), ``residual_load``, and
    ``renewable_share`` of the load (null unless that is above 0)."""
    out = df.withColumns({"wind_total": F.col(wind[0]) + F.col(wind[1]), "solar_filled": F.coalesce(solar, F.lit(0.0))})
    green = F.col("wind_total") + F.col("solar_filled")
    return out.withColumns({"residual_load": F.col(load) - F.col("wind_total") - F.col("solar_filled"), "renewable_share": share_of(green, F.col(load))})


def calendar_terms(df: DataFrame) -> DataFrame:
    """Sine and cosine of local hour, weekday and month, and of the hour on weekends alone; ``df`` has the columns
    of add_local_columns()."""
    out = {}
    for name, column, period in (("hour", "hour_local", 24), ("dow", "dow_local", 7), ("month", "month_local", 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(F.col(column), period)
    made = df.withColumns(out)
    return made.withColumns({f"weekend_hour_{f}": F.col("weekend") * F.col(f"hour_{f}") for f in ("sin", "cos")})


def build_features(df: DataFrame, value: str = "price") -> DataFrame:
    """Gap-free grid, local calendar and its terms, safe lags and rolling statistics."""
    out = calendar_terms(add_local_columns(regularize(df)))
    for hours in (24, 48, 168):
        out = safe_lag(out, value, hours, f"{value}_lag_{hours}")
    return rolling_stats(rolling_stats(out, f"{value}_lag_24", 24, "roll_24"), f"{value}_lag_24", 168, "roll_168")


def information_set_violations(df: DataFrame, provenance: dict[str, int], zone: str = ZONE) -> DataFrame:
    """Per column: populated rows whose newest source (``provenance`` hours before) is not on an earlier
    local date."""
    day = local_date(F.col("timestamp_utc"), zone)
    bad = [F.sum((F.col(c).isNotNull() & (local_date(F.col("timestamp_utc") - F.expr(f"interval {h} hours"), zone) >= day)).cast("long")).alias(c) for c, h in provenance.items()]
    return df.agg(*bad).unpivot([], list(provenance), "column", "violations")


def information_set_safe(df: DataFrame, provenance: dict[str, int]) -> DataFrame:
    bad = information_set_violations(df, provenance).where("violations > 0").collect()
    if bad:
        raise ValueError(f"columns read the day they describe: {[tuple(r) for r in bad]}")
    return df
