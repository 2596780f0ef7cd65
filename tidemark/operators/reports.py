"""Report and risk tables over per-day results ``(series_id, delivery_date, strategy, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import draw
from tidemark.sources.tables import saved

from . import scan
from .quantiles import numbered, quantile_of, ranked_values, with_quantiles

DELTAS = [("S2", "S1"), ("S3", "S2"), ("S4", "S2"), ("S5", "S3")]


def primary_table(days: DataFrame, by: list[str]) -> DataFrame:
    """Days traded and idle, totals, mean, median, rates (hit rate: of traded days, null without any) and worst
    day of each strategy. The median is that of few large groups: see quantiles."""
    t = F.col("traded")
    table = days.groupBy(*by).agg(
        F.sum(t.cast("long")).alias("traded_days"), F.sum((~t).cast("long")).alias("idle_days"), F.sum("gross_pnl").alias("gross"), F.sum("net_pnl").alias("net"),
        F.avg("net_pnl").alias("mean_net"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("profitable_rate"),
        F.avg(F.when(t, (F.col("net_pnl") > 0).cast("double"))).alias("hit_rate"), F.min("net_pnl").alias("worst"),
    )
    return with_quantiles(table, days, by, "net_pnl", {"median_net": 0.5})


def backtest_summary(days: DataFrame, by: list[str]) -> DataFrame:
    """Total, trading days and profitable days."""
    return days.groupBy(*by).agg(F.sum("net_pnl").alias("total"), F.sum(F.col("traded").cast("long")).alias("trading_days"), F.sum((F.col("net_pnl") > 0).cast("long")).alias("profitable_days"))


def named_deltas(days: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Totals of the named pairs of strategies, one less the other; ``more``: further aggregates."""
    total = lambda s: F.sum(F.when(F.col("strategy") == s, F.col("net_pnl")).otherwise(0.0))
    return days.groupBy(*by).agg(*more, *[(total(a) - total(b)).alias(f"delta_{a}_{b}") for a, b in DELTAS])


def with_day_flags(days: DataFrame, flags: DataFrame, cutover: str) -> DataFrame:
    """``days`` with the market's flags of their day (metrics.day_flags(): one row a series and day) and ``post``:
    whether the day is at or after ``cutover``. All are of the market, whatever a strategy chose."""
    return days.join(flags, ["series_id", "delivery_date"], "left").withColumn("post", F.col("delivery_date") >= F.lit(cutover).cast("date"))


def split_by_flags(days: DataFrame, flags: list[str]) -> DataFrame:
    """``flag, is_set, n_days`` and the named deltas over days with each flag set and not set, in one scan."""
    long = days.select("series_id", "delivery_date", "strategy", "net_pnl", F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.coalesce(F.col(f), F.lit(False)).alias("is_set")) for f in flags])).alias("x"))
    # each day once for each series; S0 has a row of every day
    n = F.sum((F.col("strategy") == "S0").cast("long")).alias("n_days")
    return named_deltas(long.select("strategy", "net_pnl", "x.*"), ["flag", "is_set"], n)


def value_capture(days: DataFrame, by: list[str]) -> DataFrame:
    o = F.sum("oracle_pnl")
    return days.groupBy(*by).agg(F.sum("net_pnl").alias("net"), o.alias("oracle"), F.when(o > 0, F.sum("net_pnl") / o).alias("capture"))


def drawdown(days: DataFrame, by: list[str], span: int = 5, long: bool = False) -> DataFrame:
    """Largest drop from the running peak (which starts at the first cumulative value), worst day, worst
    full ``span``-day sum (null under ``span`` days). With ``long`` a group is cut over many tasks (see scan)."""
    if long:
        return _long_drawdown(days, by, span)
    along = Window.partitionBy(*by).orderBy("delivery_date")
    run = days.withColumn("cum", F.sum("net_pnl").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    last = along.rowsBetween(-(span - 1), 0)
    run = run.withColumns({"peak": F.max("cum").over(along.rowsBetween(Window.unboundedPreceding, 0)), "sum_span": F.when(F.count("net_pnl").over(last) == span, F.sum("net_pnl").over(last))})
    return run.groupBy(*by).agg(F.max(F.col("peak") - F.col("cum")).alias("max_drawdown"), F.min("net_pnl").alias("worst_day"), F.min("sum_span").alias("worst_span"))


def _long_drawdown(days: DataFrame, by: list[str], span: int) -> DataFrame:
    held = saved(days.select(*by, "delivery_date", "net_pnl"))
    drops = scan.largest_drop(held, by, ["delivery_date"], "net_pnl")
    # a full span's sum is a difference of running sums over numbered days
    one = held.withColumns({"__one": F.lit(1), "__sum": F.coalesce("net_pnl", F.lit(0.0)), "__there": F.col("net_pnl").isNotNull().cast("int")})
    run = saved(scan.with_prefix(one, by, ["delivery_date"], {"__place": scan.running_sum("__one"), "__total": scan.running_sum("__sum"), "__n": scan.running_sum("__there")}))
    then = run.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], (F.col("__place") + span).alias("__at"), F.col("__total").alias("__t0"), F.col("__n").alias("__n0"))
    same = F.col("__place") == F.col("__at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    full = F.col("__n") - F.coalesce("__n0", F.lit(0)) == span
    sums = run.join(then, same, "left").withColumn("__sum_span", F.when((F.col("__place") >= span) & full, F.col("__total") - F.coalesce("__t0", F.lit(0.0))))
    rest = sums.groupBy(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)]).agg(F.min("net_pnl").alias("worst_day"), F.min("__sum_span").alias("worst_span"))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    return drops.join(rest, on).select(*by, F.col("largest_drop").alias("max_drawdown"), "worst_day", "worst_span")


def cumulative(days: DataFrame, by: list[str], long: bool = False) -> DataFrame:
    """The running sum of each group; with ``long`` a group is cut over many tasks (see scan)."""
    if long:
        made = scan.with_prefix(days.select(*by, "delivery_date", "net_pnl"), by, ["delivery_date"], {"cum_pnl": scan.running_sum("net_pnl")})
        return made.select(*by, "delivery_date", "cum_pnl")
    along = Window.partitionBy(*by).orderBy("delivery_date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(*by, "delivery_date", F.sum("net_pnl").over(along).alias("cum_pnl"))


def concentration(days: DataFrame, by: list[str]) -> DataFrame:
    """Sum of the best ceil(n * 1 %, 5 %, 10 %) days and its share of the total, null at or below 0."""
    w = Window.partitionBy(*by).orderBy(F.desc("net_pnl"), "delivery_date")
    ranked = days.withColumns({"rn": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(*by))})
    total = F.sum("net_pnl")
    out = []
    for p in (1, 5, 10):
        top = F.sum(F.when(F.col("rn") <= F.ceil(F.col("n") * p / 100), F.col("net_pnl")).otherwise(0.0))
        out += [top.alias(f"top_{p}"), F.when(total > 0, top / total).alias(f"share_{p}")]
    return ranked.groupBy(*by).agg(total.alias("total"), *out)


#: Categories of a day by whether the point strategy and the uncertainty-aware one traded.
CATEGORIES = ("both_abstain", "point_only", "uncertainty_only", "same_pair", "different_pair")
TOLERANCE = 1e-6


def decompose(days: DataFrame, point: str, uncertain: str, by: list[str]) -> DataFrame:
    """What makes up the difference of two strategies' totals, for each group of ``by`` (``days`` has a row a day
    and strategy in each). Days of each of five categories (``n_...``); profits forgone and losses avoided on days
    that the uncertainty-aware strategy alone leaves out; the effects of choosing another pair, of days that it
    alone trades, and of days of the same pair; the total; and ``reconciles``: whether these add up to it and the
    same pair makes no difference, within 1e-6."""
    keys = [*by, "delivery_date"]
    pick = lambda strategy, tag: days.where(F.col("strategy") == strategy).select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in ("traded", "i", "j", "net_pnl")])
    both = pick(point, "p").join(pick(uncertain, "u"), keys)
    p, u, d = F.col("traded_p"), F.col("traded_u"), F.col("net_pnl_u") - F.col("net_pnl_p")
    same = F.coalesce((F.col("i_p") == F.col("i_u")) & (F.col("j_p") == F.col("j_u")), F.lit(False))
    category = F.when(~p & ~u, CATEGORIES[0]).when(p & ~u, CATEGORIES[1]).when(~p & u, CATEGORIES[2]).when(same, CATEGORIES[3]).otherwise(CATEGORIES[4])
    told = both.withColumns({"category": category, "d": d})
    on = lambda k, v: F.sum(F.when(F.col("category") == k, v).otherwise(0.0))
    n = [F.sum((F.col("category") == k).cast("long")).alias(f"n_{k}") for k in CATEGORIES]
    zero = F.lit(0.0)
    parts = {
        "profits_forgone": on("point_only", F.greatest(F.col("net_pnl_p"), zero)), "losses_avoided": on("point_only", F.greatest(-F.col("net_pnl_p"), zero)),
        "pair_effect": on("different_pair", F.col("d")), "reverse_effect": on("uncertainty_only", F.col("d")), "same_pair_difference": on("same_pair", F.col("d")), "total_gap": F.sum("d"),
    }
    made = told.groupBy(*by).agg(F.count("*").alias("n_days"), *n, *[v.alias(k) for k, v in parts.items()])
    rebuilt = -F.col("profits_forgone") + F.col("losses_avoided") + F.col("pair_effect") + F.col("same_pair_difference") + F.col("reverse_effect")
    return made.withColumn("reconciles", (F.abs(rebuilt - F.col("total_gap")) <= TOLERANCE) & (F.abs("same_pair_difference") <= TOLERANCE))


def losses(days: DataFrame) -> DataFrame:
    """``days`` with ``loss``, the net result turned over."""
    return days.withColumn("loss", -F.col("net_pnl"))


def var_es(days: DataFrame, by: list[str], levels=(0.90, 0.95, 0.99)) -> DataFrame:
    """Loss quantile (interpolated) and the mean of exactly the worst (1 - level) * n losses, the boundary
    one by its fraction; low precision under 20 of them. Equal losses are counted together and ranked without
    bringing a strategy's days into one task: see quantiles."""
    ranks = ranked_values(losses(days), by, "loss")
    made = None
    for level in levels:
        m = (1 - F.lit(level)) * F.col("total")
        worse = F.col("total") - F.col("first") - F.col("n")  # losses above this one
        weight = F.greatest(F.lit(0.0), F.least(F.col("n").cast("double"), m - worse))
        one = F.struct(
            F.lit(level).alias("level"), quantile_of(level).alias("var"), (F.sum(weight * F.col("value")) / F.max(m)).alias("es"), F.max("total").alias("n_total"), F.max(m).alias("n_tail")
        )
        made = [*(made or []), one]
    out = ranks.groupBy(*by).agg(F.array(*made).alias("x")).select(*by, F.explode("x").alias("x")).select(*by, "x.*")
    return out.withColumn("low_precision", F.col("n_tail") < 20)


def descriptive_losses(days: DataFrame, by: list[str]) -> DataFrame:
    rows = losses(days)
    table = rows.groupBy(*by).agg(F.avg("loss").alias("mean_loss"), F.max("loss").alias("worst_loss"), F.min("loss").alias("best_loss"))
    return with_quantiles(table, rows, by, "loss", {"median_loss": 0.5})


def monthly(delta: DataFrame) -> DataFrame:
    """Days and sum of a daily contrast by month."""
    return delta.groupBy(F.date_format("delivery_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("delta").alias("delta"))


def contrast(days: DataFrame, a: str, b: str) -> DataFrame:
    """Daily difference of the totals of strategies a and b."""
    d = F.sum(F.when(F.col("strategy") == a, F.col("net_pnl")).when(F.col("strategy") == b, -F.col("net_pnl")).otherwise(0.0))
    return days.groupBy("delivery_date").agg(d.alias("delta"))


def contrast_stats(delta: DataFrame, tol: float = 1e-9) -> DataFrame:
    d = F.col("delta")
    return delta.agg(
        F.count("*").alias("n"), F.sum(d).alias("total"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.sum((d > tol).cast("long")).alias("wins"),
        F.sum((d < -tol).cast("long")).alias("losses"), F.sum((F.abs(d) <= tol).cast("long")).alias("ties"),
    )


def block_bootstrap(delta: DataFrame, block: int, reps: int, seed: int, levels=(0.025, 0.975)) -> DataFrame:
    """Interval of the total by a circular moving-block bootstrap. Draws come from a hash of seed,
    repetition and block, so a lost task redraws the same. ``delta``: a row for each day."""
    spark: SparkSession = delta.sparkSession
    rows = saved(delta.select("delivery_date", "delta"))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "reps long, low double, high double")
    placed = numbered(rows, "delivery_date", "k")
    ext = placed.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda o: F.pmod(F.col("k") - o, F.lit(n)))).alias("start"), F.col("k").alias("day"), "delta")
    blocks = -(-n // block)
    last = n - block * (blocks - 1)
    offset = F.pmod(F.col("day") - F.col("start"), F.lit(n))
    sums = ext.groupBy("start").agg(F.sum("delta").alias("full"), F.sum(F.when(offset < last, F.col("delta")).otherwise(0.0)).alias("part"))
    draws = spark.range(reps).select("id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk")).withColumn("start", draw(F.lit(seed), F.col("id"), F.col("blk")) % n)
    totals = draws.join(sums, "start").groupBy("id").agg(F.sum(F.when(F.col("blk") == blocks - 1, F.col("part")).otherwise(F.col("full"))).alias("total"))
    # a total for each repetition: their number is the parameter
    return totals.agg(F.count("*").alias("reps"), F.percentile("total", F.lit(levels[0])).alias("low"), F.percentile("total", F.lit(levels[1])).alias("high"))


def threshold_frontier(days: DataFrame, scores: str, taus: list[float], by: list[str], other: str) -> DataFrame:
    """Trades only where the decision score is above each threshold: trades, P&L, hit rate, worst day,
    drawdown (lowest distance from the running peak of the cumulative P&L, 0 or below), and the days that
    strategy ``other`` trades too, that it does not, and that it trades alone. Null scores never trade;
    ``by`` has one row a day."""
    day = Window.partitionBy("series_id", "delivery_date")
    cut = days.withColumn("__other", F.bool_or((F.col("strategy") == other) & F.col("traded")).over(day)).withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    on, too = F.coalesce(F.col(scores) > F.col("tau"), F.lit(False)), F.coalesce("__other", F.lit(False))
    along = Window.partitionBy(*by, "tau").orderBy("delivery_date").rowsBetween(Window.unboundedPreceding, 0)
    run = cut.select(*by, "tau", "delivery_date", "net_pnl", on.alias("on"), too.alias("too"), F.when(on, F.col("net_pnl")).otherwise(0.0).alias("pnl"))
    run = run.withColumn("cum", F.sum("pnl").over(along)).withColumn("peak", F.max("cum").over(along))
    count = lambda c: F.sum(c.cast("long"))
    return run.groupBy(*by, "tau").agg(
        count(F.col("on")).alias("trades"), F.avg(F.when(F.col("on"), (F.col("net_pnl") > 0).cast("double"))).alias("hit_rate"), F.min("pnl").alias("worst"),
        F.min(F.col("cum") - F.col("peak")).alias("max_drawdown"), count(F.col("on") & F.col("too")).alias("overlap"),
        count(F.col("on") & ~F.col("too")).alias("threshold_only"), count(~F.col("on") & F.col("too")).alias("other_only"), F.sum("pnl").alias("pnl"),
    )


def profile_gains(days: DataFrame, windows: dict[str, int], full: str, base: str) -> DataFrame:
    """``window_days, pnl, full_minus, gain, share_of_gain`` of each profile strategy: its P&L, what ``full`` makes
    beyond it, its gain over ``base``, and this as a share of full's gain (null if that is 0)."""
    total = lambda n: F.sum(F.when(F.col("strategy") == n, F.col("net_pnl")))
    cells = F.explode(F.array(*[F.struct(F.lit(w).alias("window_days"), F.col(f"t_{n}").alias("pnl")) for n, w in windows.items()])).alias("x")
    wide = days.agg(*[total(n).alias(f"t_{n}") for n in [*windows, full, base]])
    gain, most = F.col("pnl") - F.col("base"), F.col("full") - F.col("base")
    return wide.select(F.col(f"t_{full}").alias("full"), F.col(f"t_{base}").alias("base"), cells).select("x.*", "full", "base").select(
        "window_days", "pnl", (F.col("full") - F.col("pnl")).alias("full_minus"), gain.alias("gain"), F.when(most != 0, gain / most).alias("share_of_gain"))


def benchmark_summary(errors: DataFrame, days: DataFrame, strategy_of: dict[str, str]) -> DataFrame:
    """``model, mae, rmse, net, capture``: point_metrics() of each model beside the value that the strategy which
    uses it captures (``strategy_of``: strategy by model)."""
    name = F.create_map(*[F.lit(x) for m, s in strategy_of.items() for x in (s, m)])[F.col("strategy")]
    value = value_capture(days.where(F.col("strategy").isin(*strategy_of.values())), ["strategy"]).withColumn("model", name)
    return errors.join(value, "model").select("model", "mae", "rmse", "net", "capture")


def largest_changes(diff: DataFrame, k: int, by: str = "column") -> DataFrame:
    """The ``k`` rows of the largest percentage of each table or column, ties by key order."""
    rest = sorted(c for c in diff.columns if c not in (by, "old", "new", "diff", "pct"))
    return diff.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.abs("pct").desc(), *rest))).where(F.col("rank") <= k)


def table_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Cell-wise old, new, difference and percentage of two tables; unmatched and null cells dropped."""
    values = [c for c in old.columns if c not in keys]
    long = lambda df, n: df.select(*keys, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(keys, values, "column", n)
    both = long(old, "old").join(long(new, "new"), [*keys, "column"]).dropna(subset=["old", "new"])
    diff = F.col("new") - F.col("old")
    return both.withColumns({"diff": diff, "pct": F.when(F.col("old") != 0, diff / F.col("old") * 100)})


def verdict(cells: DataFrame, delta: str, primary: str) -> DataFrame:
    """FAILURE if the primary cell's delta is not above 0, CONFIRMATION if all cells' are, else PARTIAL."""
    p = F.max(F.when(F.expr(primary), F.col(delta)))
    up = F.sum((F.col(delta) > 0).cast("long"))
    return cells.agg(p.alias("primary_delta"), up.alias("positive_cells"), F.count("*").alias("cells")).withColumn(
        "verdict", F.when(F.col("primary_delta") <= 0, "FAILURE").when(F.col("positive_cells") == F.col("cells"), "CONFIRMATION").otherwise("PARTIAL")
    )
