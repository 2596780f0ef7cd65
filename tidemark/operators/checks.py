"""Checks: each gives a table of violations or differences; raise_on() is the thin raising wrapper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ZONE, draw
from tidemark.sources.tables import saved


def raise_on(violations: DataFrame) -> None:
    found = violations.limit(20).collect()
    if found:
        raise ValueError(f"violations: {[r.asDict() for r in found]}")


def conditions(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``rule, violations`` for each rule (an SQL condition that a bad row fulfils) that any row breaks."""
    sums = [F.sum(F.coalesce(F.expr(c), F.lit(False)).cast("long")).alias(n) for n, c in rules.items()]
    return df.agg(*sums).unpivot([], list(rules), "rule", "violations").where("violations > 0")


#: Rules of a table of per-day results; a column that is kept as text is coerced first, so that what is no
#: number or flag shows as such.
_N = {c: f"try_cast({c} as double)" for c in ("n_hours", "i", "j", "net_pnl")}
_FLAG = "try_cast(trim(lower(cast(traded as string))) as boolean)"
BACKTEST_RULES = {
    "null_day": "delivery_date is null",
    "n_hours": f"coalesce({_N['n_hours']} not in (23, 24, 25), true)",
    "traded_no_flag": f"lower(trim(cast(traded as string))) not in ('true', 'false') or traded is null",
    "not_finite": f"coalesce(isnan({_N['net_pnl']}) or abs({_N['net_pnl']}) = double('infinity'), true)",
    "trade_without_pair": f"{_FLAG} and (i is null or j is null)",
    "pair_without_trade": f"not {_FLAG} and (i is not null or j is not null)",
    "pair_no_number": f"{_FLAG} and (i is not null and {_N['i']} is null or j is not null and {_N['j']} is null)",
    "pair_not_whole": f"{_FLAG} and ({_N['i']} % 1 <> 0 or {_N['j']} % 1 <> 0)",
    "order": f"{_FLAG} and {_N['i']} >= {_N['j']}",
    "bounds": f"{_FLAG} and ({_N['i']} < 0 or {_N['j']} >= {_N['n_hours']})",
    "idle_pnl": f"not {_FLAG} and abs({_N['net_pnl']}) > 1e-9",
    "above_oracle": f"abs({_N['net_pnl']}) < double('infinity') and {_N['net_pnl']} > oracle_pnl + 1e-6",
    "s0_trades": f"strategy = 'S0' and ({_FLAG} or {_N['net_pnl']} <> 0)",
}


def backtest_violations(days: DataFrame, keys: tuple[str, ...] = ("series_id", "delivery_date", "strategy")) -> DataFrame:
    """``rule, violations`` of BACKTEST_RULES and ``duplicate_day``: rows beyond the first of a key. No rows, no
    violations."""
    return _with_duplicates(conditions(days, BACKTEST_RULES), days, list(keys))


def pnl_violations(days: DataFrame, boundary: str, keys: tuple[str, ...] = ("series_id", "delivery_date", "strategy")) -> DataFrame:
    """``rule, violations`` of what a risk table must not read: missing or repeated days, days at or after
    ``boundary``, results that are no finite number, and a strategy S0 that earns."""
    rules = {"null_day": BACKTEST_RULES["null_day"], "holdout": f"delivery_date >= date'{boundary}'", "not_finite": BACKTEST_RULES["not_finite"], "s0": f"strategy = 'S0' and {_N['net_pnl']} <> 0"}
    return _with_duplicates(conditions(days, rules), days, list(keys))


def _with_duplicates(found: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    twice = duplicate_keys(rows, keys).agg(F.sum(F.col("n") - 1).alias("violations")).where("violations > 0")
    return found.unionByName(twice.select(F.lit("duplicate_day").alias("rule"), "violations"))


def coverage_violations(df: DataFrame, start: str, end: str, target: str = "price", zone: str = ZONE) -> DataFrame:
    """``series_id, rule, violations`` of a table that must hold each hour of the local days ``[start, end)`` once
    with a finite target: duplicate, missing and extra hours, bad targets, and local days that are missing or
    extra. Series without a fault have no rows."""
    lo, hi = (F.to_utc_timestamp(F.lit(d).cast("timestamp"), zone) for d in (start, end))
    hours = df.select("series_id").distinct().select("series_id", F.explode(F.sequence(lo, hi - F.expr("interval 1 hour"), F.expr("interval 1 hour"))).alias("timestamp_utc"), F.lit(True).alias("__wanted"))
    seen = df.groupBy("series_id", "timestamp_utc").agg(F.count("*").alias("__n"), F.sum(F.when(F.isnan(target) | (F.abs(target) == float("inf")) | F.col(target).isNull(), 1).otherwise(0)).alias("__bad"))
    both = hours.join(seen, ["series_id", "timestamp_utc"], "full").withColumn("__day", F.to_date(F.from_utc_timestamp("timestamp_utc", zone)))
    wanted, found = F.col("__wanted").isNotNull(), F.col("__n").isNotNull()
    # a row a day first, so that days are counted once
    days = both.groupBy("series_id", "__day").agg(
        F.sum(F.coalesce(F.col("__n") - 1, F.lit(0))).alias("duplicate_hours"), F.sum((wanted & ~found).cast("long")).alias("missing_hours"), F.sum((~wanted & found).cast("long")).alias("extra_hours"),
        F.sum(F.coalesce("__bad", F.lit(0))).alias("bad_targets"), F.bool_or(wanted).alias("__w"), F.bool_or(found).alias("__f"),
    )
    rules = ["duplicate_hours", "missing_hours", "extra_hours", "bad_targets", "missing_days", "extra_days"]
    told = days.withColumns({"missing_days": (F.col("__w") & ~F.col("__f")).cast("long"), "extra_days": (~F.col("__w") & F.col("__f")).cast("long")})
    return told.groupBy("series_id").agg(*[F.sum(r).alias(r) for r in rules]).unpivot(["series_id"], rules, "rule", "violations").where("violations > 0")


def artifact_differences(hours: DataFrame, days: DataFrame, grid: DataFrame, tol: float = 1e-6) -> DataFrame:
    """``series_id, rule, n``: days that the hourly and the per-day table don't share, or of which they have unlike
    numbers of hours, and strategies whose total over days differs from that of the grid's same cell by more than
    ``tol``. ``grid``: ``series_id, strategy, net_pnl`` totals of one cell."""
    a = hours.groupBy("series_id", "delivery_date").agg(F.count("*").alias("__a"))
    b = days.select("series_id", "delivery_date", F.col("n_hours").alias("__b")).distinct()
    both = a.join(b, ["series_id", "delivery_date"], "full")
    one_sided = both.where("__a is null or __b is null").groupBy("series_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit("days"))
    unlike = both.where("__a <> __b").groupBy("series_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit("n_hours"))
    totals = days.groupBy("series_id", "strategy").agg(F.sum("net_pnl").alias("__days")).join(grid.select("series_id", "strategy", F.col("net_pnl").alias("__grid")), ["series_id", "strategy"], "full")
    off = totals.where((F.abs(F.col("__days") - F.col("__grid")) > tol) | F.col("__days").isNull() | F.col("__grid").isNull()).groupBy("series_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit("totals"))
    return one_sided.unionByName(unlike).unionByName(off).select("series_id", "rule", "n")


def holdout_rows(df: DataFrame, boundary: Column) -> DataFrame:
    """``series_id, n, first``: rows at or after ``boundary``, where there must be none."""
    return df.where(F.col("timestamp_utc") >= boundary).groupBy("series_id").agg(F.count("*").alias("n"), F.min("timestamp_utc").alias("first"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1").withColumnRenamed("count", "n")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side alone, with the side's name."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def reproduction(recorded: DataFrame, computed: DataFrame, keys: list[str], exact: list[str], close: list[str], tol: float = 1e-9) -> DataFrame:
    """Counts of one-sided rows, unequal exact columns (null-safe) and close columns beyond ``tol``."""
    s = recorded.select(*keys, *[F.col(c).alias(f"s_{c}") for c in exact + close], F.lit(True).alias("in_s"))
    c = computed.select(*keys, *[F.col(x).alias(f"c_{x}") for x in exact + close], F.lit(True).alias("in_c"))
    both = s.join(c, keys, "full")
    paired = F.col("in_s").isNotNull() & F.col("in_c").isNotNull()
    sums = {"only_saved": F.col("in_c").isNull(), "only_computed": F.col("in_s").isNull()}
    sums |= {x: paired & ~F.col(f"s_{x}").eqNullSafe(F.col(f"c_{x}")) for x in exact}
    sums |= {x: paired & (F.col(f"s_{x}").isNull() != F.col(f"c_{x}").isNull()) | (F.abs(F.col(f"s_{x}") - F.col(f"c_{x}")) > tol) for x in close}
    return both.agg(*[F.sum(F.coalesce(v, F.lit(False)).cast("long")).alias(k) for k, v in sums.items()]).unpivot([], list(sums), "field", "mismatches")


def lineage(manifests: DataFrame, expected: DataFrame) -> DataFrame:
    """``run, field`` whose recorded value is not the expected one (null if not recorded)."""
    found = expected.join(manifests.withColumnRenamed("value", "found"), ["run", "field"], "left")
    return found.where(~F.col("value").eqNullSafe(F.col("found"))).select("run", "field", "value", "found")


def fingerprint(df: DataFrame) -> DataFrame:
    """``n, fingerprint``: the count of rows and a sum of their hashes, whatever their order. A row's hash is
    draw() of its columns' texts in the order of their names; null stands for the text "\\N"."""
    h = draw(*[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def availability(df: DataFrame, tiers: dict[str, int], needs: dict[str, list[str]]) -> DataFrame:
    """``column, tier, n_present``: 1 if a column is surely published before the decision, 2 if not. A column
    that is derived (``needs``) has the highest tier of those it needs; n_present: its rows that are not null."""
    known = dict(tiers)
    for name, parts in needs.items():
        known[name] = max(known[c] for c in parts)
    long = df.select(*[F.col(c).isNotNull().cast("long").alias(c) for c in known]).unpivot([], list(known), "column", "present")
    tier = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("column")]
    return long.groupBy("column").agg(F.sum("present").alias("n_present")).withColumn("tier", tier)


def disagreement_dates(rows: DataFrame, dst: DataFrame, most: int) -> DataFrame:
    """At most ``most`` days of each series to look at where two sources disagree: affected days of ``dst``
    (``delivery_date``), first, last, of the largest and of the smallest gap, evenly spaced ones, then by
    gap. ``rows``: ``series_id, delivery_date, abs_diff`` of disagreeing times. Ties go to the earlier day."""
    days = rows.groupBy("series_id", "delivery_date").agg(F.max("abs_diff").alias("gap"))
    by = Window.partitionBy("series_id")
    rank = lambda *order: F.row_number().over(by.orderBy(*order))
    days = days.join(dst.select("delivery_date", F.lit(True).alias("dst")), "delivery_date", "left").withColumns({
        "n": F.count("*").over(by), "up": rank("delivery_date"), "large": rank(F.desc("gap"), "delivery_date"), "small": rank("gap", "delivery_date"),
    })
    slots = F.least(F.lit(most), "n")
    places = F.transform(F.sequence(F.lit(0), slots - 1), lambda i: F.bround(i * (F.col("n") - 1) / (slots - 1)).cast("long"))
    spaced = F.when(slots == 1, F.col("up") - 1 == F.floor(F.col("n") / 2)).otherwise(F.array_contains(places, (F.col("up") - 1).cast("long")))
    rules = {"dst": F.coalesce("dst", F.lit(False)), "first": F.col("up") == 1, "last": F.col("up") == F.col("n"), "largest": F.col("large") == 1, "smallest": F.col("small") == 1, "spaced": spaced}
    reason, priority = F.lit("rest"), F.lit(len(rules))
    for p, (name, holds) in reversed(list(enumerate(rules.items()))):
        reason, priority = F.when(holds, name).otherwise(reason), F.when(holds, p).otherwise(priority)
    placed = days.withColumns({"reason": reason, "priority": priority})
    within = F.when(F.col("priority") == len(rules), F.col("large")).otherwise(F.col("up"))
    return placed.withColumn("within", within).withColumn("rn", rank("priority", "within")).where(F.col("rn") <= most).select("series_id", "delivery_date", "reason")


#: Ranges of keys' hashes whose sums are compared at a time; unequal ranges are cut once more.
RANGES = 4096
#: Unequal parts of ranges that are broadcast at most (8 bytes each).
BROADCAST_PARTS = 1_000_000


def _range_sums(df: DataFrame, at: list[str]) -> DataFrame:
    """Rows and two sums of rows' hashes for each of ``at``: few rows, summed before they are shuffled."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return df.groupBy(*at).agg(F.count("*").alias("n"), wide("__h1").alias("s1"), wide("__h2").alias("s2"))


def _unequal(a: DataFrame, b: DataFrame, at: list[str]) -> DataFrame:
    both = _range_sums(a, at).withColumn("__one", F.lit(1)).unionByName(_range_sums(b, at).withColumn("__one", F.lit(-1)))
    net = both.groupBy(*at).agg(F.sum(F.col("n") * F.col("__one")).alias("n"), *[F.sum(F.col(c) * F.col("__one")).alias(c) for c in ("s1", "s2")])
    return net.where("n <> 0 or s1 <> 0 or s2 <> 0").select(*at)


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], ranges: int = RANGES) -> DataFrame:
    """``*keys, side, columns``: the keys whose rows differ. ``side``: left or right (the key is on that side alone), changed
    (``columns``: the names, sorted, whose values differ), or repeated (a side has the key several times, and the sides differ).

    A hash tree over the keys: sums of rows' hashes of ``ranges`` ranges of keys' hashes are compared first, unequal ranges
    are cut into as many again, and only rows of ranges that still differ are brought together. So equal tables are
    read once and send a row for each range and task; nulls equal nulls, in keys too. Sides must have the same columns and
    types (a ValueError); a difference of which two 64-bit sums are equal would be missed."""
    if sorted(left.dtypes) != sorted(right.dtypes):
        raise ValueError(f"columns differ: {sorted(set(left.dtypes) ^ set(right.dtypes))}")
    columns = sorted(left.columns)
    rest = [c for c in columns if c not in keys]
    key = F.xxhash64(*[F.col(c) for c in sorted(keys)], *[F.col(c).isNull() for c in sorted(keys)])
    row = [*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns]]

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumns({
            "__range": F.pmod(key, F.lit(ranges)).cast("int"), "__part": F.pmod(F.floor(key / ranges), F.lit(ranges)).cast("int"),
            "__h1": F.xxhash64(*row), "__h2": F.xxhash64(F.lit(1), *reversed(row)),
        })

    a, b = hashed(left), hashed(right)
    first = [r[0] for r in _unequal(a, b, ["__range"]).collect()]  # as many as ranges at most
    a, b = (x.where(F.col("__range").isin(first)) for x in (a, b))
    if len(first) > ranges // 2:  # most ranges differ: so would most parts of them
        found_a, found_b = a, b
    else:
        parts = saved(_unequal(a, b, ["__range", "__part"])) if first else None
        if parts is None:
            found_a, found_b = a, b
        else:
            told = F.broadcast(parts) if parts.count() <= BROADCAST_PARTS else parts
            found_a, found_b = (x.join(told, ["__range", "__part"], "left_semi") for x in (a, b))
    value = lambda n: F.max(F.when(F.col("__side") == n, F.struct(*rest))) if rest else F.lit(None)
    count = lambda n: F.count(F.when(F.col("__side") == n, True))
    sums = lambda n: F.sort_array(F.collect_list(F.when(F.col("__side") == n, F.col("__h1"))))
    both = found_a.withColumn("__side", F.lit(0)).unionByName(found_b.withColumn("__side", F.lit(1)))
    met = both.groupBy(*keys).agg(
        count(0).alias("__n0"), count(1).alias("__n1"), sums(0).alias("__r0"), sums(1).alias("__r1"), value(0).alias("__v0"), value(1).alias("__v1"),
    ).where("__r0 <> __r1")
    side = F.when(F.col("__n1") == 0, "left").when(F.col("__n0") == 0, "right").when((F.col("__n0") > 1) | (F.col("__n1") > 1), "repeated").otherwise("changed")
    names = F.array_compact(F.array(*[F.when(~F.col(f"__v0.`{c}`").eqNullSafe(F.col(f"__v1.`{c}`")), F.lit(c)) for c in rest])) if rest else F.array().cast("array<string>")
    return met.select(*keys, side.alias("side"), F.when(side == "changed", names).alias("columns"))
