"""Best ordered (buy, sell) pair of each day, what it realizes, and grids of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import degradation_cost

DAY = ["series_id", "delivery_date"]


def positions(df: DataFrame) -> DataFrame:
    """0-based position of each row in its day."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*DAY).orderBy("timestamp_utc")) - 1)


def _complete(required: list[str]) -> Column:
    return F.expr(" and ".join(f"{c} is not null" for c in required))


def common_days(df: DataFrame, required: list[str]) -> DataFrame:
    """Days of which every hour has every required column."""
    return df.groupBy(*DAY).agg(F.bool_and(_complete(required)).alias("ok"), F.count("*").alias("n_hours")).where("ok").drop("ok")


def on_common_days(df: DataFrame, required: list[str]) -> DataFrame:
    """The rows of these days with ``n_hours``; a window over the day, so that the table is read once."""
    day = Window.partitionBy(*DAY)
    return df.withColumns({"n_hours": F.count("*").over(day), "__ok": F.bool_and(_complete(required)).over(day)}).where("__ok").drop("__ok")


def _chosen(top: DataFrame, by: list[str], more: list[str]) -> DataFrame:
    ok = F.col("t.score") > 0
    cells = {"i": -F.col("t.ni"), "j": -F.col("t.nj"), "score": F.col("t.score")} | {c: F.col(f"t.{c}") for c in more}
    return top.select(*by, *[F.when(ok, c).alias(n) for n, c in cells.items()])


def best_pair(rows: DataFrame, by: list[str], eta: str = "eta", cost: str = "cost", price: str | None = None) -> DataFrame:
    """Per group: the pair i < j of the largest ``eta * bid_j - ask_i - cost``, if above 0; ties go to
    the smallest i, then j. ``rows``: the group's columns, ``pos, bid, ask`` and the parameters. A
    running minimum of the ask before j makes it linear in the day's hours. With ``price``, its values at
    i and j come along as ``p_i, p_j``."""
    before = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    paid = [F.col(price).alias("p")] if price else []
    low = F.min(F.struct(F.col("ask"), F.col("pos").alias("i"), *paid)).over(before)
    scored = rows.withColumn("low", low).where("low is not null").withColumn("score", F.col(eta) * F.col("bid") - F.col("low.ask") - F.col(cost))
    prices = [F.col("low.p").alias("p_i"), F.col(price).alias("p_j")] if price else []
    top = scored.groupBy(*by).agg(F.max(F.struct("score", (-F.col("low.i")).alias("ni"), (-F.col("pos")).alias("nj"), *prices)).alias("t"))
    return _chosen(top, by, ["p_i", "p_j"] if price else [])


def best_pair_naive(rows: DataFrame, by: list[str], eta: str = "eta", cost: str = "cost") -> DataFrame:
    """The same by all pairs of a day; to check against."""
    top = all_pairs(rows, by, eta, cost).groupBy(*by).agg(F.max(F.struct("score", (-F.col("i")).alias("ni"), (-F.col("j")).alias("nj"))).alias("t"))
    return _chosen(top, by, [])


def all_pairs(rows: DataFrame, by: list[str], eta: str = "eta", cost: str = "cost") -> DataFrame:
    """``i, j, score`` of all pairs i < j of a group of at most a day's hours."""
    a = rows.select(*by, F.col("pos").alias("i"), "ask")
    b = rows.select(*by, F.col("pos").alias("j"), "bid", F.col(eta).alias("__eta"), F.col(cost).alias("__cost"))
    return a.join(b, by).where("i < j").select(*by, "i", "j", (F.col("__eta") * F.col("bid") - F.col("ask") - F.col("__cost")).alias("score"))


#: Cells of parameters that a backtest takes at most.
MOST_CELLS = 10_000


def cells_of(cells: DataFrame | list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Cells ``(eta, c)`` of a list or of a small table; a ValueError beyond MOST_CELLS."""
    if isinstance(cells, DataFrame):
        cells = [tuple(r) for r in cells.select("eta", "c").limit(MOST_CELLS + 1).collect()]
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of parameters")
    return cells


def backtest(hours: DataFrame, rules: dict[str, tuple[str, str]], cells: DataFrame | list[tuple[float, float]]) -> DataFrame:
    """Every rule (name: bid and ask expression) on every day and cell ``(eta, c)``. S0 never trades;
    ``oracle_pnl`` is that of deciding on realized prices. ``hours`` has ``price`` and what the expressions
    name, on common days only; ``cells`` is a list or small table of parameters. One exchange, by day: sides and
    cells are exploded within it, and a trade's prices come with its pair."""
    placed = positions(hours).withColumn("n_hours", F.count("*").over(Window.partitionBy(*DAY)))
    sides = F.explode(F.array(*[
        F.struct(F.lit(n).alias("strategy"), F.expr(b).cast("double").alias("bid"), F.expr(a).cast("double").alias("ask"))
        for n, (b, a) in {**rules, "oracle": ("price", "price")}.items()
    ])).alias("s")
    table = F.explode(F.array(*[F.struct(F.lit(float(e)).alias("eta"), F.lit(float(c)).alias("c")) for e, c in cells_of(cells)])).alias("x")
    long = placed.select(*DAY, "n_hours", "pos", "price", sides).select(*DAY, "n_hours", "pos", "price", "s.*", table).select(*DAY, "n_hours", "pos", "price", "strategy", "bid", "ask", "x.*")
    by = [*DAY, "n_hours", "strategy", "eta", "c"]
    done = realized(best_pair(long.withColumns({"e": F.col("eta"), "cost": degradation_cost(F.col("c"), F.col("eta"))}), by, "e", "cost", "price"))
    cell = Window.partitionBy(*DAY, "eta", "c")
    found = done.withColumn("oracle_pnl", F.max(F.when(F.col("strategy") == "oracle", F.col("net_pnl"))).over(cell))
    # the oracle's row becomes that of the strategy that never trades
    still = F.col("strategy") == "oracle"
    kept = {"traded": F.lit(False), "i": F.lit(None), "j": F.lit(None), "gross_pnl": F.lit(0.0), "net_pnl": F.lit(0.0), "score": F.lit(None)}
    return found.select(*by[:3], F.when(still, "S0").otherwise(F.col("strategy")).alias("strategy"), "eta", "c", *[F.when(still, v).otherwise(F.col(k)).alias(k) for k, v in kept.items()], "oracle_pnl")


def realized(pairs: DataFrame) -> DataFrame:
    """``pairs`` of best_pair() with prices, as ``traded``, gross ``eta * P_j - P_i`` and net of cost; 0 without a
    trade."""
    traded = F.col("i").isNotNull()
    gross = F.when(traded, F.col("eta") * F.col("p_j") - F.col("p_i")).otherwise(0.0)
    net = F.when(traded, gross - degradation_cost(F.col("c"), F.col("eta"))).otherwise(0.0)
    return pairs.withColumns({"traded": traded, "gross_pnl": gross, "net_pnl": net}).drop("p_i", "p_j")


def invariant_violations(days: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Days whose pair is out of order or whose result is above the oracle's."""
    return days.where(F.expr("i >= j") | (F.col("net_pnl") > F.col("oracle_pnl") + tol))


def input_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Days that have not 23 to 25 hours, or a column that is not finite in all of them."""
    sums = [F.sum((F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))).cast("long")).alias(f"n_{c}") for c in columns]
    short = " or ".join(f"coalesce(n_{c}, 0) < n_hours" for c in columns)
    return df.groupBy(*DAY).agg(F.count("*").alias("n_hours"), *sums).where(f"n_hours not in (23, 24, 25) or {short}")
