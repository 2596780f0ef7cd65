"""Running values over series of any length: a prefix scan in two levels.

Rows are dealt into ranges of (series, order), so that a long series lies in consecutive ranges, each a task. Within a
range the running value is a window; a range's summary is an aggregate; what the ranges before it sum up to comes from a
window over one row a range. The result equals the plain window over the series, wherever the ranges are cut."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.sources.tables import saved


@dataclass
class Prefix:
    """An associative running value. ``running``: of a range's rows up to a row; ``block``: of a whole range, as an
    aggregate; ``before``: of the summaries of earlier ranges; ``join``: of both, the carried one first (null: none)."""

    running: Callable[[WindowSpec], Column]
    block: Column
    before: Callable[[str, WindowSpec], Column]
    join: Callable[[Column, Column], Column]


def running_sum(c: str) -> Prefix:
    """The sum of a column up to a row; null as long as it is."""
    add = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return Prefix(lambda w: F.sum(c).over(w), F.sum(c), lambda b, w: F.sum(b).over(w), add)


def running_max(c: str) -> Prefix:
    return Prefix(lambda w: F.max(c).over(w), F.max(c), lambda b, w: F.max(b).over(w), lambda a, b: F.greatest(a, b))


def last_value(c: str, order: list[str]) -> Prefix:
    """The last value of a column that is not null."""
    newest = F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order)))
    return Prefix(lambda w: F.last(c, ignorenulls=True).over(w), newest, lambda b, w: F.last(b, ignorenulls=True).over(w), lambda a, b: F.coalesce(b, a))


def ranges(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` written with ``__part``, the range of ``by`` and ``order`` that a row lies in. Rows of one place stay together.
    ``df`` is read twice: write what is costly before."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))


def _same(by: list[str]) -> Column:
    out = F.col("__part") == F.col("__part_")
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return out


def with_prefix(df: DataFrame, by: list[str], order: list[str], made: dict[str, Prefix], own: bool = True, parts: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``made``: its running value over the rows of ``by`` up to a row in ``order``, the row
    itself with ``own``, else the rows before it. ``order`` should tell a group's rows apart: of equal places any may
    come first, as in a window. Null values of ``by`` are a group."""
    placed = ranges(df, by, order, parts)
    earlier = Window.partitionBy(*[f"__by{i}" for i in range(len(by))]).orderBy("__part_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__part").alias("__part_")).agg(*[p.block.alias(f"__block_{n}") for n, p in made.items()])
    carried = blocks.withColumns({f"__carry_{n}": p.before(f"__block_{n}", earlier) for n, p in made.items()}).drop(*[f"__block_{n}" for n in made])
    within = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    run = placed.withColumns({f"__run_{n}": p.running(within) for n, p in made.items()}).join(carried, _same(by))
    return run.select(*df.columns, *[p.join(F.col(f"__carry_{n}"), F.col(f"__run_{n}")).alias(n) for n, p in made.items()])


def largest_drop(df: DataFrame, by: list[str], order: list[str], step: str, parts: int | None = None) -> DataFrame:
    """``*by, largest_drop`` of the running sum of ``step`` from its peak, which starts at the first sum. A range sums up to its
    sum, its highest prefix and its largest drop within; the drop into a range is from the highest peak before it."""
    placed = ranges(df.where(F.col(step).isNotNull()), by, order, parts)
    within = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumn("__sum", F.sum(step).over(within)).withColumn("__peak", F.max("__sum").over(within))
    blocks = run.groupBy(*by, "__part").agg(
        F.sum(step).alias("total"), F.max("__sum").alias("top"), F.min("__sum").alias("low"), F.max(F.col("__peak") - F.col("__sum")).alias("drop")
    )
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    based = blocks.withColumn("__base", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))
    peaks = based.withColumn("__before", F.max(F.col("__base") + F.col("top")).over(earlier))
    into = F.col("__before") - (F.col("__base") + F.col("low"))
    return peaks.groupBy(*by).agg(F.greatest(F.max("drop"), F.max(into), F.lit(0.0)).alias("largest_drop"))


def with_average_rank(df: DataFrame, by: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``df`` (written: it is read twice) with the mean place, from 1, of a row's value and its equals in their group. Rows
    are dealt by group, value and a number of their own, so that not even equal values need to meet in one task: of a range
    only its lowest and its highest value can reach into others, and these two are counted across ranges."""
    placed = ranges(df.withColumn("__id", F.monotonically_increasing_id()), by, [value, "__id"], parts).drop("__id")
    within = Window.partitionBy(*by, "__part").orderBy(value)
    local = placed.withColumns({"__less": F.rank().over(within) - 1, "__equal": F.count("*").over(Window.partitionBy(*by, "__part", value))})
    sums = saved(placed.groupBy(*by, "__part", F.col(value).alias("v")).agg(F.count("*").alias("n")))
    ends = sums.groupBy(*by, "__part").agg(F.sum("n").alias("rows"), F.min(F.struct("v", "n")).alias("lo"), F.max(F.struct("v", "n")).alias("hi"))
    along = Window.partitionBy(*by).orderBy("__part")
    ends = ends.withColumn("before", F.coalesce(F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # of an end value: its rows in earlier and in later ranges; one row a range and end
    edge = ends.select(*by, "__part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("e")).select(*by, "__part", "e.v", "e.n")
    same = Window.partitionBy(*by, "v").orderBy("__part")
    edge = edge.withColumns({"earlier": F.coalesce(F.sum("n").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "of_all": F.sum("n").over(Window.partitionBy(*by, "v"))})
    reach = edge.groupBy(*by, "__part").agg(F.min(F.struct("v", "earlier", "of_all")).alias("lo"), F.max(F.struct("v", "earlier", "of_all")).alias("hi"))
    keys = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    starts = ends.select(*keys, F.col("__part").alias("__part_"), F.col("before").alias("__before"))
    reach = reach.select(*by, "__part", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    # one row a range: joined to each other first, then to the rows
    held = starts.join(reach, _same(by)).drop(*by, "__part")
    value_, low, high = F.col(value), F.col("__lo"), F.col("__hi")
    # a range's lowest value starts where it starts in earlier ranges
    first = F.when(value_ == low["v"], F.col("__before") - low["earlier"]).otherwise(F.col("__before") + F.col("__less"))
    total = F.when(value_ == low["v"], low["of_all"]).when(value_ == high["v"], high["of_all"]).otherwise(F.col("__equal"))
    return local.join(held, _same(by)).select(*df.columns, (first + (total + 1) / 2).alias(name))
