"""Column expressions: local time, labels, coercions, bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"


def local_time(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local_time(ts, zone))


def local_midnight(day: Column, zone: str = ZONE) -> Column:
    """The instant at which a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def decision_cutoff(day: Column, zone: str = ZONE) -> Column:
    """11:45 local time of the day before ``day``, as an instant."""
    return F.to_utc_timestamp((F.date_sub(day, 1).cast("timestamp") + F.expr("interval 11 hours 45 minutes")), zone)


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def share_of(part: Column, whole: Column) -> Column:
    """part / whole, null unless whole is above 0."""
    return F.when(whole > 0, part / whole)


def sign_label(x: Column) -> Column:
    return F.when(x > 0, "+").when(x < 0, "-").when(x == 0, "0")


def bool_coerce(x: Column) -> Column:
    """true/false/1/0 in any case and with blanks around; else null."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def numeric_coerce(x: Column) -> Column:
    """A finite number, else null."""
    n = x.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def classify_match(reference: Column, first: Column, second: Column, tolerance: float) -> Column:
    a = F.coalesce(F.abs(reference - first) <= tolerance, F.lit(False))
    b = F.coalesce(F.abs(reference - second) <= tolerance, F.lit(False))
    return F.when(reference.isNull(), "no_data").when(a & b, "both").when(a, "seq1").when(b, "seq2").otherwise("neither")


def degradation_cost(c: Column, eta: Column) -> Column:
    """Cost of a cycle: c for the unit charged and c for the ``eta`` units discharged."""
    return c * (F.lit(1.0) + eta)


def winkler(actual: Column, low: Column, high: Column, alpha: float) -> Column:
    zero = F.lit(0.0)
    return (high - low) + (F.greatest(low - actual, zero) + F.greatest(actual - high, zero)) * F.lit(2.0 / alpha)


def draw(*cols: Column) -> Column:
    """A whole number from 0 to 2 ** 60 - 1 that depends on the columns' texts alone (from their MD5), so that a lost
    task draws the same again and other engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[c.cast("string") for c in cols])), 1, 15), 16, 10).cast("long")


def display(x: Column, kind: str) -> Column:
    """A number as text of a report: "eur" EUR 1,234.50, "percent" (of 1) 12.3%, "count" 1,234; N/A for null and NaN."""
    text = {
        "eur": lambda: F.concat(F.lit("EUR "), F.format_number(x, 2)), "percent": lambda: F.concat(F.format_number(x * 100, 1), F.lit("%")), "count": lambda: F.format_number(x, 0),
    }[kind]()
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), text).otherwise("N/A")


def buckets(x: Column) -> dict[str, Column]:
    """The stress predicates of a price; null is none of them."""
    tests = {"negative": x < 0, "above_200": x > 200, "above_500": x > 500}
    return {k: F.coalesce(t, F.lit(False)) for k, t in tests.items()}
