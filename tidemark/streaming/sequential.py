"""Day-safe residual quantiles as a stream: each day's offsets are fixed from earlier days, then the day is added."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.functions.columns import ZONE, local_date
from tidemark.operators.uncertainty import QUANTILES, finite

EPOCH = date(1970, 1, 1)
#: The state of arbitrary stateful operators needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class DailyResiduals(StatefulProcessor):
    """Per series: the residuals of the last ``window`` local days, and the last day that is closed. A day is closed, and
    the next day's offsets given out, when the watermark has passed its end; what comes later for it is left out."""

    def __init__(self, window: int, least: int, quantiles: tuple[float, ...], zone: str):
        self.window, self.least, self.quantiles, self.zone = window, least, quantiles, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "residuals array<double>")
        self.closed = handle.getValueState("closed", "day int")

    def end_of(self, day: int) -> int:
        """The instant at which a local day ends, in milliseconds."""
        return int(datetime.combine(EPOCH + timedelta(days=day + 1), time(), ZoneInfo(self.zone)).timestamp() * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        new: dict[int, list[float]] = {}
        for part in rows:
            for day, values in part.groupby("day")["residual"]:
                if self.end_of(int(day)) > now:
                    new.setdefault(int(day), []).extend(values.tolist())
        for day, values in new.items():
            if self.days.containsKey((day,)):
                values = [*self.days.getValue((day,))[0], *values]
            else:
                self.handle.registerTimer(self.end_of(day))
            self.days.updateValue((day,), (values,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = {k[0]: list(v[0]) for k, v in self.days.iterator()}
        if not held:
            return
        day = self.closed.get()[0] + 1 if self.closed.exists() else min(held)
        day = max(day, min(held))
        first, out = day, []
        while held and self.end_of(day) <= now:
            known = [held[d] for d in range(day - self.window + 1, day + 1) if d in held]
            if len(known) >= self.least:
                out.append((key[0], EPOCH + timedelta(days=day + 1), *np.quantile(np.concatenate(known), self.quantiles).tolist(), len(known)))
            for old in [d for d in held if d <= day - self.window + 1]:  # of no use to the days that follow
                del held[old]
                self.days.removeKey((old,))
            day += 1
        if day > first:
            self.closed.update((day - 1,))
        if held:  # days without rows are closed too
            self.handle.registerTimer(self.end_of(day))
        if out:
            yield pd.DataFrame(out, columns=["series_id", "delivery_date", *[f"q{round(q * 100)}" for q in self.quantiles], "n_days"])


def sequential_quantiles(
    stream: DataFrame, residual: str, window: int, least: int, quantiles: tuple[float, ...] = QUANTILES, late: str = "2 hours", zone: str = ZONE
) -> DataFrame:
    """uncertainty.day_safe_quantiles() of a stream, day by day: ``series_id, delivery_date, q10, q50, ..., n_days`` of
    each local day D from the finite residuals of days in ``[D - window, D - 1]``, given ``least`` of these with one.

    D's row is given out when the watermark, ``late`` behind the latest row, passes the start of D: rows of D itself
    can't change it. Rows of a batch that starts after the watermark has passed their day's end are left out, those
    before are used whatever their order. State is ``window`` days of each series. The session must use the RocksDB state store (use_rocksdb()).
    """
    day = F.unix_date(local_date(F.col("timestamp_utc"), zone)).alias("day")
    rows = stream.select("series_id", "timestamp_utc", day, finite(residual).alias("residual")).where("residual is not null")
    fields = ", ".join(f"q{round(q * 100)} double" for q in quantiles)
    return rows.withWatermark("timestamp_utc", late).groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=DailyResiduals(window, least, quantiles, zone), outputStructType=StructType.fromDDL(f"series_id string, delivery_date date, {fields}, n_days long"),
        outputMode="Append", timeMode="EventTime",
    )


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(*STORE)
