"""Recurrences over days that arrive in any order: state by day, and timers that fire when the watermark has passed a day.

An environment's days wait in a map until the watermark passes their end; then they come out in order, and what the recurrence has
reached is carried on. So any order of arrival within the watermark gives what a batch job over all days gives. With ``provisional`` every
arrival also gives, at once, the days from the earliest new one on, marked as not final: a late day is replayed with all after it.
A day more than ``idle`` days after the one before starts anew, and the state of an environment goes when the watermark is that far.

Defined results: days without a date are left out; of one day's rows the last to arrive counts until it is final; rows of a day that is final, or beyond the
watermark, are dropped; null inputs count as 0; a null environment is one of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from agrolith.functions import thermal

_DAY_MS = 86_400_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timed_state(spark: SparkSession):
    """A session whose streams may use maps and timers in their state; the setting is put back at the end of the block."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield spark
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


@dataclass(frozen=True)
class Recurrence:
    """``step(reached, inputs)`` gives what is reached after a day, and the day's outputs."""

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    start: float
    step: Callable[[float, Sequence[float]], tuple[float, tuple[float, ...]]]


def _thermal_step(total: float, x: Sequence[float]) -> tuple[float, tuple[float, ...]]:
    return total + x[0], (x[0], total + x[0])


def _water_step(before: float, x: Sequence[float]) -> tuple[float, tuple[float, ...]]:
    rain, irrigation, etc, taw, raw = x
    ks = 0.0 if taw <= 0 else 1.0 if before <= raw else max((taw - before) / (taw - raw), 0.0)
    balance = before - rain - irrigation + ks * etc
    after = min(max(balance, 0.0), taw)
    return after, (ks, max(-balance, 0.0), after)


class _InOrder(StatefulProcessor):
    def __init__(self, recurrence: Recurrence, idle: int, provisional: bool):
        self.recurrence, self.idle, self.provisional = recurrence, idle, provisional

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day int", ", ".join(f"x{i} double" for i in range(len(self.recurrence.inputs))))
        self.reached = handle.getValueState("reached", "day int, value double")

    def _state(self) -> tuple[int, float]:
        return tuple(self.reached.get()) if self.reached.exists() else (-(2**31), self.recurrence.start)

    def _from(self, days: list[tuple[int, tuple]], done: int, value: float) -> tuple[float, list[tuple]]:
        out = []
        for day, x in days:
            value, own = self.recurrence.step(self.recurrence.start if day - done > self.idle else value, x)
            out.append((day, *own))
            done = day
        return value, out

    def _frame(self, key: tuple, rows: list[tuple], final: bool) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["day", *self.recurrence.outputs]).astype({"day": "int32"})
        out.insert(0, "env", pd.Series([key[0]] * len(rows), dtype=object))
        return out.assign(final=final)

    def _held(self) -> list[tuple[int, tuple]]:
        return sorted((int(k[0]), tuple(v)) for k, v in self.waiting.iterator())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, value = self._state()
        first = None
        for batch in rows:
            for day, *x in batch[["day", *self.recurrence.inputs]].itertuples(index=False):
                day = int(day)
                if day <= done:
                    continue
                self.waiting.updateValue((day,), tuple(0.0 if pd.isna(v) else float(v) for v in x))
                self.handle.registerTimer((day + 1) * _DAY_MS)
                self.handle.registerTimer((day + 1 + self.idle) * _DAY_MS)
                first = day if first is None else min(first, day)
        if self.provisional and first is not None:
            out = [r for r in self._from(self._held(), done, value)[1] if r[0] >= first]
            yield self._frame(key, out, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() // _DAY_MS
        done, value = self._state()
        held = self._held()
        ready = [(day, x) for day, x in held if day < passed]
        if ready:
            value, out = self._from(ready, done, value)
            done = ready[-1][0]
            for day, _ in ready:
                self.waiting.removeKey((day,))
            self.reached.update((done, value))
            yield self._frame(key, out, True)
        if done + 1 + self.idle <= passed:  # whatever waits is of a later season
            self.reached.clear()

    def close(self) -> None:
        pass


def in_order(days: DataFrame, recurrence: Recurrence, late: str = "10 days", idle: int = 365, provisional: bool = False) -> DataFrame:
    """(env, day, outputs..., final) of a stream (env, date, inputs...); day is the number of days since 1970-01-01. Start it inside ``timed_state``."""
    rows = days.where("date IS NOT NULL").select("env", F.col("date").cast("timestamp").alias("_ts"), F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), *[F.col(c).cast("double").alias(c) for c in recurrence.inputs])
    schema = ", ".join(["env string", "day int", *[f"{c} double" for c in recurrence.outputs], "final boolean"])
    grouped = rows.withWatermark("_ts", late).groupBy("env")
    return grouped.transformWithStateInPandas(_InOrder(recurrence, idle, provisional), schema, "Update" if provisional else "Append", "EventTime")


def thermal_time(days: DataFrame, base: float, upper: float, **how) -> DataFrame:
    """(env, day, dTT, cumTT, final) of days (env, date, T2M_MAX, T2M_MIN)."""
    daily = days.select("env", "date", thermal.day_gdd(F.col("T2M_MAX"), F.col("T2M_MIN"), base, upper).alias("gdd"))
    return in_order(daily, Recurrence(("gdd",), ("dTT", "cumTT"), 0.0, _thermal_step), **how)


def soil_water(days: DataFrame, start_depletion: float = 0.0, **how) -> DataFrame:
    """(env, day, ks, drainage, depletion, final) of days (env, date) with the columns of ``operators.water.daily_demand``."""
    return in_order(days, Recurrence(("rain", "irrigation", "etc", "taw", "raw"), ("ks", "drainage", "depletion"), start_depletion, _water_step), **how)
