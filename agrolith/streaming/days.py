"""Streams of environment-days and hours: deduplicated ingest, intervals, nights, runs of stress, running thermal time and soil water."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from agrolith.functions import thermal
from agrolith.operators.hourly import night_id


def day_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 10) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def once_per_day(days: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("env", "date"), late: str = "10 days") -> DataFrame:
    """Each environment-day once, as far back as the watermark reaches."""
    return days.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def interval_means(days: DataFrame, ts: str, value: str, width: str = "3 days", late: str = "1 day") -> DataFrame:
    """(env, start, mean, n) over tumbling windows; a window comes out when the watermark has passed it."""
    grouped = days.withWatermark(ts, late).groupBy("env", F.window(ts, width).alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return grouped.select("env", F.col("w.start").alias("start"), "mean", "n")


def night_means(hours: DataFrame, ts: str, value: str, first: int = 20, last: int = 5, late: str = "1 day") -> DataFrame:
    """(env, night, mean, n) of night hours by the date the night began."""
    hour = F.hour(ts)
    dark = hours.withWatermark(ts, late).where((hour >= first) | (hour <= last))
    shifted = F.window(F.col(ts), "1 day", None, "12 hours")
    out = dark.groupBy("env", shifted.alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select("env", night_id(F.to_date("w.start"), F.hour("w.start")).alias("night"), "mean", "n")


def running_thermal_time(days: DataFrame, base: float, upper: float) -> DataFrame:
    """(env, day, dTT, cumTT) of days (env, day, T2M_MAX, T2M_MIN): the sum so far is the state of an environment.

    Within a batch days are put in order; a day at or before the last one seen is late and dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total = state.get if state.exists else (-(2**31), 0.0)
        rows = pd.concat(list(batches)).sort_values("day")
        rows = rows[rows["day"] > last].drop_duplicates("day")
        if len(rows):
            cum = total + rows["dTT"].cumsum()
            state.update((int(rows["day"].iloc[-1]), float(cum.iloc[-1])))
            yield pd.DataFrame({"env": key[0], "day": rows["day"].astype("int32"), "dTT": rows["dTT"], "cumTT": cum})

    daily = days.select("env", F.col("day").cast("int").alias("day"), F.coalesce(thermal.day_gdd(F.col("T2M_MAX"), F.col("T2M_MIN"), base, upper), F.lit(0.0)).alias("dTT"))
    return daily.groupBy("env").applyInPandasWithState(step, "env string, day int, dTT double, cumTT double", "last int, total double", "append", GroupStateTimeout.NoTimeout)


def stress_runs(days: DataFrame, ts: str, holds: Column, late: str = "1 day") -> DataFrame:
    """(env, first, last, n): runs of consecutive days on which a condition holds, as sessions that a missing day ends."""
    marked = days.withWatermark(ts, late).where(F.coalesce(holds, F.lit(False)))
    runs = marked.groupBy("env", F.session_window(ts, "36 hours").alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return runs.select("env", "first", "last", "n")


def running_water(days: DataFrame, start_depletion: float = 0.0) -> DataFrame:
    """(env, day, ks, drainage, depletion) of days as ``operators.water.daily_demand`` gives them: the depletion is an environment's state.

    Within a batch days are put in order; a day at or before the last one seen is late and dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, before = state.get if state.exists else (-(2**31), start_depletion)
        rows = pd.concat(list(batches)).sort_values("day")
        rows, out = rows[rows["day"] > last].drop_duplicates("day"), []
        for x in rows.itertuples():
            ks = 0.0 if x.taw <= 0 else 1.0 if before <= x.raw else max((x.taw - before) / (x.taw - x.raw), 0.0)
            balance = before - x.rain - x.irrigation + ks * x.etc
            before = min(max(balance, 0.0), x.taw)
            out.append((key[0], int(x.day), ks, max(-balance, 0.0), before))
        if out:
            state.update((out[-1][1], float(before)))
            yield pd.DataFrame(out, columns=["env", "day", "ks", "drainage", "depletion"]).astype({"day": "int32"})

    kept = days.select("env", F.col("day").cast("int").alias("day"), *[F.col(c).cast("double").alias(c) for c in ("rain", "irrigation", "etc", "taw", "raw")])
    return kept.groupBy("env").applyInPandasWithState(step, "env string, day int, ks double, drainage double, depletion double", "last int, depletion double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that a stream has for now, as a table below ``path``; a later call with the same path goes on from there."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
