"""Hourly weather to days, with day, night and pre-dawn parts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.functions import moisture, solar
from agrolith.schema import require


def hour_window(first: int, last: int) -> list[int]:
    """Hours from first to last, past midnight if last is smaller."""
    return [h % 24 for h in range(first, last + 1 + (24 if last < first else 0))]


def is_radiation(name: str) -> bool:
    return bool(re.search(r"SW_|LW_|PAR|UVA|UVB|RADIATION|SRAD", name, re.IGNORECASE))


def night_id(date: Column, hour: Column) -> Column:
    """The date on which a night begins: evening hours belong to their own date, morning hours to the date before."""
    return F.when(hour >= 12, date).otherwise(F.date_sub(date, 1))


def night_flag(df: DataFrame, how: str = "solar", hours: Sequence[int] = (), date: str = "date", hour: str = "hour", lat: str = "LAT", radiation: str = "ALLSKY_SFC_SW_DWN") -> Column:
    """Whether an hour is night: by the length of day around noon, by fixed hours, or by the absence of radiation."""
    if how == "solar":
        half = solar.daylength(F.dayofyear(date), F.col(lat)) / 2
        return ~((F.col(hour) >= 12 - half) & (F.col(hour) < 12 + half))
    if how == "fixed":
        return F.col(hour).isin(list(hours))
    if how == "radiation":
        return F.coalesce(F.col(radiation) <= 0, F.lit(False))
    raise ValueError(f"unknown definition of night {how}")


def daily_from_hourly(df: DataFrame, variables: Sequence[str], night: Column, predawn: Sequence[int] = (2, 3, 4, 5), env: str = "env", date: str = "date", hour: str = "hour", temperature: str = "T2M", dew: str = "T2MDEW", thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """One row for each environment and date: day and night statistics, pre-dawn means, vapour deficit, range, hours above thresholds.

    Day rows meet on the date, night rows on the date the night began. An hour that is night on any date of an environment
    belongs to a night on every date, so it can count for both parts. Radiation has no night part. Deviations need two rows.
    """
    require(df, [env, date, hour, *variables])
    rows = df.withColumn("_night", night)
    dark = rows.where("_night").select(F.col(env).alias("_e"), F.col(hour).alias("_h")).distinct()
    pooled = rows.join(dark, (F.col(env) == F.col("_e")) & (F.col(hour) == F.col("_h")), "left_semi").withColumn("_night_id", night_id(F.col(date), F.col(hour)))
    quiet = [v for v in variables if not is_radiation(v)]
    deficit = None
    if temperature in df.columns and dew in df.columns:
        gap = moisture.saturation_pressure(F.col(temperature), moisture.HOURLY_ES0) - moisture.saturation_pressure(F.col(dew), moisture.HOURLY_ES0)
        deficit = F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0)))
    four = lambda v, part: [f(F.col(v)).alias(f"{v}_{part}_{n}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("sd", F.stddev_samp))]
    early = F.col(hour).isin(list(predawn))

    day_aggs = [a for v in variables for a in four(v, "day")] + [F.count("*").alias("day_hours")]
    night_aggs = [a for v in quiet for a in four(v, "night")] + [F.count("*").alias("night_hours"), (F.count_if(F.col(hour) >= 12) > 0).alias("_evening"), (F.count_if(F.col(hour) < 12) > 0).alias("_morning")]
    night_aggs += [F.avg(F.when(early, F.col(v))).alias(f"{v}_predawn_mean") for v in quiet]
    if deficit is not None:
        day_aggs.append(F.avg(deficit).alias("VPD_day_mean"))
        night_aggs += [F.avg(deficit).alias("VPD_night_mean"), F.avg(F.when(early, deficit)).alias("VPD_predawn_mean")]
    for v, limit in (thresholds or {}).items():
        night_aggs.append(F.count_if(F.col(v) > limit).alias(f"hours_above_{v}"))
    keys = [F.col(env).alias("env"), F.col(date).alias("date")]
    whole = rows.groupBy(*keys).agg(*([(F.max(temperature) - F.min(temperature)).alias("DTR")] if temperature in df.columns else [F.count("*").alias("hours")]))
    by_day = rows.where(~F.col("_night")).groupBy(*keys).agg(*day_aggs)
    by_night = pooled.groupBy(F.col(env).alias("env"), F.col("_night_id").alias("date")).agg(*night_aggs).withColumn("night_complete", F.col("_evening") & F.col("_morning")).drop("_evening", "_morning")
    out = whole.join(by_day, ["env", "date"], "left").join(by_night, ["env", "date"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("day_hours", "night_hours")}).withColumn("night_complete", F.coalesce("night_complete", F.lit(False)))
