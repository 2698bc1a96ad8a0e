"""Daily series under a climate scenario: monthly changes laid on a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.constants import CLIMATE_GAPS, CLIMATE_MODELS, CLIMATE_SCENARIOS, STALE_AFTER_SHIFT
from agrolith.schema import require


def models_for(scenario: str, models: Sequence[str] = CLIMATE_MODELS) -> list[str]:
    """The models of which the archive has a scenario."""
    if scenario not in CLIMATE_SCENARIOS:
        raise ValueError(f"unknown scenario {scenario}")
    return [m for m in models if scenario not in CLIMATE_GAPS.get(m, ())]


def ensemble(monthly: DataFrame) -> DataFrame:
    """(env, month, tmax, tmin, prec): the mean of the models' rows."""
    return monthly.groupBy("env", "month").agg(*[F.avg(c).alias(c) for c in ("tmax", "tmin", "prec")])


def monthly_baseline(daily: DataFrame, date: str = "YYYYMMDD") -> DataFrame:
    """(env, month, tmax, tmin, prec, rows): monthly mean temperatures, the mean over years of monthly rain, and the rows behind them."""
    at = daily.select("env", F.year(date).alias("year"), F.month(date).alias("month"), "T2M_MAX", "T2M_MIN", "PRECTOT")
    years = at.groupBy("env", "month", "year").agg(F.sum("T2M_MAX").alias("sx"), F.count("T2M_MAX").alias("nx"), F.sum("T2M_MIN").alias("sn"), F.count("T2M_MIN").alias("nn"), F.sum("PRECTOT").alias("rain"), F.count("*").alias("rows"))
    return years.groupBy("env", "month").agg(F.try_divide(F.sum("sx"), F.sum("nx")).alias("tmax"), F.try_divide(F.sum("sn"), F.sum("nn")).alias("tmin"), F.avg("rain").alias("prec"), F.sum("rows").alias("rows"))


def climate_scenario(daily: DataFrame, future: DataFrame, precipitation: str = "multiplicative", date: str = "YYYYMMDD") -> DataFrame:
    """The daily baseline moved by the monthly change of (env, month, tmax, tmin, prec): one equi-join on environment and month.

    Rain changes by a ratio (1 where the baseline month has at most 1 mm, at most 5) or by the difference spread over the
    month's rows; the dew point moves with the mean temperature. Columns that no longer hold are dropped.
    """
    if precipitation not in ("multiplicative", "additive"):
        raise ValueError("precipitation is multiplicative or additive")
    require(daily, ["env", date, "T2M_MAX", "T2M_MIN", "PRECTOT"])
    base = monthly_baseline(daily, date)
    ratio = F.when(F.col("b.prec") > 1, F.least(F.greatest(F.col("f.prec") / F.nullif("b.prec", F.lit(0.0)), F.lit(0.0)), F.lit(5.0)))
    change = base.alias("b").join(future.alias("f"), ["env", "month"]).select("env", F.col("month").alias("_month"), (F.col("f.tmax") - F.col("b.tmax")).alias("_dx"), (F.col("f.tmin") - F.col("b.tmin")).alias("_dn"), F.coalesce(ratio, F.lit(1.0)).alias("_ratio"), ((F.col("f.prec") - F.col("b.prec")) / F.greatest("b.rows", F.lit(1))).alias("_add"))
    out = daily.drop(*STALE_AFTER_SHIFT).withColumn("_month", F.month(date)).join(change, ["env", "_month"], "left")
    dx, dn = F.coalesce("_dx", F.lit(0.0)), F.coalesce("_dn", F.lit(0.0))
    rain = F.col("PRECTOT") * F.coalesce("_ratio", F.lit(1.0)) if precipitation == "multiplicative" else F.greatest(F.col("PRECTOT") + F.coalesce("_add", F.lit(0.0)), F.lit(0.0))
    new = {"T2M_MAX": F.col("T2M_MAX") + dx, "T2M_MIN": F.col("T2M_MIN") + dn, "PRECTOT": rain}
    new["T2M"] = (new["T2M_MAX"] + new["T2M_MIN"]) / 2
    if "T2MDEW" in daily.columns:
        new["T2MDEW"] = F.col("T2MDEW") + (dx + dn) / 2
    return out.withColumns(new).drop("_month", "_dx", "_dn", "_ratio", "_add")
