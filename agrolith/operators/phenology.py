"""Crop growth stages from thermal time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agrolith.constants import PHENOLOGY
from agrolith.functions import bins, solar, thermal
from agrolith.schema import require


def phenology_templates(spark: SparkSession) -> DataFrame:
    rows = [(crop, base, upper, kind, opt, len(stages), list(stages)[-1], float(list(stages.values())[-1]), scale) for crop, (base, upper, kind, opt, stages, scale) in PHENOLOGY.items()]
    return spark.createDataFrame(rows, "crop string, t_base double, t_upper double, day_type string, p_opt double, n_stages int, final_stage string, final_tt double, scale string")


def show_phenology(spark: SparkSession, crop: str | None = None) -> DataFrame:
    """The templates, or one crop's stages with their cumulative thermal time and increments."""
    if crop is None:
        return phenology_templates(spark)
    stages = _template(crop)[4]
    df = spark.createDataFrame([(i + 1, s, float(t)) for i, (s, t) in enumerate(stages.items())], "stage_order int, stage string, cum_tt double")
    before = F.lag("cum_tt", 1, 0.0).over(Window.orderBy("stage_order"))
    return df.withColumn("increment", F.col("cum_tt") - before)


def _template(crop: str):
    if crop not in PHENOLOGY:
        raise ValueError(f"unknown crop {crop}; known are {', '.join(PHENOLOGY)}")
    return PHENOLOGY[crop]


def env_phenology(df: DataFrame, env: str | Sequence[str] = "env", day: str = "daysFromStart", tmax: str = "T2M_MAX", tmin: str = "T2M_MIN", crop: str = "maize", stages: Mapping[str, float] | int | None = None, base: float | None = None, upper: float | None = None, method: str = "gdd", limit: float = 45.0, photoperiod: bool = False, lat: str = "LAT", doy: str = "DOY", sensitivity: float = 0.02, optimum: float | None = None, day_type: str | None = None, planting: int | None = None) -> DataFrame:
    """All columns of the input, and dTT, cumTT, stage, stage_order, dstage (share of the stage that has passed) and stage_day.

    Stages are right-closed bins of the cumulative thermal time of an environment in day order; past the last there is none.
    A number of stages makes equal bins of the greatest cumulative time over all environments. Days before ``planting`` and
    days without temperatures add nothing.
    """
    keys = [env] if isinstance(env, str) else list(env)
    require(df, [*keys, day, tmax, tmin, *([lat, doy] if photoperiod else [])])
    t_base, t_upper, kind, p_opt, known, _ = _template(crop)
    base, upper = t_base if base is None else base, t_upper if upper is None else upper
    a, b = F.col(tmax), F.col(tmin)
    if method == "gdd":
        daily = thermal.day_gdd(a, b, base, upper)
    elif method == "trapezoid":
        daily = thermal.day_trapezoid(a, b, base, upper, limit)
    elif method == "baskerville":
        daily = thermal.day_sine(a, b, base, upper)
    else:
        raise ValueError(f"unknown method {method}")
    daily = F.greatest(F.coalesce(daily, F.lit(0.0)), F.lit(0.0))
    if photoperiod:
        hours = solar.daylength(F.col(doy), F.col(lat))
        daily = daily * thermal.photoperiod_factor(hours, day_type or kind, p_opt if optimum is None else optimum, sensitivity)
    if planting is not None:
        daily = F.when(F.col(day) < planting, 0.0).otherwise(daily)
    running = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("dTT", daily).withColumn("cumTT", F.sum("dTT").over(running))
    if isinstance(stages, int):
        if stages < 2:
            raise ValueError("at least two stages are needed")
        top = out.agg(F.max("cumTT")).first()[0]
        stages = {f"TT{i}": top * i / stages for i in range(1, stages + 1)}
    stages = dict(stages or known)
    ends = [0.0, *map(float, stages.values())]
    if any(x >= y for x, y in zip(ends, ends[1:])):
        raise ValueError("thermal times of stages must be positive and rise")
    number = bins.right_closed(F.col("cumTT"), ends, [str(i) for i in range(1, len(ends))], lowest=True).cast("int")
    low, high = (F.get(F.array(*[F.lit(x) for x in e]), F.col("stage_order") - 1) for e in (ends[:-1], ends[1:]))
    out = out.withColumn("stage_order", number)
    within = Window.partitionBy(*keys, "stage_order").orderBy(day)
    return out.withColumns({"stage": F.get(F.array(*[F.lit(s) for s in stages]), F.col("stage_order") - 1), "dstage": (F.col("cumTT") - low) / (high - low), "stage_day": F.when(F.col("stage_order").isNotNull(), F.row_number().over(within))})


def unfinished(phenology: DataFrame, last_stage: int, env: str = "env") -> DataFrame:
    """Environments that do not reach the last stage."""
    return phenology.groupBy(env).agg(F.max(F.coalesce("stage_order", F.lit(last_stage + 1))).alias("reached")).where(F.col("reached") < last_stage)
