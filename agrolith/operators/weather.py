"""Derived weather parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.constants import META_COLUMNS, PROCESSED_COLUMNS
from agrolith.functions import moisture, solar, thermal
from agrolith.operators.ranks import exact_quantiles
from agrolith.schema import require, strip_fill


def _result(df: DataFrame, new: dict[str, Column], merge: bool, keys: Sequence[str]) -> DataFrame:
    if merge:
        return df.withColumns(new)
    return df.select(*[k for k in keys if k in df.columns], *[c.alias(n) for n, c in new.items()])


def param_radiation(df: DataFrame, day_id: str = "DOY", latitude: str = "LAT", radiation: str = "ALLSKY_SFC_SW_DWN", merge: bool = True) -> DataFrame:
    """n_sun (sunshine hours), N (daylight hours), RTA (radiation above the atmosphere).

    A missing radiation counts as the median over all rows, which is found first.
    """
    require(df, [day_id, latitude, radiation])
    middle = exact_quantiles(df, [radiation], (0.5,))[radiation]
    hours, above = solar.daylength(F.col(day_id), F.col(latitude)), solar.extraterrestrial_radiation(F.col(day_id), F.col(latitude))
    share = F.try_divide(F.coalesce(F.col(radiation), F.lit(middle[0] if middle else None).cast("double")), above)
    sunshine = F.when(share.isNotNull(), F.least(F.greatest(hours * share, F.lit(0.0)), hours))
    return _result(df, {"n_sun": sunshine, "N": hours, "RTA": above}, merge, META_COLUMNS)


def param_atmospheric(df: DataFrame, prec: str = "PRECTOT", dew: str = "T2MDEW", tmin: str = "T2M_MIN", tmax: str = "T2M_MAX", radiation: str = "ALLSKY_SFC_SW_DWN", ground: float = 0.0, altitude: float | str = 600.0, alpha: float = 1.26, merge: bool = False) -> DataFrame:
    """VPD (floored at 0), SPV (slope of the saturation curve), ETP (Priestley-Taylor), PETP (rain less ETP)."""
    require(df, [prec, dew, tmin, tmax, radiation, *([altitude] if isinstance(altitude, str) else [])])
    high = F.col(altitude) if isinstance(altitude, str) else F.lit(float(altitude))
    deficit = moisture.vapour_deficit(F.col(tmin), F.col(tmax), F.col(dew))
    slope = moisture.pressure_slope((F.col(tmin) + F.col(tmax)) / 2)
    demand = moisture.priestley_taylor(slope, high, F.col(radiation), F.lit(ground), alpha)
    demand = F.when(F.col(radiation).isNotNull() & slope.isNotNull(), demand)
    return _result(df, {"VPD": F.when(deficit.isNotNull(), F.greatest(deficit, F.lit(0.0))), "SPV": slope, "ETP": demand, "PETP": F.col(prec) - demand}, merge, META_COLUMNS)


def param_temperature(df: DataFrame, tmax: str = "T2M_MAX", tmin: str = "T2M_MIN", base: float = 9.0, upper: float = 45.0, low: float = 26.0, high: float = 32.0, method: str = "standard", merge: bool = False) -> DataFrame:
    """GDD, FRUE and T2M_RANGE from the cardinal temperatures."""
    if not base < low <= high < upper:
        raise ValueError("cardinal temperatures must rise: base < low <= high < upper")
    require(df, [tmax, tmin])
    a, b = F.col(tmax), F.col(tmin)
    new = {"GDD": thermal.growing_degrees(a, b, base, upper, method), "FRUE": thermal.use_efficiency((a + b) / 2, base, low, high, upper), "T2M_RANGE": a - b}
    return _result(df, new, merge, META_COLUMNS)


def process_weather(df: DataFrame, altitude: float | str = 600.0, alpha: float = 1.26, **temperature) -> DataFrame:
    """All three sets of parameters; columns they make are dropped first, so a second call changes nothing."""
    df = df.drop(*PROCESSED_COLUMNS)
    return param_temperature(param_atmospheric(param_radiation(df), altitude=altitude, alpha=alpha, merge=True), merge=True, **temperature)


def finish_download(df: DataFrame, variables: Sequence[str], start: str = "start") -> DataFrame:
    """What follows a daily download: day numbers, renamed rain, fills as null, and the derived columns for which inputs exist.

    The vapour deficit here is not floored, and sunshine follows direct radiation, unlike the parameters above.
    """
    require(df, ["env", "LAT", "YYYYMMDD", start])
    df = strip_fill(df, [v for v in variables if v in df.columns])
    if "PRECTOTCORR" in df.columns:
        df = df.withColumnRenamed("PRECTOTCORR", "PRECTOT")
    day = F.col("YYYYMMDD")
    df = df.withColumns({"daysFromStart": F.datediff(day, F.col(start)) + 1, "YEAR": F.year(day), "MM": F.month(day), "DD": F.dayofmonth(day), "DOY": F.dayofyear(day)})
    have = set(df.columns)
    hours, above = solar.daylength(F.col("DOY"), F.col("LAT")), solar.extraterrestrial_radiation(F.col("DOY"), F.col("LAT"))
    new = {"N": hours, "RTA": above}
    if {"T2M_MIN", "T2M_MAX", "T2MDEW"} <= have:
        new["VPD"] = moisture.vapour_deficit(F.col("T2M_MIN"), F.col("T2M_MAX"), F.col("T2MDEW"))
    if "ALLSKY_SFC_SW_DNI" in have:
        share = F.try_divide(F.col("ALLSKY_SFC_SW_DNI"), above)
        new["n_sun"] = F.when(share.isNotNull(), F.least(F.greatest(hours * share, F.lit(0.0)), hours))
    if {"T2M", "RH2M"} <= have:
        new["TH1"] = moisture.discomfort_index(F.col("T2M"), F.col("RH2M"))
    if {"T2M", "T2MDEW"} <= have:
        new["TH2"] = moisture.humidity_index(F.col("T2M"), F.col("T2MDEW"))
    if {"ALLSKY_SFC_PAR_TOT", "T2M"} <= have:
        new["PAR_TEMP"] = F.try_divide(F.col("ALLSKY_SFC_PAR_TOT"), F.col("T2M"))
    return df.withColumns(new)
