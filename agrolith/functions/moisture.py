"""Vapour pressure and atmospheric demand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two constants in use: daily and hourly saturation pressure at 0 degrees, in kPa.
DAILY_ES0, HOURLY_ES0 = 0.61078, 0.6108


def saturation_pressure(t: Column, es0: float = DAILY_ES0) -> Column:
    return es0 * F.exp(17.27 * t / (t + 237.3))


def air_pressure(altitude: Column) -> Column:
    return 101.3 * F.pow((293.0 - 0.0065 * altitude) / 293.0, F.lit(5.26))


def vapour_deficit(tmin: Column, tmax: Column, dew: Column) -> Column:
    """Not floored: negative where the dew point exceeds the air's mean."""
    return (saturation_pressure(tmin) + saturation_pressure(tmax)) / 2 - saturation_pressure(dew)


def pressure_slope(t: Column) -> Column:
    return 4098.0 * 0.6108 * F.exp(17.27 * t / (t + 237.3)) / F.pow(t + 237.3, F.lit(2.0))


def priestley_taylor(slope: Column, altitude: Column, radiation: Column, ground: Column, alpha: float) -> Column:
    gamma = 0.665e-3 * air_pressure(altitude)
    return F.greatest(alpha * slope / (slope + gamma) * (radiation - ground) * 0.408, F.lit(0.0))


def discomfort_index(t: Column, rh: Column) -> Column:
    return (1.8 * t + 32) - (0.55 - 0.0055 * rh) * (1.8 * t - 26)


def humidity_index(t: Column, dew: Column) -> Column:
    return t + 0.36 * dew + 41.2
