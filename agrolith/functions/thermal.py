"""Thermal time and radiation use efficiency."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _least(x: Column, top: float) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(top)))


def _most(x: Column, low: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def growing_degrees(tmax: Column, tmin: Column, base: float, upper: float, method: str = "standard") -> Column:
    if method == "standard":
        return _most((_least(tmax, upper) + tmin) / 2 - base, 0.0)
    if method == "legacy":
        return (_most(_least(tmax, upper), base) + _most(_least(tmin, upper), base)) / 2 - base
    raise ValueError(f"unknown method {method}")


def use_efficiency(t: Column, base: float, low: float, high: float, upper: float) -> Column:
    """Effect of temperature on radiation use efficiency: a trapezoid from 0 to 1."""
    rising, falling = (t - base) / (low - base), (upper - t) / (upper - high)
    return F.when(t.isNull(), None).when((t <= base) | (t >= upper), 0.0).when(t < low, rising).when(t > high, falling).otherwise(1.0)


def day_gdd(tmax: Column, tmin: Column, base: float, upper: float) -> Column:
    return _most((_most(_least(tmax, upper), base) + _most(_least(tmin, upper), base)) / 2 - base, 0.0)


def day_trapezoid(tmax: Column, tmin: Column, base: float, upper: float, limit: float) -> Column:
    t = (tmax + tmin) / 2
    return F.when(t.isNull(), None).when((t <= base) | (t >= limit), 0.0).when(t <= upper, t - base).otherwise((upper - base) * (limit - t) / (limit - upper))


def day_sine(tmax: Column, tmin: Column, base: float, upper: float) -> Column:
    """Area above the base temperature under one sine wave a day, tops cut at the upper temperature."""
    high, low = _least(tmax, upper), _least(tmin, upper)
    middle, half = (high + low) / 2, (high - low) / 2
    share = F.greatest(F.least((base - middle) / F.nullif(half, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    theta = F.asin(share)
    partly = ((middle - base) * (math.pi / 2 - theta) + half * F.cos(theta)) / math.pi
    return F.when(high.isNull() | low.isNull(), None).when(low >= base, middle - base).when(high <= base, 0.0).otherwise(partly)


def photoperiod_factor(hours: Column, day_type: str, optimum: float, sensitivity: float) -> Column:
    if day_type == "neutral":
        return F.lit(1.0)
    over = hours - optimum if day_type == "short" else optimum - hours
    return F.greatest(F.least(1.0 - sensitivity * F.greatest(over, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
