"""Solar geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def daylength(doy: Column, latitude: Column) -> Column:
    """Hours of daylight by the CBM model with civil sunrise at 0.8333 degrees."""
    declination = F.asin(0.39795 * F.cos(0.2163108 + 2 * F.atan(0.9671396 * F.tan(0.00860 * (doy - 186)))))
    phi = F.radians(latitude)
    ratio = (F.sin(F.lit(math.radians(0.8333))) + F.sin(phi) * F.sin(declination)) / (F.cos(phi) * F.cos(declination))
    return 24.0 - (24.0 / math.pi) * F.acos(_clamped(ratio, -1.0, 1.0))


def extraterrestrial_radiation(doy: Column, latitude: Column) -> Column:
    """Daily radiation above the atmosphere in MJ per square metre."""
    angle = 2 * math.pi * doy / 365.0
    declination, distance, phi = 0.409 * F.sin(angle - 1.39), 1 + 0.033 * F.cos(angle), F.radians(latitude)
    sunset = F.acos(_clamped(-F.tan(phi) * F.tan(declination), -1.0, 1.0))
    total = (1440.0 / math.pi) * 0.082 * distance * (sunset * F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.sin(sunset))
    return F.greatest(total, F.lit(0.0))
