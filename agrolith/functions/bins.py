"""Intervals, classes and piecewise-linear curves as chains of conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def left_closed(x: Column, breaks: Sequence[float], names: Sequence[str]) -> Column:
    """Name of [b_i, b_i+1), the last bin open to the right; null below the first break."""
    out = F.lit(None).cast("string")
    for b, name in zip(breaks, names, strict=True):
        out = F.when(x >= b, name).otherwise(out)
    return out


def right_closed(x: Column, breaks: Sequence[float], names: Sequence[str], lowest: bool = False) -> Column:
    """Name of (b_i, b_i+1] for consecutive breaks; null outside, or in the first bin at its lower break if ``lowest``."""
    out = F.lit(None).cast("string")
    for i in reversed(range(len(breaks) - 1)):
        above = x >= breaks[i] if lowest and i == 0 else x > breaks[i]
        out = F.when(above & (x <= breaks[i + 1]), names[i]).otherwise(out)
    return out


def classify(x: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Class of a value among len(breaks) + 1 right-closed classes that cover the line; null stays null."""
    out = F.lit(labels[-1])
    for b, label in reversed(list(zip(breaks, labels[:-1], strict=True))):
        out = F.when(x <= b, label).otherwise(out)
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), out)


def interpolated(x: Column, knots: Sequence[float], values: Sequence[float]) -> Column:
    """Linear between knots, constant beyond."""
    out = F.lit(float(values[-1]))
    for i in reversed(range(1, len(knots))):
        slope = (values[i] - values[i - 1]) / (knots[i] - knots[i - 1])
        out = F.when(x <= knots[i], values[i - 1] + slope * (x - knots[i - 1])).otherwise(out)
    return F.when(x.isNull(), None).when(x <= knots[0], float(values[0])).otherwise(out)


def interval_label(index: Column, width: int = 3) -> Column:
    return F.concat(F.lit("i"), F.lpad(index.cast("string"), width, "0"))
