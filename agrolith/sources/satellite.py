"""Satellite series: quality bits, scaling, site means, and gap-bounded interpolation to days."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bit_field(x: Column, low: int, high: int) -> Column:
    """The bits low .. high of an integer."""
    return F.shiftright(x, low).bitwiseAND((1 << (high - low + 1)) - 1)


def lst_quality(qa: Column, worst_error: int = 2) -> Column:
    """Whether a land-surface temperature is usable: produced, and with an error class of at most so many."""
    return (bit_field(qa, 0, 1) <= 1) & (bit_field(qa, 6, 7) <= worst_error)


def et_quality(qa: Column) -> Column:
    """Whether an evapotranspiration value is usable: good retrieval, no cloud, main method."""
    return (bit_field(qa, 0, 0) == 0) & (bit_field(qa, 3, 4) == 0) & (bit_field(qa, 5, 7) <= 1)


def scaled(raw: Column, factor: float, offset: float, valid: tuple[float, float]) -> Column:
    return F.when(raw.between(*valid), raw * factor + offset)


def site_means(pixels: DataFrame, value: Column, usable: Column, name: str, aggregate=F.avg) -> DataFrame:
    """(env, YYYYMMDD, name, n_pixel, n_total): an aggregate of the usable pixels around a site."""
    good = F.when(usable, value)
    return pixels.groupBy("env", "YYYYMMDD").agg(aggregate(good).alias(name), F.count(good).alias("n_pixel"), F.count("*").alias("n_total"))


def merged(series: Sequence[DataFrame]) -> DataFrame:
    """All variables by site and date, each where it has one."""
    out = series[0]
    for more in series[1:]:
        out = out.join(more, ["env", "YYYYMMDD"], "full")
    return out


def cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through at least four points. At both ends its third derivative is that of the cubic through the four outermost points.

    The unknowns are sixths of second derivatives: a tridiagonal system, solved forwards and back. Outside, the end pieces go on.
    """
    n, h = len(x), np.diff(x)
    slope = np.diff(y) / h
    third = lambda i: ((slope[i + 2] - slope[i + 1]) / (x[i + 3] - x[i + 1]) - (slope[i + 1] - slope[i]) / (x[i + 2] - x[i])) / (x[i + 3] - x[i])
    middle = np.concatenate([[-h[0]], 2 * (h[:-1] + h[1:]), [-h[-1]]])
    right = np.concatenate([[h[0] ** 2 * third(0)], np.diff(slope), [-(h[-1] ** 2) * third(n - 4)]])
    for i in range(1, n):
        share = h[i - 1] / middle[i - 1]
        middle[i] -= share * h[i - 1]
        right[i] -= share * right[i - 1]
    s = right / middle
    for i in range(n - 2, -1, -1):
        s[i] = (right[i] - h[i] * s[i + 1]) / middle[i]
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    w = (at - x[k]) / h[k]
    return w * y[k + 1] + (1 - w) * y[k] + h[k] ** 2 * ((w**3 - w) * s[k + 1] + ((1 - w) ** 3 - (1 - w)) * s[k])


def _splined(out: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Days with each variable on a spline through its values: at most the days of one site are together. Series of under four values stay linear."""
    names = [f"_s_{v}" for v in variables]

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        day = (pd.to_datetime(rows["YYYYMMDD"]) - pd.Timestamp("1970-01-01")).dt.days.to_numpy(float)
        new = rows[["env", "YYYYMMDD"]].copy()
        for v, name in zip(variables, names, strict=True):
            y = rows[v].to_numpy(float)
            known = np.flatnonzero(~np.isnan(y))
            known = known[np.argsort(day[known])]
            new[name] = cubic(day[known], y[known], day) if len(known) > 3 else np.nan
        return new

    given = out.select("env", "YYYYMMDD", *[F.col(v).cast("double").alias(v) for v in variables])
    filled = given.groupBy("env").applyInPandas(fill, ", ".join(["env string", "YYYYMMDD date", *[f"`{n}` double" for n in names]]))
    return out.join(filled, ["env", "YYYYMMDD"])


def to_daily(df: DataFrame, variables: Sequence[str], method: str = "linear", max_gap: int = 16, divide: int | None = None) -> DataFrame:
    """A row for each day between a site's first and last: values linear between neighbours, constant from the last one, on a cubic spline
    (which also goes on beyond a variable's first and last value), or only as observed (none). Gaps of more than ``max_gap`` days stay empty
    and are marked. ``divide`` spreads composites of so many days. A day's first row counts.
    """
    if method not in ("linear", "constant", "spline", "none"):
        raise ValueError(f"unknown method {method}")
    span = df.groupBy("env").agg(F.min("YYYYMMDD").alias("a"), F.max("YYYYMMDD").alias("b"))
    days = span.select("env", F.explode(F.sequence("a", "b")).alias("YYYYMMDD"))
    out = days.join(df.select("env", "YYYYMMDD", *variables), ["env", "YYYYMMDD"], "left")
    if method == "spline":
        out = _splined(out.dropDuplicates(["env", "YYYYMMDD"]), variables)
    before = Window.partitionBy("env").orderBy("YYYYMMDD").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("env").orderBy("YYYYMMDD").rowsBetween(0, Window.unboundedFollowing)
    new = {}
    for v in variables:
        known = F.when(F.col(v).isNotNull(), F.struct(F.col("YYYYMMDD").alias("d"), F.col(v).cast("double").alias("x")))
        left, right = F.last(known, ignorenulls=True).over(before), F.first(known, ignorenulls=True).over(after)
        gap = F.datediff(right["d"], left["d"])
        if method in ("linear", "spline"):
            value = left["x"] + (right["x"] - left["x"]) * F.coalesce(F.datediff("YYYYMMDD", left["d"]) / F.nullif(gap, F.lit(0)), F.lit(0.0))
        else:
            value = left["x"] if method == "constant" else F.col(v).cast("double")
        value = F.when(gap <= max_gap, value)
        if method == "spline":  # beyond the ends there is no gap to be too wide
            value = F.when(F.coalesce(gap <= max_gap, F.lit(True)), F.coalesce(f"_s_{v}", value))
        new[v] = value / divide if divide else value
        new[f"{v}_gap"] = F.coalesce(gap > max_gap, F.lit(True))
    return out.withColumns(new).drop(*[f"_s_{v}" for v in variables])
