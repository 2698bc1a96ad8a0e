"""Summaries of environment-days over the season or over intervals of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.constants import META_COLUMNS
from agrolith.functions import bins
from agrolith.schema import numeric_columns, require


def _text(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def interval_bins(df: DataFrame, day: str, breaks: Sequence[float] | None = None, names: Sequence[str] | None = None, min_window: int = 2) -> tuple[list[float], list[str]]:
    """Left-closed bins of days; the last, from the greatest break on, is open and always there unless it holds too few rows.

    Breaks default to tens from 1 - (first day); names to ``Interval_<break>``. One aggregate looks at the days.
    """
    if breaks is None:
        first, last = df.agg(F.min(day), F.max(day)).first()
        breaks = list(range(int(1 - first), int(last) + 11, 10))
    breaks = sorted({float(b) for b in breaks})
    names = [f"Interval_{_text(b)}" for b in breaks] if names is None else list(names)
    if len(names) == len(breaks) - 1:
        names.append(f"Interval_{_text(breaks[-1])}")
    if len(names) != len(breaks):
        raise ValueError(f"{len(breaks)} breaks need as many names or one less, not {len(names)}")
    if df.where(F.col(day) >= breaks[-1]).limit(min_window).count() < min_window:
        return breaks, [*names[:-1], None]
    return breaks, names


def interval(day: Column, breaks: Sequence[float], names: Sequence[str | None]) -> Column:
    """The bin of a day; null below the first break and in a bin without a name."""
    named = bins.left_closed(day, breaks, [n or "" for n in names])
    return F.nullif(named, F.lit(""))


def melt(df: DataFrame, ids: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """One row for each row and variable: ids, variable, value (double)."""
    require(df, [*ids, *variables])
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in variables]).unpivot(list(ids), list(variables), "variable", "value")


def default_variables(df: DataFrame, ids: Sequence[str]) -> list[str]:
    return numeric_columns(df, but=[*ids, *META_COLUMNS])


def summarize_weather(df: DataFrame, env: str = "env", day: str = "daysFromStart", variables: Sequence[str] | None = None, statistic: str = "all", probs: Sequence[float] = (0.25, 0.5, 0.75), by_interval: bool = False, breaks: Sequence[float] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """(env, [interval,] variable, mean, sum, prob_<p>...): one grouped pass with all statistics.

    Quantiles interpolate linearly. A group without values has nulls. An unknown statistic means all of them.
    """
    variables = list(variables or default_variables(df, [env, day]))
    require(df, [env, *variables, *([day] if by_interval else [])])
    ids = [env]
    if by_interval:
        cuts, labels = interval_bins(df, day, breaks, names)
        df = df.withColumn("interval", interval(F.col(day), cuts, labels)).where(F.col("interval").isNotNull())
        ids.append("interval")
    quantiles = [F.percentile("value", p).alias(f"prob_{p}") for p in probs]
    chosen = {"mean": [F.avg("value").alias("mean")], "sum": [F.sum("value").alias("sum")], "quantile": quantiles}
    aggregates = chosen.get(statistic, [*chosen["mean"], *chosen["sum"], *quantiles])
    return melt(df, ids, variables).groupBy(*ids, "variable").agg(*aggregates)
