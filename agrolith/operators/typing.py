"""Environment types: how often each variable falls into each class, and matrices of those frequencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions import bins
from agrolith.operators.covariables import Covariables, impute
from agrolith.operators.ranks import exact_quantiles
from agrolith.operators.summary import default_variables, interval, interval_bins, melt


def _label(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else f"{x:g}"


def quantile_cardinals(df: DataFrame, variables: Sequence[str], probs: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> dict[str, list[float]]:
    """Class breaks from quantiles over all rows, rounded to three places, without repeats."""
    found = exact_quantiles(df, variables, probs)
    return {v: sorted({round(q, 3) for q in found[v]}) for v in variables if found[v]}


def env_typing(df: DataFrame, env: str = "env", day: str = "daysFromStart", variables: Sequence[str] | None = None, cardinals: Mapping[str, Sequence[float]] | Sequence[float] | None = None, probs: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99), by_interval: bool = False, breaks: Sequence[float] | None = None, names: Sequence[str] | None = None, min_window: int = 2, ratio: bool = False) -> DataFrame:
    """(env, interval, var, env_variable, freq): days in each right-closed class of each variable, classes without days included.

    Values at or below the first break or above the last are in no class. With ``ratio``, the share of the classified days.
    """
    variables = list(variables or default_variables(df, [env, day]))
    if cardinals is None:
        cardinals = quantile_cardinals(df, variables, probs)
    elif not isinstance(cardinals, Mapping):
        cardinals = {v: list(cardinals) for v in variables}
    classes = {v: [f"{v}_({_label(a)},{_label(b)}]" for a, b in zip(cardinals[v], cardinals[v][1:])] for v in variables}
    if by_interval:
        cuts, labels = interval_bins(df, day, breaks, names, min_window)
        df = df.withColumn("interval", interval(F.col(day), cuts, labels)).where(F.col("interval").isNotNull())
    else:
        df = df.withColumn("interval", F.lit("season"))
    long = melt(df, [env, "interval"], variables)
    of = F.lit(None).cast("string")
    for v in variables:
        of = F.when(F.col("variable") == v, bins.right_closed(F.col("value"), cardinals[v], classes[v])).otherwise(of)
    counts = long.withColumn("type", of).where(F.col("type").isNotNull()).groupBy(env, "interval", "variable", "type").agg(F.count("*").alias("freq"))
    # Every class of every variable for every environment and interval: the literal classes are exploded, not joined.
    menu = F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(t).alias("type")) for v in variables for t in classes[v]])
    grid = df.select(env).distinct().crossJoin(F.broadcast(df.select("interval").distinct())).select(env, "interval", F.inline(menu))
    full = grid.join(counts, [env, "interval", "variable", "type"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    name = F.concat("type", F.lit("_"), "interval") if by_interval else F.col("type")
    out = full.select(F.col(env).alias("env"), "interval", F.col("variable").alias("var"), name.alias("env_variable"), F.col("freq").cast("double").alias("freq"))
    return freq_to_ratio(out) if ratio else out


def freq_to_ratio(types: DataFrame) -> DataFrame:
    total = F.sum("freq").over(Window.partitionBy("env", "interval", "var"))
    return types.withColumn("freq", F.when(total > 0, F.col("freq") / total).otherwise(0.0))


def typing_wide(types: DataFrame) -> DataFrame:
    """(env, env_variable, freq): the median frequency of each environment and type, 0 where it has none."""
    cells = types.groupBy("env", "env_variable").agg(F.median("freq").alias("freq"))
    grid = types.select("env").distinct().crossJoin(types.select("env_variable").distinct())
    return grid.join(cells, ["env", "env_variable"], "left").withColumn("freq", F.coalesce("freq", F.lit(0.0)))


def t_matrix(types: DataFrame, ratio: bool = True, center: bool = False, scale: bool = False, how: str = "none", drop_constant: bool = True, tol: float = 1e-3) -> Covariables:
    """Environment-by-type matrix: medians, rows scaled to sum 1 (rows of zeros stay), types that hardly vary dropped."""
    w = typing_wide(types).select("env", F.col("env_variable").alias("covariable"), F.col("freq").alias("value"))
    w = impute(w, how)
    if ratio:
        total = F.sum("value").over(Window.partitionBy("env"))
        w = w.withColumn("value", F.when(total > 0, F.col("value") / total).otherwise(F.col("value")))
    stats = w.groupBy("covariable").agg(F.avg("value").alias("center"), F.stddev_samp("value").alias("scale"))
    varies = F.coalesce(F.col("scale") >= tol, F.lit(False)) if drop_constant else F.lit(True)
    status = stats.select("*", F.when(varies, "kept").otherwise("removed(near.constant)").alias("status"))
    value = F.col("value")
    value = value - F.col("center") if center else value
    value = value / F.nullif("scale", F.lit(0.0)) if scale else value
    kept = w.join(status.where("status = 'kept'"), "covariable").select("env", "covariable", value.alias("value"))
    return Covariables(kept, status)


def env_indices(df: DataFrame, env: str = "env", day: str = "daysFromStart", variables: Sequence[str] | None = None, interval_days: int = 3, end_day: int = 151, statistic: str = "mean", statistic_by: Mapping[str, str] | None = None, sep: str = "_", require_complete: bool = True) -> DataFrame:
    """(env, covariable, value, factor, interval, mid): each variable over equal intervals of days 1 .. end_day.

    Covariables are ``factor<sep>iNNN``. With ``require_complete``, a missing cell raises an error (one aggregate looks).
    """
    variables = list(variables or default_variables(df, [env, day]))
    tools = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median}
    width = max(3, len(str(-(-end_day // interval_days))))
    at = F.floor((F.col(day) - 1) / interval_days).cast("int") + 1
    seasons = df.where(F.col(day).between(1, end_day)).withColumn("_interval", at)
    grouped = seasons.groupBy(F.col(env).alias("env"), "_interval").agg(*[tools[(statistic_by or {}).get(v, statistic)](F.col(v).cast("double")).alias(v) for v in variables])
    long = grouped.unpivot(["env", "_interval"], variables, "factor", "value")
    start = (F.col("_interval") - 1) * interval_days + 1
    mid = (start + F.least(start + interval_days - 1, F.lit(end_day))) / 2
    label = bins.interval_label(F.col("_interval"), width)
    out = long.select("env", F.concat("factor", F.lit(sep), label).alias("covariable"), "value", "factor", F.col("_interval").alias("interval"), mid.alias("mid"))
    if require_complete:
        seen = out.agg(F.count("value").alias("cells"), F.countDistinct("env").alias("envs")).first()
        if seen["cells"] < seen["envs"] * len(variables) * -(-end_day // interval_days):
            raise ValueError("cells are missing: shorten end_day, or allow them with require_complete=False")
    return out
