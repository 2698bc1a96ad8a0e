"""Environment-by-covariable matrices, long (env, covariable, value) until linear algebra needs them wide."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.operators import tiles
from agrolith.operators.summary import summarize_weather


def _all():
    return Window.partitionBy("covariable")



@dataclass
class Covariables:
    """values (env, covariable, value); status (covariable, center, scale, status, max_abs_cor, partner, block)."""

    values: DataFrame
    status: DataFrame

    def wide(self, names: Sequence[str] | None = None) -> DataFrame:
        names = names or sorted(r[0] for r in self.values.select("covariable").distinct().collect())
        return self.values.groupBy("env").pivot("covariable", names).agg(F.first("value"))


def named_statistics(summary: DataFrame, env: str = "env") -> DataFrame:
    """(env, covariable, value) with covariables ``variable_statistic[_interval]`` from a summary."""
    keys = [c for c in (env, "interval", "variable") if c in summary.columns]
    stats = [c for c in summary.columns if c not in keys]
    parts = ["variable", "statistic", *(["interval"] if "interval" in keys else [])]
    return summary.unpivot(keys, stats, "statistic", "value").select(F.col(env).alias("env"), F.concat_ws("_", *parts).alias("covariable"), "value")


def impute(w: DataFrame, how: str = "none", k: int = 5) -> DataFrame:
    """Fill missing cells by the covariable's mean or median, by like environments (knn), or drop covariables that lack cells.

    Cells may be missing as rows or as nulls.
    """
    if how == "none":
        return w
    envs, covs = w.select("env").distinct(), w.select("covariable").distinct()
    full = envs.crossJoin(covs).join(w, ["env", "covariable"], "left")
    if how == "drop":
        whole = full.groupBy("covariable").agg(F.max(F.col("value").isNull().cast("int")).alias("lacks")).where("lacks = 0")
        return full.join(whole.select("covariable"), "covariable", "left_semi").select("env", "covariable", "value")
    if how in ("mean", "median"):
        fill = F.avg("value").over(_all()) if how == "mean" else F.median("value").over(_all())
        return full.select("env", "covariable", F.coalesce("value", fill).alias("value"))
    if how == "knn":
        return _impute_knn(full, k)
    raise ValueError(f"unknown imputation {how}")


def _impute_knn(full: DataFrame, k: int) -> DataFrame:
    """Means over the k nearest environments that have the cell, by root mean square distance of standardised shared cells."""
    sd = F.stddev_samp("value").over(_all())
    z = full.withColumn("z", (F.col("value") - F.avg("value").over(_all())) / F.when(sd > 0, sd).otherwise(1.0))
    lacking = z.where("value IS NULL").select(F.col("env").alias("a"), "covariable")
    short = z.join(lacking.select(F.col("a").alias("env")).distinct(), "env", "left_semi")
    left, right = short.where("z IS NOT NULL").select(F.col("env").alias("a"), "covariable", F.col("z").alias("za")), z.where("z IS NOT NULL").select(F.col("env").alias("b"), "covariable", F.col("z").alias("zb"))
    near = left.join(right, "covariable").where("a <> b").groupBy("a", "b").agg(F.sqrt(F.avg(F.pow(F.col("za") - F.col("zb"), F.lit(2.0)))).alias("d"))
    donors = lacking.join(near, "a").join(full.select(F.col("env").alias("b"), "covariable", "value").where("value IS NOT NULL"), ["b", "covariable"])
    first = Window.partitionBy("a", "covariable").orderBy("d", "b")
    means = donors.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).groupBy(F.col("a").alias("env"), "covariable").agg(F.avg("value").alias("fill"))
    return full.join(means, ["env", "covariable"], "left").select("env", "covariable", F.coalesce("value", "fill", F.avg("value").over(_all())).alias("value"))


def moments(w: DataFrame) -> DataFrame:
    return w.groupBy("covariable").agg(F.avg("value").alias("center"), F.stddev_samp("value").alias("scale"))


def correlations(w: DataFrame) -> DataFrame:
    """(i, j, r) for pairs i < j of covariables with a finite correlation, over shared environments."""
    spread = w.groupBy("covariable").agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd")).where("_sd > 0")
    z = w.join(spread, "covariable").select("env", "covariable", ((F.col("value") - F.col("_mean")) / F.col("_sd")).alias("value"))
    m = tiles.moments(z, "covariable", "env").where("i < j")
    n, var = F.col("n"), lambda s: F.col("n") * F.col(2 * s) - F.col(s) * F.col(s)
    varies = (var("x") > 1e-12 * n * n) & (var("y") > 1e-12 * n * n)
    r = F.when(varies, F.greatest(F.least((n * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(var("x") * var("y")), F.lit(1.0)), F.lit(-1.0)))
    return m.select("i", "j", r.alias("r")).where("r IS NOT NULL")


def diagnose(w: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(covariable, max_abs_cor, partner): the strongest correlation of each covariable; ties fall to the first partner by name."""
    pairs = correlations(w) if pairs is None else pairs
    both = pairs.select("i", "j", F.abs("r").alias("m")).union(pairs.select("j", "i", F.abs("r")))
    top = Window.partitionBy("i").orderBy(F.col("m").desc(), "j")
    best = both.withColumn("k", F.row_number().over(top)).where("k = 1").select(F.col("i").alias("covariable"), F.round("m", 4).alias("max_abs_cor"), F.col("j").alias("partner"))
    return w.select("covariable").distinct().join(best, "covariable", "left")


def correlation_matrix(pairs: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Absolute correlations on the driver: as many cells as pairs of covariables."""
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for i, j, r in pairs.collect():
        if i in at and j in at:
            m[at[i], at[j]] = m[at[j], at[i]] = abs(r)
    return m


def collinear(m: np.ndarray, names: Sequence[str], most: float) -> list[str]:
    """Covariables to drop, greedily: of the strongest pair the one more correlated with the rest, until none exceeds the limit."""
    left, gone = list(range(len(names))), []
    while len(left) > 1:
        sub = m[np.ix_(left, left)]
        # The first maximum in column order is the pair's later member first, as in a column-major scan.
        col, row = divmod(int(np.argmax(sub.T)), len(left))
        if sub[row, col] <= most:
            break
        gone.append(names[left.pop(row if sub[row].mean() >= sub[col].mean() else col)])
    return gone


def blocks(m: np.ndarray, names: Sequence[str], most: float) -> dict[str, str]:
    """Covariable -> block label, by average-linkage clustering of 1 - |r| cut at 1 - most; the label names the medoid."""
    from agrolith.models.clustering import cut_height, linkage

    if len(names) < 2:
        return {n: n for n in names}
    found: dict[int, list[int]] = {}
    for i, c in enumerate(cut_height(linkage(1 - m - np.eye(len(names)) * (1 - m), "average"), len(names), 1 - most)):
        found.setdefault(int(c), []).append(i)
    out = {}
    for own in found.values():
        medoid = own[int(np.argmax(m[np.ix_(own, own)].sum(axis=1)))]
        label = names[medoid] + (f"(+{len(own) - 1})" if len(own) > 1 else "")
        out |= {names[i]: label for i in own}
    return out


def scale_covariables(w: DataFrame, center: bool = True, scale: bool = True, sd_tol: float = 10.0, tol: float = 1e-3, qc: bool = False, how: str = "none", k: int = 5, max_cor: float | None = None, group: bool = False) -> Covariables:
    """Impute, flag by the unscaled deviation, standardise, then drop or group collinear covariables.

    Collinear covariables always go; those too variable or near constant only with ``qc``.
    """
    w = impute(w, how, k)
    sd = F.col("scale")
    flag = F.when(sd > sd_tol, "too.variable").when(sd.isNull() | (sd <= tol), "near.constant")
    stats = moments(w).withColumn("flag", flag)
    pairs = correlations(w)
    gone, label = [], {}
    if max_cor is not None:
        usable = {r["covariable"]: r["flag"] for r in stats.select("covariable", "flag").collect()}
        names = sorted(n for n, f in usable.items() if f is None or (group and f == "too.variable" and not qc))
        matrix = correlation_matrix(pairs, names)
        if group:
            label = blocks(matrix, names, max_cor)
        else:
            gone = collinear(matrix, names, max_cor)
    if qc:
        dropped = F.col("flag").isNotNull() | F.col("covariable").isin(gone)
    elif label:
        dropped = F.col("flag") == "near.constant"
    else:
        dropped = F.col("covariable").isin(gone)
    dropped = F.coalesce(dropped, F.lit(False))
    value = F.col("value")
    value = value - F.col("center") if center else value
    value = value / F.nullif(F.col("scale"), F.lit(0.0)) if scale else value
    spark = w.sparkSession
    member = spark.createDataFrame(list(label.items()), "covariable string, block string")
    status = stats.join(diagnose(w, pairs), "covariable", "left").join(member, "covariable", "left")
    reason = F.when(F.col("covariable").isin(gone), "removed(collinear)").when(F.col("flag").isNotNull(), F.concat(F.lit("removed("), "flag", F.lit(")"))).otherwise("kept")
    status = status.select("covariable", "center", "scale", F.when(F.col("block").isNotNull(), "grouped").otherwise(reason).alias("status"), "max_abs_cor", "partner", "block")
    kept = w.join(stats.withColumn("dropped", dropped).where(~F.col("dropped")).select("covariable", "center", "scale"), "covariable").select("env", "covariable", value.alias("value"))
    if label:
        kept = kept.join(member, "covariable").groupBy("env", F.col("block").alias("covariable")).agg(F.avg("value").alias("value"))
    return Covariables(kept, status)


def w_matrix(df: DataFrame, is_processed: bool = False, env: str = "env", day: str = "daysFromStart", variables: Sequence[str] | None = None, statistic: str = "mean", probs: Sequence[float] = (0.25, 0.5, 0.75), by_interval: bool = False, breaks: Sequence[float] | None = None, names: Sequence[str] | None = None, copula: str | None = None, **scaling) -> Covariables:
    """Summarise, name covariables, optionally turn them into a copula's, and scale. A processed table is (env, covariable, value) already."""
    w = df if is_processed else named_statistics(summarize_weather(df, env, day, variables, statistic, probs, by_interval, breaks, names), env)
    if copula:
        from agrolith.operators.copula import env_copula

        w = env_copula(w, copula)
    return scale_covariables(w, **scaling)


def env_expand(w: DataFrame, phenotypes: DataFrame, env: str = "env") -> DataFrame:
    """Covariables beside each phenotype: an inner join on environment."""
    return phenotypes.join(w.withColumnRenamed("env", env), env)


def even_positions(n: int, most: int) -> list[int]:
    """At most so many positions of 0 .. n - 1, evenly spread, ties of rounding to even."""
    if n <= most:
        return list(range(n))
    return sorted({round(1 + i * (n - 1) / (most - 1)) - 1 for i in range(most)}) if most > 1 else [0]


def effective_rank(eigenvalues: Sequence[float]) -> float:
    p = np.array([e for e in eigenvalues if e > 0])
    p = p / p.sum()
    return math.exp(-(p * np.log(p)).sum())
