"""Environmental relatedness kernels, over tables (i, j, value) or numpy matrices of few environments."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.operators.ranks import exact_quantiles
from agrolith.operators.tiles import moments
from agrolith.session import checkpointed


def _products(w: DataFrame) -> DataFrame:
    """(i, j, own_i, own_j, value): inner products over the covariables that both have."""
    return moments(w).select("i", "j", "own_i", "own_j", F.when(F.col("n") > 0, F.col("xy")).alias("value"))


def linear_kernel(w: DataFrame) -> DataFrame:
    """W W' over the mean of its diagonal."""
    mean = w.where("value IS NOT NULL").groupBy("env").agg(F.sum(F.col("value") * F.col("value")).alias("own")).agg(F.avg("own").alias("mean"))
    return _products(w).crossJoin(F.broadcast(mean)).select("i", "j", (F.col("value") / F.col("mean")).alias("value"))  # one row


def gaussian_kernel(w: DataFrame, h: float = 1.0) -> DataFrame:
    """exp(-h d^2 / q) with q the median of all squared distances, those of environments to themselves included; where
    that is 0 their 5 % quantile, and else 1.
    """
    apart = F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.greatest(F.col("xx") + F.col("yy") - 2 * F.col("xy"), F.lit(0.0)))
    squared = checkpointed(moments(w).select("i", "j", F.when(F.col("n") > 0, apart).alias("d2")))
    low, middle = exact_quantiles(squared, ["d2"], (0.05, 0.5))["d2"] or (0.0, 0.0)
    q = middle if middle > 0 else low if low > 0 else 1.0
    return squared.select("i", "j", F.exp(-h * F.col("d2") / q).alias("value"))


def _arc(product, a, b):
    cosine = F.greatest(F.least(product / F.nullif(F.sqrt(a * b), F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    angle = F.acos(cosine)
    return F.coalesce(F.sqrt(a * b) * (F.sin(angle) + (math.pi - angle) * F.cos(angle)) / math.pi, F.lit(0.0))


def arc_cosine_kernel(w: DataFrame, layers: int = 1) -> DataFrame:
    """Arc-cosine kernel of the first order, applied again for each further layer. A layer leaves the diagonal as it is."""
    k = _products(w)
    for _ in range(layers):
        k = k.withColumn("value", _arc(F.col("value"), F.col("own_i"), F.col("own_j")))
    return k.select("i", "j", "value")


def _rounded(k: DataFrame, digits: int | None) -> DataFrame:
    return k if digits is None else k.withColumn("value", F.round("value", digits))


def env_kernel(w: DataFrame, stages: Sequence[str] | None = None, kind: str = "linear", h: float = 1.0, layers: int = 1, digits: int | None = 5, sd_tol: float | None = None, observations: DataFrame | None = None) -> Mapping[str, DataFrame]:
    """``var_cov`` (covariables) and ``env_cov`` (environments), or one environment kernel for each stage.

    A stage takes the covariables whose name matches it as a regular expression, so V1 also takes V1_V6. With ``sd_tol``,
    covariables that deviate by more than that are left out first. With ``observations`` (obs, env), kernels of environments come
    for these, as Z K Z'.
    """
    if sd_tol is not None:
        kept = w.groupBy("covariable").agg(F.stddev_samp("value").alias("sd")).where(F.col("sd") <= sd_tol).select("covariable")
        w = w.join(kept, "covariable", "left_semi")
    if observations is not None:
        found = env_kernel(w, stages, kind, h, layers, digits)
        return {k: v if k == "var_cov" else expanded(v, observations) for k, v in found.items()}
    make = {"linear": linear_kernel, "gaussian": lambda x: gaussian_kernel(x, h), "arccos": lambda x: arc_cosine_kernel(x, layers)}[kind]
    if stages:
        return {s: _rounded(make(w.where(F.col("covariable").rlike(s))), digits) for s in stages}
    turned = w.select(F.col("covariable").alias("env"), F.col("env").alias("covariable"), "value")
    return {"var_cov": _rounded(make(turned), digits), "env_cov": _rounded(make(w), digits)}


def expanded(kernel: DataFrame, observations: DataFrame, key: str = "env", obs: str = "obs") -> DataFrame:
    """Z K Z' as (i, j, value) over observations; for few of them, see models.kernels for the factored form."""
    a = observations.select(F.col(obs).alias("oi"), F.col(key).alias("i"))
    b = observations.select(F.col(obs).alias("oj"), F.col(key).alias("j"))
    return kernel.join(a, "i").join(b, "j").select(F.col("oi").alias("i"), F.col("oj").alias("j"), "value")


def to_matrix(cells: DataFrame, rows: str = "env", columns: str = "covariable") -> tuple[np.ndarray, list[str], list[str]]:
    """A small long table as a matrix with sorted names; absent cells are NaN."""
    found = cells.select(F.col(rows).cast("string"), F.col(columns).cast("string"), "value").collect()
    r, c = sorted({x[0] for x in found}), sorted({x[1] for x in found})
    ri, ci = {n: i for i, n in enumerate(r)}, {n: i for i, n in enumerate(c)}
    m = np.full((len(r), len(c)), np.nan)
    for a, b, v in found:
        m[ri[a], ci[b]] = np.nan if v is None else v
    return m, r, c


def select_names(names: Sequence[str], pattern: str) -> list[str]:
    return [n for n in names if re.search(pattern, n)]
