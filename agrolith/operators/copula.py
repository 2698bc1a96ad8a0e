"""Empirical copula of covariables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.operators.tiles import dominance


def pseudo_observations(w: DataFrame, ties: str = "average") -> DataFrame:
    """Ranks over environments divided by one more than their number.

    Equal values share their mean, least or greatest rank (average, min, max), or follow the environments' names (first, last).
    """
    order, same, all_ = Window.partitionBy("covariable").orderBy("value"), Window.partitionBy("covariable", "value"), Window.partitionBy("covariable")
    low, n = F.rank().over(order), F.count("*").over(same)
    named = lambda by: F.row_number().over(Window.partitionBy("covariable").orderBy("value", by))
    ranks = {"average": low + (n - 1) / 2, "min": low, "max": low + n - 1, "first": named("env"), "last": named(F.desc("env"))}
    if ties not in ranks:
        raise ValueError(f"unknown treatment of ties {ties}")
    return w.select("env", "covariable", (ranks[ties] / (F.count("*").over(all_) + 1)).alias("value"))


def _dominance(u: DataFrame, below: bool) -> DataFrame:
    """(block, env, value): share of environments that lie on the same side in all covariables of a block."""
    return dominance(u, "block", below).select(F.col("key").alias("block"), F.col("row").alias("env"), (F.col("on_side") / (F.col("met") + 1)).alias("value"))


def env_copula(w: DataFrame, index: str = "pobs", groups: Mapping[str, str] | None = None, ties: str = "average") -> DataFrame:
    """(env, covariable, value) of pseudo-observations (cop_u_), the joint copula (cop_C_), its survival form (cop_surv_), the
    Kendall index (cop_K_, the empirical distribution of C scaled to 0..1), or all of them.

    ``groups`` maps covariables to blocks; by default all form one block, ``all``.
    """
    if index not in ("pobs", "joint", "survival", "kendall", "all"):
        raise ValueError(f"unknown index {index}")
    u = pseudo_observations(w, ties)
    block = F.lit("all")
    if groups:
        block = F.lit(None).cast("string")
        for name, own in groups.items():
            block = F.when(F.col("covariable") == name, own).otherwise(block)
    blocked = u.withColumn("block", block).where(F.col("block").isNotNull())
    named = lambda df, prefix: df.select("env", F.concat(F.lit(prefix), "block").alias("covariable"), "value")
    parts = {}
    if index in ("pobs", "all"):
        parts["pobs"] = u.select("env", F.concat(F.lit("cop_u_"), "covariable").alias("covariable"), "value")
    if index in ("joint", "kendall", "all"):
        joint = _dominance(blocked, below=True)
        if index != "kendall":
            parts["joint"] = named(joint, "cop_C_")
        if index != "joint":
            all_ = Window.partitionBy("block")
            k = F.cume_dist().over(all_.orderBy("value")) * F.count("*").over(all_) / (F.count("*").over(all_) + 1)
            k = joint.select("block", "env", k.alias("k"))
            low, high = F.min("k").over(all_), F.max("k").over(all_)
            parts["kendall"] = named(k.select("block", "env", F.when(high > low, (F.col("k") - low) / (high - low)).otherwise(F.col("k")).alias("value")), "cop_K_")
    if index in ("survival", "all"):
        parts["survival"] = named(_dominance(blocked, below=False), "cop_surv_")
    out = None
    for part in parts.values():
        out = part if out is None else out.union(part)
    return out
