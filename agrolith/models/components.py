"""What follows from a table of saved draws, by DataFrame operations: components of variance and intervals of predictions.

Draws are long: (kernel, draw, env, gid, value), one row for each kernel's effect on an observation in a saved iteration. Phenotypes are
(env, gid, value). Nothing reaches the driver; all sums are grouped by observation or by role.

Defined results: rows without a value are left out; repeated rows of a draw are averaged; a role without a kernel has no variance; empty draws
give one row of nulls for the components and no interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def role(kernel: Column) -> Column:
    """GE, E, G by a kernel's name, null for others; interactions are looked for first."""
    return F.when(kernel.contains("GE"), "GE").when(kernel.rlike("(?i)^KE_|^E$|env"), "E").when(kernel.rlike("(?i)^KG_|^G$|gid|geno"), "G")


def posterior_means(draws: DataFrame) -> DataFrame:
    """(kernel, role, env, gid, u): each kernel's mean effect on an observation."""
    return draws.where("value IS NOT NULL").groupBy("kernel", "env", "gid").agg(F.avg("value").alias("u")).withColumn("role", role(F.col("kernel")))


def variance_components(draws: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """One row: var_G, var_E, var_GE, var_resid, var_total, h2_entry, h2_plot, rg, p, q, negative_residual, few_environments.

    A role's variance is that of its kernels' summed mean effects. Where components exceed the phenotypes' variance, the residual is a small value and
    ``negative_residual`` says so.
    """
    summed = posterior_means(draws).where("role IS NOT NULL").groupBy("role", "env", "gid").agg(F.sum("u").alias("u"))
    of = lambda r: F.var_samp(F.when(F.col("role") == r, F.col("u"))).alias(f"var_{r}")
    parts = summed.agg(of("G"), of("E"), of("GE"))
    seen = phenotypes.where("value IS NOT NULL").agg(F.var_samp("value").alias("var_total"))
    counts = phenotypes.agg(F.countDistinct("gid").alias("p"), F.countDistinct("env").alias("q"))
    one = parts.join(seen, F.lit(True)).join(counts, F.lit(True))  # each is one row
    g, e, ge = (F.coalesce(F.col(f"var_{r}"), F.lit(0.0)) for r in ("G", "E", "GE"))
    left = F.col("var_total") - (g + e + ge)
    resid = F.when(left < 0, F.greatest(1e-6 * F.col("var_total"), F.lit(1e-8))).otherwise(left)
    one = one.withColumns({"negative_residual": left < 0, "var_resid": resid, "few_environments": F.col("q") < 20})
    ratio = lambda over: F.when(over > 0, g / over)
    rest = F.col("var_resid")
    return one.select(
        "var_G", "var_E", "var_GE", "var_resid", "var_total", ratio(g + e / F.nullif("q", F.lit(0)) + ge / F.nullif(F.col("p") * F.col("q"), F.lit(0)) + rest).alias("h2_entry"), ratio(g + ge + rest).alias("h2_plot"),
        F.when((F.col("var_G") + F.col("var_GE")) > 0, F.col("var_G") / (F.col("var_G") + F.col("var_GE"))).alias("rg"), "p", "q", "negative_residual", "few_environments",
    )


def prediction_intervals(draws: DataFrame, means: DataFrame, level: float = 0.95) -> DataFrame:
    """(env, gid, yhat, lower, upper) of the draws' sums over kernels, with the mean of the same iteration (draw, mu)."""
    each = draws.where("value IS NOT NULL").groupBy("env", "gid", "kernel", "draw").agg(F.avg("value").alias("u")).groupBy("env", "gid", "draw").agg(F.sum("u").alias("u"))
    y = each.join(means, "draw").withColumn("y", F.col("u") + F.col("mu"))
    q = lambda p: F.percentile("y", F.lit(p))  # noqa: E731  as many values as saved draws
    return y.groupBy("env", "gid").agg(F.avg("y").alias("yhat"), q((1 - level) / 2).alias("lower"), q((1 + level) / 2).alias("upper"))
