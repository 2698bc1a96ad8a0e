"""Bayesian kernel regression by Gibbs sampling in the kernels' eigenspaces, its validation and variance components.

Chains and folds run as tasks of their own; a chain is sequential and works on arrays of n by rank.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.models import stats
from agrolith.models.kernelset import KernelSet, decompose_kernels, mask_by_cluster


@dataclass(frozen=True)
class Sampling:
    iterations: int = 1000
    burnin: int = 200
    thin: int = 10
    r2: float = 0.5
    r2_split: str = "per_kernel"
    df: float = 3.0
    seed: int = 1
    #: Saved draws from before the end of the burn-in count in none of the results.
    keep_chains: bool = True


@dataclass
class Fit:
    data: pd.DataFrame
    y: np.ndarray
    mu: float
    beta: np.ndarray
    effects: dict[str, np.ndarray]
    yhat: np.ndarray
    variances: dict[str, float]
    residual: float
    draws: pd.DataFrame
    chains: dict[str, np.ndarray] = field(default_factory=dict)

    def summary(self) -> pd.DataFrame:
        return varcomp_summary(self)

    def __repr__(self) -> str:
        return f"Fit(n={len(self.y)}, kernels={list(self.effects)}, residual={self.residual:.4g}, draws={len(self.draws)})"


def roles(name: str) -> str:
    """E, G or GE by a kernel's name; interactions are looked for first, and only their letters must be capital."""
    if "GE" in name:
        return "GE"
    if re.search(r"^KE_|^E$|env", name, re.IGNORECASE):
        return "E"
    if re.search(r"^KG_|^G$|gid|geno", name, re.IGNORECASE):
        return "G"
    return "other"


def sample(y: np.ndarray, ks: KernelSet, x: np.ndarray | None = None, how: Sampling = Sampling()) -> Fit:
    """One chain: intercept, fixed effects, kernel effects and their variances, residual variance, missing values."""
    if any(k.blocks is None for k in ks.kernels.values()):
        ks = decompose_kernels(ks)
    rng = np.random.default_rng(how.seed)
    y = np.asarray(y, float).copy()
    lost, n, names = np.isnan(y), len(y), list(ks.kernels)
    if lost.all():
        raise ValueError("there is no observed value")
    total = np.nanvar(y, ddof=1)
    mu = np.nanmean(y)
    y[lost] = mu
    x = np.zeros((n, 0)) if x is None else np.asarray(x, float)
    inverse = np.linalg.pinv(x.T @ x) if x.shape[1] else np.zeros((0, 0))
    root = np.linalg.cholesky(inverse + 1e-12 * np.eye(len(inverse))) if x.shape[1] else inverse
    share = how.r2 / (len(names) if how.r2_split == "per_kernel" else 1)
    spectra = {k: ks.kernels[k].blocks for k in names}
    mean_s = {k: np.concatenate([b.s for b in spectra[k]]).mean() for k in names}
    prior_e = (how.df + 2) * (1 - how.r2) * total
    prior = {k: (how.df + 2) * share * total / mean_s[k] for k in names}
    var_e, var, tau = total, {k: 0.2 for k in names}, 0.01
    u = {k: rng.normal(0, np.sqrt(1 / (2 * n)), n) for k in names}
    beta, resid = np.zeros(x.shape[1]), y - mu - sum(u.values())
    saved, betas, chains = [], [], {k: [] for k in names}
    for it in range(1, how.iterations + 1):
        resid += mu
        mu = rng.normal(resid.mean(), np.sqrt(var_e / n))
        resid -= mu
        if x.shape[1]:
            resid += x @ beta
            beta = inverse @ (x.T @ resid) + np.sqrt(var_e) * (root @ rng.normal(size=x.shape[1]))
            resid -= x @ beta
        for k in names:
            resid += u[k]
            ss = rank = 0
            for b in spectra[k]:
                d = b.u.T @ resid[b.rows]
                v = b.s * var[k] / (1 + b.s * var[k] * tau)
                z = rng.normal(tau * v * d, np.sqrt(v))
                u[k][b.rows] = b.u @ z
                ss, rank = ss + (z * z / b.s).sum(), rank + len(z)
            resid -= u[k]
            var[k] = (ss + how.df * prior[k]) / 2 / rng.gamma((rank + how.df) / 2)
        var_e = (resid @ resid + prior_e) / 2 / rng.gamma((n + how.df) / 2)
        tau = 1 / var_e
        if lost.any():
            fitted = y[lost] - resid[lost]
            y[lost] = fitted + rng.normal(0, np.sqrt(var_e), lost.sum())
            resid[lost] = y[lost] - fitted
        if it > how.burnin and it % how.thin == 0:
            saved.append({"iteration": it, "mu": mu, "residual": var_e, **{f"var_{k}": var[k] for k in names}})
            betas.append(beta.copy())
            for k in names:
                chains[k].append(u[k].copy())
    draws = pd.DataFrame(saved)
    stacked = {k: np.array(c) for k, c in chains.items()}
    effects = {k: c.mean(axis=0) for k, c in stacked.items()}
    observed = np.asarray(y, float).copy()
    observed[lost] = np.nan
    beta = np.mean(betas, axis=0)
    yhat = draws["mu"].mean() + x @ beta + sum(effects.values())
    return Fit(ks.obs, observed, float(draws["mu"].mean()), beta, effects, yhat, {k: float(draws[f"var_{k}"].mean()) for k in names}, float(draws["residual"].mean()), draws, stacked if how.keep_chains else {})


def kernel_model(y, data: pd.DataFrame, random: KernelSet, fixed: np.ndarray | None = None, how: Sampling = Sampling()) -> Fit:
    """Fit one chain on the driver; ``y`` is a column's name or values in the rows' order, missing values are predicted."""
    return sample(data[y].to_numpy(float) if isinstance(y, str) else y, random, fixed, how)


def varcomp_summary(fit: Fit, method: str = "postmean") -> pd.DataFrame:
    """Variances of G, E, GE and residual, entry-mean and plot heritability, and the genetic correlation over environments.

    ``postmean`` takes the variance of a role's posterior mean effects, summed over its kernels; ``gibbs`` the mean of the sampled variance of
    its first kernel. The residual is what they leave of the phenotypes' variance; where that is negative it warns and takes a small value.
    """
    parts = {"G": 0.0, "E": 0.0, "GE": 0.0}
    for role in parts:
        own = [k for k in fit.effects if roles(k) == role]
        if own:
            parts[role] = float(np.var(sum(fit.effects[k] for k in own), ddof=1)) if method == "postmean" else fit.variances[own[0]]
    total = float(np.nanvar(fit.y, ddof=1))
    resid = total - sum(parts.values())
    if resid < 0:
        warnings.warn(f"the components exceed the phenotypes' variance by {-resid:.4g}: the residual is set to a small value", stacklevel=2)
        resid = max(1e-6 * total, 1e-8)
    p, q = fit.data["gid"].nunique(), fit.data["env"].nunique()
    g, e, ge = parts["G"], parts["E"], parts["GE"]
    return pd.DataFrame([{"var_G": g, "var_E": e, "var_GE": ge, "var_resid": resid, "h2_entry": g / (g + e / q + ge / (p * q) + resid), "h2_plot": g / (g + ge + resid), "rg": g / (g + ge) if g + ge > 0 else np.nan, "few_environments": q < 20}])


def prediction_intervals(fit: Fit, x: np.ndarray | None = None, level: float = 0.95) -> pd.DataFrame:
    """(env, gid, yhat, lower, upper): quantiles of the saved draws of mean and kernel effects, with the fixed effects' mean."""
    if not fit.chains:
        raise ValueError("intervals need the chains: fit with keep_chains")
    draws = sum(fit.chains.values()) + fit.draws["mu"].to_numpy()[:, None] + (0.0 if x is None else x @ fit.beta)
    lower, upper = np.quantile(draws, [(1 - level) / 2, (1 + level) / 2], axis=0)
    return fit.data[["env", "gid"]].assign(yhat=fit.yhat, lower=lower, upper=upper)


def variance_intervals(value: float, df: float, level: float = 0.95) -> tuple[float, float]:
    """Chi-squared interval of a variance."""
    a = (1 - level) / 2
    return df * value / stats.chi2_quantile(1 - a, df), df * value / stats.chi2_quantile(a, df)


def genotype_effects(spark: SparkSession, fit: Fit) -> DataFrame:
    """(gid, mean, min, max, range, sd) of the summed posterior mean effects."""
    pdf = fit.data.assign(u=sum(fit.effects.values()))[["gid", "u"]]
    return spark.createDataFrame(pdf).groupBy("gid").agg(F.avg("u").alias("mean"), F.min("u").alias("min"), F.max("u").alias("max"), (F.max("u") - F.min("u")).alias("range"), F.stddev_samp("u").alias("sd"))


def reliability(fit: Fit) -> pd.DataFrame:
    """(env, gid, pev, reliability): variance of the genetic effects' draws, and one less its share of their variance."""
    genetic = [k for k in fit.chains if roles(k) in ("G", "GE")]
    draws = sum(fit.chains[k] for k in genetic)
    pev, var = draws.var(axis=0, ddof=1), np.var(draws.mean(axis=0), ddof=1)
    return fit.data.assign(pev=pev, reliability=np.clip(1 - pev / (var + pev.mean()), 0, 1))


def chain_frame(spark: SparkSession, fit: Fit, chain: int = 1) -> DataFrame:
    """(chain, draw, param, value) of the scalars of a chain."""
    long = fit.draws.drop(columns="iteration").reset_index(names="draw").melt("draw", var_name="param").assign(chain=chain)
    return spark.createDataFrame(long[["chain", "draw", "param", "value"]])


def rhat_ess(chains: DataFrame) -> DataFrame:
    """(param, rhat, ess, converged) of long chains (chain, draw, param, value): all by aggregates and a lag."""
    from pyspark.sql import Window

    by = chains.groupBy("param", "chain").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("l"))
    pooled = by.groupBy("param").agg(F.avg("v").alias("w"), F.var_samp("m").alias("vm"), F.avg("l").alias("l"), F.count("*").alias("n"))
    lagged = chains.withColumn("before", F.lag("value").over(Window.partitionBy("param", "chain").orderBy("draw")))
    rho = lagged.groupBy("param", "chain").agg(F.corr("value", "before").alias("r")).groupBy("param").agg(F.avg("r").alias("rho"))
    rhat = F.sqrt(((1 - 1 / F.col("l")) * F.col("w") + F.col("vm")) / F.nullif("w", F.lit(0.0)))
    ess = F.col("n") * F.col("l") * (1 - F.col("rho")) / (1 + F.col("rho"))
    return pooled.join(rho, "param").select("param", rhat.alias("rhat"), ess.alias("ess"), F.coalesce(rhat <= 1.05, F.lit(False)).alias("converged"))


def _tasks(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).repartitionByRange(n, "id")


def kernel_model_mc(spark: SparkSession, y, data: pd.DataFrame, random: KernelSet, chains: int = 3, how: Sampling = Sampling(), fixed: np.ndarray | None = None) -> DataFrame:
    """(chain, draw, param, value) of independent chains, one a task; see ``rhat_ess``."""
    values, ks = (data[y].to_numpy(float) if isinstance(y, str) else np.asarray(y, float)), decompose_kernels(random) if any(k.blocks is None for k in random.kernels.values()) else random

    def run(batches):
        for batch in batches:
            for i in batch["id"]:
                fit = sample(values, ks, fixed, Sampling(**{**how.__dict__, "seed": how.seed + int(i), "keep_chains": False}))
                long = fit.draws.drop(columns="iteration").reset_index(names="draw").melt("draw", var_name="param")
                yield long.assign(chain=int(i) + 1)[["chain", "draw", "param", "value"]]

    return _tasks(spark, chains).mapInPandas(run, "chain long, draw long, param string, value double")


def fold_ids(data: pd.DataFrame, folds: int = 5, scheme: str = "cv1", seed: int = 1) -> np.ndarray:
    """cv1 deals rows at random, cv0 whole environments."""
    rng = np.random.default_rng(seed)
    if scheme == "cv1":
        return rng.permutation(np.arange(len(data)) % folds)
    if scheme == "cv0":
        envs = rng.permutation(data["env"].unique())
        return data["env"].map({e: i % folds for i, e in enumerate(envs)}).to_numpy()
    raise ValueError(f"unknown scheme {scheme}")


def kernel_cv(spark: SparkSession, y, data: pd.DataFrame, random: KernelSet, folds: int = 5, scheme: str = "cv1", how: Sampling = Sampling(), seed: int = 1) -> DataFrame:
    """(fold, env, gid, observed, predicted): each fold masked and predicted by a task of its own; see ``cv_metrics``."""
    values = data[y].to_numpy(float) if isinstance(y, str) else np.asarray(y, float)
    fold, obs = fold_ids(random.obs, folds, scheme, seed), random.obs
    ks = decompose_kernels(random) if any(k.blocks is None for k in random.kernels.values()) else random

    def run(batches):
        for batch in batches:
            for i in batch["id"]:
                hidden = fold == i
                fit = sample(np.where(hidden, np.nan, values), ks, None, Sampling(**{**how.__dict__, "keep_chains": False}))
                yield pd.DataFrame({"fold": int(i) + 1, "env": obs["env"][hidden], "gid": obs["gid"][hidden], "observed": values[hidden], "predicted": fit.yhat[hidden]})

    return _tasks(spark, folds).mapInPandas(run, "fold long, env string, gid string, observed double, predicted double")


def cv_metrics(predictions: DataFrame) -> DataFrame:
    """(fold, n, accuracy, rmse), fold 0 for all together."""
    rows = predictions.select("fold", "observed", "predicted").union(predictions.select(F.lit(0).cast("long"), "observed", "predicted"))
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.corr("observed", "predicted").alias("accuracy"), F.sqrt(F.avg(F.pow(F.col("observed") - F.col("predicted"), F.lit(2.0)))).alias("rmse"))


def kernel_model_clustered(y, data: pd.DataFrame, random: KernelSet, clusters: Mapping[str, int], use: str = "block", pattern: str = "GE", fixed: np.ndarray | None = None, how: Sampling = Sampling()) -> Fit:
    """A fit with interactions inside clusters of environments only (block), cluster means as fixed effects (fixed), or both."""
    if use not in ("block", "fixed", "both"):
        raise ValueError(f"unknown use {use}")
    if use in ("block", "both"):
        random = mask_by_cluster(random, clusters, pattern)
    if use in ("fixed", "both"):
        c = random.obs["env"].map(clusters)
        dummies = pd.get_dummies(c, drop_first=True).to_numpy(float)
        fixed = dummies if fixed is None else np.column_stack([fixed, dummies])
    return kernel_model(y, data, random, fixed, how)


def cluster_environments(cor: pd.DataFrame, k: int | None = None, method: str = "hclust", distance: str = "one_minus", linkage: str = "ward.D2", k_range=range(2, 7), seed: int = 1) -> tuple[pd.DataFrame, dict[int, float]]:
    """(env, cluster, medoid) of environments by their correlation, k by the mean silhouette; and the silhouettes."""
    from agrolith.models import clustering

    r = cor.to_numpy(float)
    d = 1 - r if distance == "one_minus" else np.sqrt(np.maximum(1 - r, 0))
    np.fill_diagonal(d, 0)
    cut, tried = {}, {}
    for c in [k] if k else [c for c in k_range if c < len(d)]:
        if method == "hclust":
            cut[c] = clustering.cut_number(clustering.linkage(d, linkage), len(d), c)
        elif method == "pam":
            cut[c] = clustering.pam(d, c)[0]
        elif method == "kmeans":
            cut[c] = clustering.kmeans(clustering.classical_scaling(d, min(len(d) - 1, 10)), c, seed=seed)[0]
        else:
            raise ValueError(f"unknown method {method}")
        tried[c] = clustering.silhouette(d, cut[c])
    labels = cut[max(tried, key=lambda c: (tried[c], -c))]
    central = {c: np.flatnonzero(labels == c)[d[np.ix_(labels == c, labels == c)].sum(axis=1).argmin()] for c in np.unique(labels)}
    return pd.DataFrame({"env": cor.index, "cluster": labels + 1, "medoid": [central[c] == i for i, c in enumerate(labels)]}), tried
