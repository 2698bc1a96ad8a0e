"""Short texts and tables about results."""

from __future__ import annotations

from functools import singledispatch

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from agrolith.models.gibbs import Fit, roles, varcomp_summary
from agrolith.models.kernelset import KernelSet
from agrolith.models.scan import Scan, coverage_summary
from agrolith.models.simulate import Envirome, Markers, Met, off_diagonal
from agrolith.operators.covariables import Covariables
from agrolith.operators.groups import SoilZones
from agrolith.operators.pca import Pca
from agrolith.operators.risk import RiskProfile


def _table(title: str, rows) -> str:
    frame = rows if isinstance(rows, pd.DataFrame) else rows.toPandas()
    return f"{title}\n{frame.to_string(index=False)}"


@singledispatch
def report(x) -> str:
    """A text about a result."""
    return repr(x)


@report.register
def _(x: Covariables) -> str:
    sums = x.values.groupBy("env").agg(F.sum("value").alias("s")).agg(F.min("s"), F.max("s")).first()
    dropped = [r[0] for r in x.status.where("status LIKE 'removed%'").select("covariable").collect()]
    size = x.values.agg(F.countDistinct("env"), F.countDistinct("covariable")).first()
    return f"{size[0]} environments by {size[1]} covariables; row sums {sums[0]:.4g} to {sums[1]:.4g}; {len(dropped)} dropped: {', '.join(dropped[:10])}"


@report.register
def _(x: Pca) -> str:
    return _table("principal components", x.variance.orderBy("pc_order").limit(6))


@report.register
def _(x: RiskProfile) -> str:
    return _table("most frequent stress", x.top())


def report_delta(delta) -> str:
    """How many classes of a projected profile rise, fall or stay."""
    n = delta.agg(F.count_if(F.col("freq_diff") > 0), F.count_if(F.col("freq_diff") < 0), F.count_if(F.col("freq_diff") == 0)).first()
    return f"{n[0]} classes rise, {n[1]} fall, {n[2]} stay"


@report.register
def _(x: KernelSet) -> str:
    return _table("kernels", x.ranks())


@report.register
def _(x: Fit) -> str:
    return f"{x!r}\n" + _table("variance components", varcomp_summary(x))


@report.register
def _(x: Scan) -> str:
    by_position, by_covariate = coverage_summary(x)
    sites = x.sites.select("env", "position", "mahalanobis_ratio", "max_similarity", "nearest_training_env")
    return "\n".join([_table("sites", sites), _table("positions", by_position), _table("most exceeded", by_covariate.limit(5))])


@report.register
def _(x: SoilZones) -> str:
    return f"{x.zones.select('zone').distinct().count()} zones; the choice is {x.grade}; {x.zones.where('uncertain').count()} uncertain sites"


@report.register
def _(x: Met) -> str:
    h = f"heritability {x.h2_target.mean():.3f} asked, {x.h2_plot.mean():.3f} realised"
    return f"{x.mechanism}: {len(x.g)} genotypes by {x.g.shape[1]} environments; {h}; correlation {off_diagonal(x.target.to_numpy()).mean():.3f} asked, {off_diagonal(x.realised.to_numpy()).mean():.3f} realised"


@report.register
def _(x: Envirome) -> str:
    return f"{x.w.shape[0]} environments by {x.w.shape[1]} covariables; " + ", ".join(f"{k} {v:.3f}" for k, v in x.facts.items() if isinstance(v, float))


@report.register
def _(x: Markers) -> str:
    return f"{x.x.shape[0]} lines by {x.x.shape[1]} markers; " + ", ".join(f"{k} {v:.3f}" for k, v in x.diversity.items())


def recovery(x: Met | Envirome) -> pd.DataFrame:
    """(i, j, target, found): pairs of environments, as asked for and as they came out."""
    target = x.target if isinstance(x, Met) else x.correlation
    found = x.realised.to_numpy() if isinstance(x, Met) else x.kernel
    i, j = np.tril_indices(len(target), -1)
    names = np.array(target.index)
    return pd.DataFrame({"i": names[i], "j": names[j], "target": target.to_numpy()[i, j], "found": found[i, j]})


def env_summary(fit: Fit) -> pd.DataFrame:
    """(env, n, observed, predicted, correlation) of a fit."""
    rows = fit.data.assign(y=fit.y, yhat=fit.yhat)
    return rows.groupby("env").apply(lambda g: pd.Series({"n": len(g), "observed": g["y"].mean(), "predicted": g["yhat"].mean(), "correlation": g["y"].corr(g["yhat"])}), include_groups=False).reset_index()


def variance_proportions(fit: Fit, probs=(0.025, 0.5, 0.975)) -> pd.DataFrame:
    """(component, share quantiles): each variance's share of the sum, over draws."""
    parts = fit.draws[[c for c in fit.draws if c.startswith("var_") or c == "residual"]]
    share = parts.div(parts.sum(axis=1), axis=0)
    out = share.quantile(list(probs)).T.rename_axis("component").reset_index()
    out["role"] = [roles(c.removeprefix("var_")) if c != "residual" else "residual" for c in out["component"]]
    return out
