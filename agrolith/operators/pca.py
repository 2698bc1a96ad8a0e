"""Principal components of covariables, their plots' data, and associations with other columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.models.stats import adjusted, correlation_p
from agrolith.operators.covariables import correlations, even_positions
from agrolith.operators.kernels import to_matrix
from agrolith.operators.tiles import moments
from agrolith.session import checkpointed


@dataclass
class Pca:
    """scores (env, PC, value), loadings (covariable, PC, value), variance (PC, sd, prop, cum). The greatest loading of a component is positive."""

    scores: DataFrame
    loadings: DataFrame
    variance: DataFrame


#: Most rows of the smaller side: its square reaches the driver.
MAX_SIDE = 4096


def _standard(w: DataFrame, center: bool, scale: bool, drop_constant: bool) -> DataFrame:
    """(env, covariable, value), centred and scaled by covariable; those that don't vary are left out."""
    spread = w.groupBy("covariable").agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd"))
    spread = spread.where("_sd > 1e-12 AND _sd < double('infinity')") if drop_constant else spread
    value = F.col("value") - (F.col("_mean") if center else F.lit(0.0))
    return w.join(spread, "covariable").select("env", "covariable", (value / F.col("_sd") if scale else value).alias("value"))


def env_pca(w: DataFrame, center: bool = True, scale: bool = True, rank: int | None = None, drop_constant: bool = True) -> Pca:
    """Components from the Gram matrix of the smaller side, environments or covariables.

    The Gram matrix is summed by tiles (``operators.tiles``), and it alone reaches the driver: at most ``MAX_SIDE`` rows, an error beyond. Its
    eigenvectors are one of scores and loadings; the other is a join of all cells with them. Of a component without variance the loadings are 0.
    """
    spark = w.sparkSession
    cells = checkpointed(w.select(F.col("env").cast("string").alias("env"), F.col("covariable").cast("string").alias("covariable"), F.col("value").cast("double").alias("value")))
    z = checkpointed(_standard(cells, center, scale, drop_constant))
    n, p, known = z.agg(F.countDistinct("env"), F.countDistinct("covariable"), F.count(F.when(F.col("value").isNotNull() & ~F.isnan("value"), 1))).first()
    if p == 0 or known != n * p or cells.select("env").distinct().count() != n:
        raise ValueError("principal components need complete covariables that vary")
    side, other = ("env", "covariable") if n <= p else ("covariable", "env")
    if min(n, p) > MAX_SIDE:
        raise ValueError(f"the smaller side has {min(n, p)} rows, more than {MAX_SIDE}")
    gram, names, _ = to_matrix(moments(z, side, other).select("i", "j", F.col("xy").alias("value")), "i", "j")
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    k = min(rank or len(values), len(values))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1][:, :k]
    share, s = values / values.sum(), np.sqrt(values[:k])
    seen = s > 1e-7 * s[0]
    pcs = [f"PC{i + 1}" for i in range(k)]
    # Coordinates on the smaller side, and what a cell of it adds to the other side's.
    onto = spark.createDataFrame([(name, [float(x) for x in v]) for name, v in zip(names, vectors, strict=True)], f"{side} string, onto array<double>")
    sums = z.join(onto, side).select(other, "value", F.posexplode("onto").alias("at", "x")).groupBy(other, "at").agg(F.sum(F.col("value") * F.col("x")).alias("value"))
    name = F.concat(F.lit("PC"), (F.col("at") + 1).cast("string")).alias("PC")
    length, here = F.get(F.array(*[F.lit(float(x)) for x in s]), F.col("at")), F.get(F.array(*[F.lit(bool(x)) for x in seen]), F.col("at"))
    own = onto.select(side, F.posexplode("onto").alias("at", "value"))
    if side == "env":
        scores, loadings = own.withColumn("value", F.col("value") * length), sums.withColumn("value", F.when(here, F.col("value") / length).otherwise(0.0))
    else:
        scores, loadings = sums, own
    loadings = checkpointed(loadings.select("covariable", name, "value"))
    sign = loadings.groupBy("PC").agg(F.max_by(F.signum("value"), F.struct(F.round(F.abs("value"), 12), F.col("covariable"))).alias("sign")).withColumn("sign", F.when(F.col("sign") < 0, -1.0).otherwise(1.0))
    turned = lambda df, key: df.join(F.broadcast(sign), "PC").select(key, "PC", (F.col("value") * F.col("sign")).alias("value"))  # noqa: E731  a row for each component
    variance = [(pc, i + 1, float(s[i] / np.sqrt(n - 1)), float(share[i]), float(share[: i + 1].sum())) for i, pc in enumerate(pcs)]
    return Pca(turned(scores.select("env", name, "value"), "env"), turned(loadings, "covariable"), spark.createDataFrame(variance, "PC string, pc_order int, sd double, prop double, cum double"))


def pca_scree(p: Pca, n: int = 15) -> DataFrame:
    return p.variance.orderBy("pc_order").limit(n)


def pca_biplot(p: Pca, pcs: tuple[str, str] = ("PC1", "PC2"), group: DataFrame | None = None) -> DataFrame:
    """(env, x, y[, group]); raises where a component is not there."""
    have = {r[0] for r in p.variance.select("PC").collect()}
    if not set(pcs) <= have:
        raise ValueError(f"no such component: {', '.join(sorted(set(pcs) - have))}")
    xy = p.scores.where(F.col("PC").isin(list(pcs))).groupBy("env").pivot("PC", list(pcs)).agg(F.first("value")).withColumnsRenamed({pcs[0]: "x", pcs[1]: "y"})
    return xy if group is None else xy.join(group, "env", "left")


def split_name(covariable: str, sep: str = "_") -> tuple[str, str]:
    """(factor, interval) of a covariable, at the last separator."""
    found = re.match(rf"^(.*){re.escape(sep)}([^{re.escape(sep)}]*)$", covariable)
    return (found[1], found[2]) if found else (covariable, "")


def cor_heatmap(w: DataFrame, order: str = "factor", most: int = 400, sep: str = "_") -> tuple[DataFrame, float]:
    """(i, j, r, i_order, j_order) of at most so many covariables, evenly thinned, in the order asked for; and the mean |r| of pairs."""
    names = [r[0] for r in w.select("covariable").distinct().collect()]
    keys = {"factor": lambda n: split_name(n, sep), "interval": lambda n: split_name(n, sep)[::-1], "none": lambda n: n}
    names.sort(key=keys[order])
    names = [names[i] for i in even_positions(len(names), most)]
    pairs = correlations(w.where(F.col("covariable").isin(names)))
    diagonal = w.sparkSession.createDataFrame([(n, n, 1.0) for n in names], pairs.schema)
    both = pairs.union(pairs.select("j", "i", "r")).union(diagonal)
    place = w.sparkSession.createDataFrame(list(enumerate(names, 1)), "place int, name string")
    a, b = place.select(F.col("name").alias("i"), F.col("place").alias("i_order")), place.select(F.col("name").alias("j"), F.col("place").alias("j_order"))
    return both.join(F.broadcast(a), "i").join(F.broadcast(b), "j"), pairs.agg(F.avg(F.abs("r"))).first()[0]


def _smooth(x: np.ndarray, y: np.ndarray, span: float) -> np.ndarray:
    """Local linear fits with tricube weights over the nearest share of the points."""
    k, out = max(3, int(np.ceil(span * len(x)))), np.empty(len(x))
    if len(x) <= 3:
        return y.copy()
    for i, at in enumerate(x):
        d = np.abs(x - at)
        h = max(np.sort(d)[min(k, len(x)) - 1], 1e-12)
        w = np.sqrt(np.clip(1 - (d / h) ** 3, 0, 1) ** 3 + 1e-12)
        fit = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x - at]) * w[:, None], y * w, rcond=None)[0]
        out[i] = fit[0]
    return out


def loading_curve(p: Pca, mids: Mapping[str, float] | DataFrame, pc: str = "PC1", factors: Sequence[str] | None = None, span: float = 0.4, sep: str = "_") -> DataFrame:
    """(covariable, factor, day, loading, smooth) of one component along the season; ``mids`` has each covariable's mid day."""
    spark = p.loadings.sparkSession
    if not isinstance(mids, DataFrame):
        mids = spark.createDataFrame([(k, float(v)) for k, v in mids.items()], "covariable string, mid double")
    cut = rf"^(.*){re.escape(sep)}[^{re.escape(sep)}]*$"
    long = p.loadings.where(F.col("PC") == pc).join(mids.select("covariable", F.col("mid").alias("day")), "covariable").select("covariable", F.regexp_extract("covariable", cut, 1).alias("factor"), "day", F.col("value").alias("loading"))
    if factors:
        long = long.where(F.col("factor").isin(list(factors)))

    def curve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        return pdf.assign(smooth=_smooth(pdf["day"].to_numpy(float), pdf["loading"].to_numpy(float), span))

    return long.groupBy("factor").applyInPandas(curve, "covariable string, factor string, day double, loading double, smooth double")


def pc_associate(p: Pca, y: DataFrame, n_pc: int = 9, method: str = "pearson", adjust: str = "BH") -> DataFrame:
    """(column, PC, r, p, p_adj, n): correlations of components with columns (env, column, value) over shared environments.

    p-values are adjusted over all pairs. Ordered by adjusted p and then strength.
    """
    pcs = [r[0] for r in p.variance.orderBy("pc_order").limit(n_pc).select("PC").collect()]
    both = p.scores.where(F.col("PC").isin(pcs)).select("env", "PC", F.col("value").alias("s")).join(y.select("env", "column", F.col("value").alias("v")), "env").where(F.col("v").isNotNull())
    if method == "spearman":
        from pyspark.sql import Window

        mean_rank = lambda c: F.rank().over(Window.partitionBy("PC", "column").orderBy(c)) + (F.count("*").over(Window.partitionBy("PC", "column", c)) - 1) / 2
        both = both.select("PC", "column", mean_rank("s").alias("s"), mean_rank("v").alias("v"))
    found = both.groupBy("column", "PC").agg(F.corr("s", "v").alias("r"), F.count("*").alias("n")).toPandas()
    found["p"] = [correlation_p(r, n) for r, n in zip(found["r"], found["n"], strict=True)]
    known = found["p"].notna()
    found["p_adj"] = np.nan
    found.loc[known, "p_adj"] = adjusted(found.loc[known, "p"].to_numpy(), adjust)
    found = found.sort_values(["p_adj", "r"], key=lambda s: -s.abs() if s.name == "r" else s, kind="stable")
    return p.scores.sparkSession.createDataFrame(found[["column", "PC", "r", "p", "p_adj", "n"]], "column string, PC string, r double, p double, p_adj double, n long")
