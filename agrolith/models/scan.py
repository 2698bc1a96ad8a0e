"""Predictions for untested sites and dates: kriging of posterior effects by covariables, and diagnostics of coverage."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.constants import POSITIONS
from agrolith.models.gibbs import Fit, roles, varcomp_summary
from agrolith.operators import shapes
from agrolith.operators.covariables import even_positions
from agrolith.operators.kernels import to_matrix
from agrolith.session import shared_folder

_PRED = "env string, gid string, yHat double, lower double, upper double, ci_width double, prob_win double"
_SITE = "env string, position string, n_outside int, prop_outside double, max_exceedance_sd double, mean_exceedance_sd double, mahalanobis double, mahalanobis_ratio double, max_similarity double, mean_similarity double, weight_sum double, weight_negativity double, effective_n_train double, divergence_index double, nearest_training_env string, spread double, mean_ci double, genetic_var double, genetic_lower double, genetic_upper double, genomic_h2 double"
_OVER = "env string, covariate string, value double, train_min double, train_max double, exceedance_sd double, direction string"


@dataclass
class Scan:
    """predictions (env, gid, yHat, lower, upper, ci_width, prob_win), sites (one row each), exceedances (env, covariate, ...)."""

    predictions: DataFrame
    sites: DataFrame
    exceedances: DataFrame

    def positions(self) -> DataFrame:
        return coverage_by_position(self.sites)


class _Training:
    """What tasks need to know of the fit: arrays of draws by genotypes and environments, and the training covariables."""

    def __init__(self, fit: Fit, w_train: DataFrame, standardize: bool, lam: float, level: float, max_draws: int):
        w, names, self.covs = to_matrix(w_train)
        self.envs = list(dict.fromkeys(fit.data["env"]))
        self.gids = sorted(fit.data["gid"].unique())
        lacking = [e for e in self.envs if e not in names]
        if lacking:
            raise ValueError(f"training environments without covariables: {', '.join(lacking)}")
        w = w[[names.index(e) for e in self.envs]]
        self.center, self.sd = w.mean(axis=0), w.std(axis=0, ddof=1)
        self.standardize = standardize
        self.w = self.scaled(w)
        p = w.shape[1]
        self.k = self.w @ self.w.T / p
        ridge = self.k + np.eye(len(self.k)) * (lam * np.diag(self.k).mean() + 1e-10)
        self.inverse = np.linalg.pinv(ridge, hermitian=True)
        use = None
        part = {}
        for role in ("E", "G", "GE"):
            own = [fit.chains[k] for k in fit.chains if roles(k) == role]
            part[role] = sum(own) if own else None
        if part["E"] is None:
            raise ValueError("the fit has no environment kernel with saved draws")
        use = even_positions(len(part["E"]), max_draws)
        ie, ig = pd.Index(self.envs).get_indexer(fit.data["env"]), pd.Index(self.gids).get_indexer(fit.data["gid"])
        g, e = len(self.gids), len(self.envs)

        def means(draws: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
            z = np.zeros((len(at), n))
            z[np.arange(len(at)), at] = 1
            count = z.sum(axis=0)
            return np.divide(draws @ z, count, out=np.zeros((len(draws), n)), where=count > 0)

        self.env_effects = means(part["E"][use], ie, e)
        self.gid_effects = means(part["G"][use], ig, g) if part["G"] is not None else np.zeros((len(use), g))
        self.cells = means(part["GE"][use], ie * g + ig, g * e).reshape(len(use), e, g) if part["GE"] is not None else None
        self.mu = float(np.nanmean(fit.y))
        self.residual = float(varcomp_summary(fit)["var_resid"].iloc[0])
        self.level = level
        centred = self.w - self.w.mean(axis=0)
        _, s, vt = np.linalg.svd(centred, full_matrices=False)
        keep = min(max(2, int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.95)) + 1), len(vt))
        self.axes = vt[:keep].T
        scores = self.w @ self.axes
        self.score_mean, self.score_sd = scores.mean(axis=0), scores.std(axis=0, ddof=1)
        self.score_sd[self.score_sd <= 0] = 1
        ref = np.quantile(np.sqrt((((scores - self.score_mean) / self.score_sd) ** 2).sum(axis=1)), 0.95)
        self.ref = ref if ref > 0 else max(np.sqrt(keep), 1)
        self.low, self.high, self.cov_sd = self.w.min(axis=0), self.w.max(axis=0), self.w.std(axis=0, ddof=1)
        self.cov_sd[self.cov_sd <= 0] = 1

    def scaled(self, w: np.ndarray) -> np.ndarray:
        if not self.standardize:
            return w
        out = (w - self.center) / np.where(self.sd > 0, self.sd, 1)
        return np.where(np.isfinite(out), out, 0.0)

    def site(self, name: str, raw: np.ndarray) -> tuple[pd.DataFrame, tuple, list[tuple]]:
        x, a = self.scaled(raw), (1 - self.level) / 2
        near = self.w @ x / len(x)
        h = near @ self.inverse
        genetic = self.gid_effects + (np.einsum("deg,e->dg", self.cells, h) if self.cells is not None else 0)
        y = self.mu + genetic + (self.env_effects @ h)[:, None]
        yhat, (lower, upper) = y.mean(axis=0), np.quantile(y, [a, 1 - a], axis=0)
        win = np.bincount(y.argmax(axis=1), minlength=len(self.gids)) / len(y)
        pred = pd.DataFrame({"env": name, "gid": self.gids, "yHat": yhat, "lower": lower, "upper": upper, "ci_width": upper - lower, "prob_win": win})
        var = genetic.var(axis=1, ddof=1)
        norm = np.sqrt(np.diag(self.k)) * np.sqrt(x @ x / len(x))
        similar = np.divide(near, norm, out=np.zeros_like(near), where=norm > 0)
        distance = float(np.sqrt((((x @ self.axes - self.score_mean) / self.score_sd) ** 2).sum()))
        ratio = distance / self.ref
        gap = np.maximum(np.maximum(self.low - x, x - self.high), 0) / self.cov_sd
        out = (x < self.low) | (x > self.high)
        n, share, worst = int(out.sum()), float(out.mean()), float(gap.max())
        position = POSITIONS[3] if ratio > 3 or share > 0.5 else POSITIONS[2] if ratio > 2 or share > 0.25 or worst > 1 else POSITIONS[1] if n or ratio > 1 else POSITIONS[0]
        divergence = float(np.clip(0.5 * (1 - similar.max()) + 0.5 * np.clip((ratio - 0.5) / 2, 0, 1), 0, 1))
        effective = float(np.abs(h).sum() ** 2 / max((h**2).sum(), 1e-300))
        row = (name, position, n, share, worst, float(gap[out].mean()) if n else 0.0, distance, ratio, float(similar.max()), float(similar.mean()), float(h.sum()), float(np.minimum(h, 0).sum()), effective, divergence, self.envs[int(similar.argmax())], float(yhat.std(ddof=1)), float((upper - lower).mean()), float(var.mean()), float(np.quantile(var, a)), float(np.quantile(var, 1 - a)), float(var.mean() / (var.mean() + self.residual)))
        over = [(name, self.covs[j], float(x[j]), float(self.low[j]), float(self.high[j]), float(gap[j]), "below" if x[j] < self.low[j] else "above") for j in np.flatnonzero(out)]
        return pred, row, over


def scan_untested_envs(fit: Fit, w_train: DataFrame, w_new: DataFrame, standardize: bool = True, lam: float = 1e-6, level: float = 0.95, max_draws: int = 500, envelope: str = "flag", envelope_level: str = "gross_extrapolation") -> Scan:
    """Predict every known genotype at new sites (env, covariable, value), with envelope diagnostics.

    Sites are spread over partitions; a task holds the cube of one site at a time. What to do with sites at or beyond
    ``envelope_level``: keep them, flag them, mask their predictions, or drop them.
    """
    spark, train = w_new.sparkSession, _Training(fit, w_train, standardize, lam, level, max_draws)
    rows = w_new.where(F.col("covariable").isin(train.covs)).groupBy("env").agg(F.map_from_entries(F.collect_list(F.struct("covariable", "value"))).alias("w"))
    shared = spark.sparkContext.broadcast(train)

    def run(batches):
        t = shared.value
        for batch in batches:
            for name, w in zip(batch["env"], batch["w"], strict=True):
                own = dict(w)
                pred, row, over = t.site(name, np.array([own.get(c, np.nan) for c in t.covs], float))
                yield pd.DataFrame({"predictions": [pred.to_dict("records")], "site": [[dict(zip(names, row, strict=True))]], "exceedances": [[dict(zip(over_names, x, strict=True)) for x in over]]})

    names = [c.split()[0] for c in _SITE.split(", ")]
    over_names = [c.split()[0] for c in _OVER.split(", ")]
    struct = lambda schema: f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>"
    # A site's cube is evaluated once: what comes of it is written, and its three tables are read from there.
    path = shared_folder(spark, "scan")
    rows.mapInPandas(run, f"predictions {struct(_PRED)}, site {struct(_SITE)}, exceedances {struct(_OVER)}").write.parquet(path)
    cubes = spark.read.parquet(path)
    predictions, sites, exceedances = (cubes.select(F.inline(c)) for c in ("predictions", "site", "exceedances"))
    ci_ref = sites.agg(F.median("mean_ci").alias("ref"))
    sites = sites.crossJoin(F.broadcast(ci_ref)).withColumns({"ci_width_ratio": F.col("mean_ci") / F.nullif("spread", F.lit(0.0)), "ci_inflation": F.col("mean_ci") / F.nullif("ref", F.lit(0.0))}).drop("ref")
    sites = sites.withColumn("flagged", F.array_position(F.array(*[F.lit(p) for p in POSITIONS]), F.col("position")) > POSITIONS.index(envelope_level))
    if envelope in ("mask", "drop"):
        predictions = predictions.join(sites.select("env", "flagged"), "env")
        if envelope == "drop":
            predictions = predictions.where(~F.col("flagged")).drop("flagged")
        else:
            predictions = predictions.select("env", "gid", *[F.when(~F.col("flagged"), F.col(c)).alias(c) for c in ("yHat", "lower", "upper", "ci_width", "prob_win")])
    elif envelope not in ("keep", "flag"):
        raise ValueError(f"unknown treatment {envelope}")
    return Scan(predictions, sites, exceedances)


def grid_scan(fit: Fit, w_train: DataFrame, w_new: DataFrame, chunk_size: int = 500, max_draws: int = 200, **more) -> Scan:
    """The scan for many sites, about so many a partition."""
    n = w_new.select("env").distinct().count()
    return scan_untested_envs(fit, w_train, w_new.repartition(max(1, -(-n // chunk_size)), "env"), max_draws=max_draws, **more)


# ---- tables of a scan ------------------------------------------------------------------------------------------------

_LEVEL = {p: i for i, p in enumerate(POSITIONS)}


def _at_or_beyond(level: str):
    return F.array_position(F.array(*[F.lit(p) for p in POSITIONS]), F.col("position")) > _LEVEL[level]


def planting_window_table(predictions: DataFrame, sites: DataFrame, dates: DataFrame, group: DataFrame | None = None) -> DataFrame:
    """(gid, env, date, yHat, lower, upper, ci_width, position, ...), by genotype and date; ``dates`` is (env, date), ``group`` (gid, group)."""
    out = predictions.join(dates.dropDuplicates(["env"]), "env").join(sites.select("env", "position", "mahalanobis_ratio"), "env", "left")
    if group is not None:
        out = out.join(group.dropDuplicates(["gid"]), "gid", "left")
    return out.orderBy("gid", "date")


def planting_window_curve(table: DataFrame, by: str | None = "gid") -> DataFrame:
    """Mean yHat, lower and upper by date (and key), with the position of the first site of a date."""
    keys = ["date", *([by] if by else [])]
    curve = table.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("yHat", "lower", "upper")])
    first = table.groupBy("date").agg(F.min_by("position", "env").alias("position"))
    return curve.join(first, "date", "left")


def best_planting_date(table: DataFrame, exclude_flagged: bool = True, level: str = "gross_extrapolation") -> DataFrame:
    """The date of each genotype's greatest yHat, of equals the first, and how many dates were considered."""
    kept = table.where(~F.coalesce(_at_or_beyond(level), F.lit(False))) if exclude_flagged else table
    w = Window.partitionBy("gid")
    ranked = kept.withColumn("r", F.row_number().over(w.orderBy(F.desc("yHat"), "date"))).withColumn("n_dates_considered", F.count("*").over(w))
    return ranked.where("r = 1").drop("r")


def scan_spatial_table(predictions: DataFrame, sites: DataFrame, coords: DataFrame) -> DataFrame:
    """Predictions with coordinates (env, lon, lat) and the site's envelope."""
    return predictions.join(coords.dropDuplicates(["env"]), "env").join(sites.select("env", "position", "divergence_index"), "env", "left")


def which_won_where(spatial: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(env, lon, lat, gid, yHat, winners): the best genotype, and all that win often enough, most often first."""
    top = Window.partitionBy("env").orderBy(F.desc("yHat"), "gid")
    best = spatial.withColumn("r", F.row_number().over(top)).where("r = 1").select("env", "lon", "lat", "gid", "yHat")
    often = spatial.where(F.col("prob_win") >= threshold).groupBy("env").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("prob_win")).alias("p"), "gid"))), lambda x: x["gid"]), ", ").alias("winners"))
    return best.join(often, "env", "left").withColumn("winners", F.coalesce("winners", "gid"))


def map_scan(spatial: DataFrame, kind: str = "performance", by: str = "gid", threshold: float = 0.25, clip: DataFrame | None = None, cell: float = 1.0) -> DataFrame:
    """The data of a map: performance by genotype or mean, coverage (one row a site), or which genotype won where.

    ``clip`` is a table of polygons (see ``operators.shapes``): sites outside all of them go, and it is an error if none is left.
    """
    if clip is not None:
        spatial = shapes.clipped(spatial, clip, cell)
        if spatial.isEmpty():
            raise ValueError("no site lies inside the polygons: do both use degrees?")
    if kind == "which_won_where":
        return which_won_where(spatial, threshold)
    if kind == "coverage":
        return spatial.groupBy("env", "lon", "lat").agg(F.first("position").alias("position"), F.first("divergence_index").alias("divergence_index"))
    if kind == "performance":
        return spatial if by == "gid" else spatial.groupBy("env", "lon", "lat").agg(F.avg("yHat").alias("yHat"))
    raise ValueError(f"unknown kind {kind}")


def within_polygon(points: DataFrame, polygon: list[tuple[float, float]], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points inside a polygon, by the parity of its edges to their east, after a test of the bounding box."""
    xs, ys = zip(*polygon)
    x, y, crossings = F.col(lon), F.col(lat), F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y1 != y2:
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings = crossings + (spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).cast("int")
    return points.where(x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1))


def coverage_by_position(sites: DataFrame) -> DataFrame:
    """(position, n, prop) for all four positions, those without sites too."""
    levels = sites.sparkSession.createDataFrame([(p, i) for i, p in enumerate(POSITIONS)], "position string, position_order int")
    counts = sites.groupBy("position").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return levels.join(counts, "position", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("prop", F.col("n") / F.nullif(total, F.lit(0))).orderBy("position_order")


def coverage_by_covariate(exceedances: DataFrame) -> DataFrame:
    return exceedances.groupBy("covariate").agg(F.count("*").alias("n"), F.max("exceedance_sd").alias("max_exceedance"), F.avg("exceedance_sd").alias("mean_exceedance")).orderBy(F.desc("n"), "covariate")


def coverage_summary(scan: Scan) -> tuple[DataFrame, DataFrame]:
    return coverage_by_position(scan.sites), coverage_by_covariate(scan.exceedances)

