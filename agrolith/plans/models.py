"""Predictions, their tables, validation, components, groups and simulations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from agrolith.models import gibbs, kernelset, scan, simulate
from agrolith.operators import groups, kernels, pca, typing
from agrolith.plans.base import embedding_w, env_days, rounded, table
from agrolith.plans.weather import _PHENO, phenotypes

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# A scan made of the tables: predictions from line items, positions from keys.

_SCAN = """pr AS (SELECT 'N' || CAST(s_nationkey AS VARCHAR) AS env, p_brand AS gid, avg(l_extendedprice) AS yHat, min(l_extendedprice) AS lower, max(l_extendedprice) AS upper, avg(l_discount) * 5 AS prob_win FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
si AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS env, CASE n_nationkey % 5 WHEN 0 THEN 'edge' WHEN 1 THEN 'gross_extrapolation' ELSE 'interpolation' END AS position, n_nationkey / 10.0 AS mahalanobis_ratio, n_nationkey / 30.0 AS divergence_index FROM nation),
da AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS env, DATE '2024-01-01' + CAST(7 * (n_nationkey % 6) AS INTEGER) AS date FROM nation)"""


def _predictions(spark, sf_dir):
    line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    x = F.col("l_extendedprice")
    return joined.groupBy(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("env"), F.col("p_brand").alias("gid")).agg(F.avg(x).alias("yHat"), F.min(x).alias("lower"), F.max(x).alias("upper"), (F.avg("l_discount") * 5).alias("prob_win")).withColumn("ci_width", F.col("upper") - F.col("lower"))


def _nations(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), k.cast("string")).alias("env"), k)


def _sites(spark, sf_dir):
    k = F.col("n_nationkey")
    return _nations(spark, sf_dir).select("env", F.when(k % 5 == 0, "edge").when(k % 5 == 1, "gross_extrapolation").otherwise("interpolation").alias("position"), (k / 10.0).alias("mahalanobis_ratio"), (k / 30.0).alias("divergence_index"))


def _dates(spark, sf_dir):
    return _nations(spark, sf_dir).select("env", F.date_add(F.lit("2024-01-01").cast("date"), (7 * (F.col("n_nationkey") % 6)).cast("int")).alias("date"))


def _coords(spark, sf_dir):
    k = F.col("n_nationkey")
    return _nations(spark, sf_dir).select("env", (k * 3.0 - 40).alias("lon"), (k * 2.0 - 25).alias("lat"))


_CO = "co AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS env, n_nationkey * 3.0::DOUBLE - 40 AS lon, n_nationkey * 2.0::DOUBLE - 25 AS lat FROM nation)"


def _planting(spark, sf_dir):
    return scan.planting_window_table(_predictions(spark, sf_dir), _sites(spark, sf_dir), _dates(spark, sf_dir))


@query("planting_table", f"WITH {_SCAN} SELECT gid, env, date, round(yHat, 2) AS yHat, round(lower, 2) AS lower, round(upper, 2) AS upper, position FROM pr JOIN da USING (env) LEFT JOIN si USING (env)")
def planting_table(spark, sf_dir):
    return rounded(_planting(spark, sf_dir).select("gid", "env", "date", "yHat", "lower", "upper", "position"), 2)


@query("planting_curve", f"WITH {_SCAN}, t AS (SELECT * FROM pr JOIN da USING (env) LEFT JOIN si USING (env)), f AS (SELECT date, min_by(position, env) AS position FROM t GROUP BY 1) SELECT date, round(avg(yHat), 2) AS yHat, round(avg(lower), 2) AS lower, round(avg(upper), 2) AS upper, f.position FROM t JOIN f USING (date) GROUP BY date, f.position")
def planting_curve(spark, sf_dir):
    return rounded(scan.planting_window_curve(_planting(spark, sf_dir), None), 2)


@query("best_planting", f"WITH {_SCAN}, t AS (SELECT * FROM pr JOIN da USING (env) JOIN si USING (env) WHERE position <> 'gross_extrapolation'), r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY yHat DESC, date) AS k, count(*) OVER (PARTITION BY gid) AS n FROM t) SELECT gid, env, date, round(yHat, 2) AS yHat, n AS n_dates_considered FROM r WHERE k = 1")
def best_planting(spark, sf_dir):
    return rounded(scan.best_planting_date(_planting(spark, sf_dir)).select("gid", "env", "date", "yHat", "n_dates_considered"), 2)


@query("scan_spatial", f"WITH {_SCAN}, {_CO} SELECT env, gid, lon, lat, round(yHat, 2) AS yHat, position FROM pr JOIN co USING (env) LEFT JOIN si USING (env)")
def scan_spatial(spark, sf_dir):
    out = scan.scan_spatial_table(_predictions(spark, sf_dir), _sites(spark, sf_dir), _coords(spark, sf_dir))
    return rounded(out.select("env", "gid", "lon", "lat", "yHat", "position"), 2)


@query("who_won_where", f"WITH {_SCAN}, {_CO}, b AS (SELECT *, row_number() OVER (PARTITION BY env ORDER BY yHat DESC, gid) AS k FROM pr JOIN co USING (env)), o AS (SELECT env, string_agg(gid, ', ' ORDER BY prob_win DESC, gid) AS winners FROM pr WHERE prob_win >= 0.255 GROUP BY 1) SELECT env, lon, lat, gid, round(yHat, 2) AS yHat, coalesce(winners, gid) AS winners FROM b LEFT JOIN o USING (env) WHERE k = 1")
def who_won_where(spark, sf_dir):
    spatial = scan.scan_spatial_table(_predictions(spark, sf_dir), _sites(spark, sf_dir), _coords(spark, sf_dir))
    return rounded(scan.map_scan(spatial, "which_won_where", threshold=0.255), 2)


@query("map_coverage", f"WITH {_SCAN}, {_CO} SELECT env, lon, lat, position, round(divergence_index, 4) AS divergence_index FROM si JOIN co USING (env) WHERE env IN (SELECT env FROM pr)")
def map_coverage(spark, sf_dir):
    spatial = scan.scan_spatial_table(_predictions(spark, sf_dir), _sites(spark, sf_dir), _coords(spark, sf_dir))
    return rounded(scan.map_scan(spatial, "coverage"))


@query("sites_in_polygon", f"WITH {_CO} SELECT env FROM co WHERE lon > -20 AND lon < 10 AND lat > -12 AND lat < 12")
def sites_in_polygon(spark, sf_dir):
    return scan.within_polygon(_coords(spark, sf_dir), [(-20, -12), (10, -12), (10, 12), (-20, 12)]).select("env")


@query("coverage_by_position", f"WITH {_SCAN}, l AS (SELECT * FROM (VALUES ('interpolation', 0), ('edge', 1), ('mild_extrapolation', 2), ('gross_extrapolation', 3)) AS t(position, position_order)), c AS (SELECT position, count(*) AS n FROM si GROUP BY 1) SELECT position, position_order, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 4) AS prop FROM l LEFT JOIN c USING (position)")
def coverage_by_position(spark, sf_dir):
    return rounded(scan.coverage_by_position(_sites(spark, sf_dir)))


@query("coverage_by_covariate", "SELECT p_brand AS covariate, count(*) AS n, max(p_retailprice) AS max_exceedance, round(avg(p_retailprice), 4) AS mean_exceedance FROM part GROUP BY 1")
def coverage_by_covariate(spark, sf_dir):
    out = table(spark, sf_dir, "part").select(F.col("p_brand").alias("covariate"), F.col("p_retailprice").alias("exceedance_sd"))
    return rounded(scan.coverage_by_covariate(out))


@query("cv_folds_metrics", "WITH p AS (SELECT o_orderkey % 5 + 1 AS fold, o_totalprice AS observed, o_totalprice * 0.8 + o_custkey AS predicted FROM orders), a AS (SELECT * FROM p UNION ALL SELECT 0, observed, predicted FROM p) SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n, round(corr(observed, predicted), 6) AS accuracy, round(sqrt(avg(pow(observed - predicted, 2))), 2) AS rmse FROM a GROUP BY 1")
def cv_folds_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5 + 1).alias("fold"), F.col("o_totalprice").alias("observed"), (F.col("o_totalprice") * 0.8 + F.col("o_custkey")).alias("predicted"))
    return gibbs.cv_metrics(o).select("fold", "n", F.round("accuracy", 6).alias("accuracy"), F.round("rmse", 2).alias("rmse"))


@query("rhat_ess", """WITH c AS (SELECT event_type AS param, user_id % 3 AS chain, event_id AS draw, value FROM events), b AS (SELECT param, chain, avg(value) AS m, var_samp(value) AS v, count(*) AS l FROM c GROUP BY 1, 2), g AS (SELECT *, lag(value) OVER (PARTITION BY param, chain ORDER BY draw) AS pv FROM c), r AS (SELECT param, avg(r) AS rho FROM (SELECT param, chain, corr(value, pv) AS r FROM g WHERE pv IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT param, avg(v) AS w, var_samp(m) AS vm, avg(l) AS l, count(*) AS n FROM b GROUP BY 1) SELECT param, round(sqrt(((1 - 1 / l) * w + vm) / w), 6) AS rhat, round(n * l * (1 - rho) / (1 + rho), 2) AS ess, sqrt(((1 - 1 / l) * w + vm) / w) <= 1.05 AS converged FROM p JOIN r USING (param)""")
def rhat_ess(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("param"), (F.col("user_id") % 3).alias("chain"), F.col("event_id").alias("draw"), "value")
    return gibbs.rhat_ess(ev).select("param", F.round("rhat", 6).alias("rhat"), F.round("ess", 2).alias("ess"), "converged")


@query("genotype_effects", f"WITH {_PHENO} SELECT gid, round(avg(value), 3) AS mean, round(min(value), 3) AS min, round(max(value), 3) AS max, round(max(value) - min(value), 3) AS range, round(stddev_samp(value), 3) AS sd FROM p GROUP BY 1")
def genotype_effects(spark, sf_dir):
    v = F.col("value")
    out = phenotypes(spark, sf_dir).groupBy("gid").agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"), F.stddev_samp(v).alias("sd"))
    return rounded(out, 3)


@query("kernel_expanded", f"""WITH {_PHENO}, o AS (SELECT env || ':' || gid AS obs, CAST(substr(env, 8) AS INTEGER) % 10 AS k FROM p), e AS (SELECT label AS k, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings), w AS (SELECT k, pos, round(avg(CAST(x AS DOUBLE)), 6) AS v FROM e GROUP BY 1, 2),
l AS (SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS v FROM w a JOIN w b USING (pos) GROUP BY 1, 2), n AS (SELECT i, j, v / avg(CASE WHEN i = j THEN v END) OVER () AS v FROM l) SELECT a.obs AS i, b.obs AS j, round(v, 4) AS value FROM n JOIN o a ON a.k = n.i JOIN o b ON b.k = n.j""")
def kernel_expanded(spark, sf_dir):
    """Cells of all observations: environments by genotypes, two environments or more to a label."""
    obs = phenotypes(spark, sf_dir).select(F.concat_ws(":", "env", "gid").alias("obs"), F.concat(F.lit("L"), (F.substring("env", 8, 9).cast("int") % 10).cast("string")).alias("env"))
    return rounded(kernels.expanded(kernels.linear_kernel(embedding_w(spark, sf_dir)), obs))


# ---- models and what SQL can't express -------------------------------------------------------------------------------


def _field(spark, sf_dir) -> pd.DataFrame:
    rows = phenotypes(spark, sf_dir).where("value IS NOT NULL").toPandas().sort_values(["env", "gid"]).reset_index(drop=True)
    rows["value"] = (rows["value"] - rows["value"].mean()) / rows["value"].std()
    return rows


_HOW = gibbs.Sampling()


@query("kernel_model")
def kernel_model(spark, sf_dir):
    data = _field(spark, sf_dir)
    fit = gibbs.kernel_model("value", data, kernelset.get_kernel(data, model="EMDs"), how=_HOW)
    return spark.createDataFrame(data.assign(yhat=fit.yhat))


@query("varcomp_summary")
def varcomp_summary(spark, sf_dir):
    data = _field(spark, sf_dir)
    return spark.createDataFrame(gibbs.varcomp_summary(gibbs.kernel_model("value", data, kernelset.get_kernel(data, model="EMDs"), how=_HOW)))


@query("kernel_cv")
def kernel_cv(spark, sf_dir):
    data = _field(spark, sf_dir)
    return gibbs.cv_metrics(gibbs.kernel_cv(spark, "value", data, kernelset.get_kernel(data, model="EMM"), how=_HOW))


@query("kernel_model_mc")
def kernel_model_mc(spark, sf_dir):
    data = _field(spark, sf_dir)
    return gibbs.rhat_ess(gibbs.kernel_model_mc(spark, "value", data, kernelset.get_kernel(data, model="EMM"), 3, _HOW))


@query("kernel_model_clustered")
def kernel_model_clustered(spark, sf_dir):
    data = _field(spark, sf_dir)
    clusters = {e: i % 2 for i, e in enumerate(sorted(data["env"].unique()))}
    fit = gibbs.kernel_model_clustered("value", data, kernelset.get_kernel(data, model="RNMM"), clusters, "both", how=_HOW)
    return spark.createDataFrame(data.assign(yhat=fit.yhat))


@query("scan_untested")
def scan_untested(spark, sf_dir):
    met = simulate.sim_met(K=simulate.sim_markers(20, 100, seed=1).g, C=simulate.sim_met_C(8, structure="ar1", rho=0.6), h2=0.6, seed=2)
    data, w = met.data.sort_values(["env", "gid"]).reset_index(drop=True), simulate.sim_W(met.target, n_var=64, seed=3)
    ke = pd.DataFrame(simulate.gram(w.w.to_numpy()), w.w.index, w.w.index)
    fit = gibbs.kernel_model("value", data, kernelset.get_kernel(data, met.kinship, ke, "RNMM"), how=_HOW)
    new = embedding_w(spark, sf_dir).withColumn("covariable", F.concat(F.lit("V"), F.substring("covariable", 2, 2).cast("int").cast("string")))
    spread = F.stddev_samp("value").over(Window.partitionBy("covariable"))
    return scan.scan_untested_envs(fit, w.to_spark(spark), new.withColumn("value", F.col("value") / spread)).predictions


@query("env_pca")
def env_pca(spark, sf_dir):
    return rounded(pca.env_pca(embedding_w(spark, sf_dir)).variance)


@query("pc_associate")
def pc_associate(spark, sf_dir):
    w = embedding_w(spark, sf_dir)
    return pca.pc_associate(pca.env_pca(w), w.select("env", F.col("covariable").alias("column"), "value"))


@query("loading_curve")
def loading_curve(spark, sf_dir):
    out = typing.env_indices(env_days(spark, sf_dir), variables=["T2M_MAX", "T2M_MIN", "PRECTOT"], end_day=30, require_complete=False)
    return pca.loading_curve(pca.env_pca(out.select("env", "covariable", "value")), out.select("covariable", "mid").distinct())


@query("env_cluster")
def env_cluster(spark, sf_dir):
    return groups.env_cluster(embedding_w(spark, sf_dir)).clusters


@query("env_target_importance")
def env_target_importance(spark, sf_dir):
    w = embedding_w(spark, sf_dir)
    return groups.env_target_importance(w.where("covariable <= 'v32'"), w.where("covariable > 'v32'"), k=3, trees=50)[0]  # half are the target, half what explains it


@query("mined_types")
def mined_types(spark, sf_dir):
    days = env_days(spark, sf_dir).withColumn("interval", F.lit("season"))
    return groups.mine_types(days, ["T2M_MAX", "PRECTOT"], "univariate")[0]


@query("soil_classification")
def soil_classification(spark, sf_dir):
    v = F.col("embedding")
    sites = table(spark, sf_dir, "embeddings").groupBy(F.concat(F.lit("S"), (F.col("vec_id") % 60).cast("string")).alias("env")).agg(*[F.avg(v[i].cast("double")).alias(f"p{i}") for i in range(64)])
    return groups.soil_classification(sites, [f"p{i}" for i in range(64)], groups=range(1, 5), pca=True, pca_var=0.5).zones


@query("sim_met")
def sim_met(spark, sf_dir):
    return simulate.sim_met(K=simulate.sim_markers(25, 200, seed=1).g, n_env=8, n_rep=2, seed=4).to_spark(spark)


@query("sim_envirome")
def sim_envirome(spark, sf_dir):
    return simulate.sim_envirome(12, 10, "clusters", seed=3).to_spark(spark)
