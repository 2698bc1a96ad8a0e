"""Log-ratios, correlations in order, kernel sets, simulations, mined types, streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from agrolith.functions import composition
from agrolith.models import gibbs, kernelset, reports, scan, simulate
from agrolith.operators import copula, groups, kernels, pca, water
from agrolith.plans import phenology
from agrolith.plans.base import EMBEDDING_W, ENV_DAYS, embedding_w, env_days, rounded, table
from agrolith.plans.models import _HOW, _field
from agrolith.plans.weather import _PHENO, phenotypes
from agrolith.session import shared_folder
from agrolith.streaming import days as streams

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# ---- parts of a whole ------------------------------------------------------------------------------------------------

_PARTS = """x AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS a, p_retailprice / 50 AS b, CAST(p_partkey % 3 AS DOUBLE) * 10 AS c FROM part), m AS (SELECT *, least(CASE WHEN a > 0 THEN a END, CASE WHEN b > 0 THEN b END, CASE WHEN c > 0 THEN c END) AS lo FROM x),
f AS (SELECT k, ln(CASE WHEN a > 0 THEN a ELSE 0.65 * lo END) AS a, ln(CASE WHEN b > 0 THEN b ELSE 0.65 * lo END) AS b, ln(CASE WHEN c > 0 THEN c ELSE 0.65 * lo END) AS c FROM m), r AS (SELECT k, a - (a + b + c) / 3 AS a, b - (a + b + c) / 3 AS b, c - (a + b + c) / 3 AS c FROM f)"""


def _parts(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 50).alias("b"), ((k % 3).cast("double") * 10).alias("c"))


@query("clr_parts", f"WITH {_PARTS} SELECT k, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM r")
def clr_parts(spark, sf_dir):
    found = composition.clr([F.col(c) for c in "abc"])
    return rounded(_parts(spark, sf_dir).select("k", *[x.alias(c) for x, c in zip(found, "abc", strict=True)]), 6)


@query("ilr_parts", f"WITH {_PARTS} SELECT k, round(sqrt(0.5) * (a - b), 6) AS ilr_1, round(sqrt(2.0 / 3) * ((a + b) / 2 - c), 6) AS ilr_2 FROM r")
def ilr_parts(spark, sf_dir):
    found = composition.ilr([F.col(c) for c in "abc"])
    return rounded(_parts(spark, sf_dir).select("k", *[x.alias(f"ilr_{i}") for i, x in enumerate(found, 1)]), 6)


# ---- components and correlations -------------------------------------------------------------------------------------


@query("cor_heatmap", f"""WITH {EMBEDDING_W}, c AS (SELECT a.covariable AS i, b.covariable AS j, CASE WHEN a.covariable = b.covariable THEN 1.0 ELSE corr(a.value, b.value) END AS r FROM w a JOIN w b USING (env) GROUP BY 1, 2),
n AS (SELECT covariable, CAST(row_number() OVER (ORDER BY covariable) AS INTEGER) AS place FROM (SELECT DISTINCT covariable FROM w)) SELECT i, j, round(r, 4) AS r, p.place AS i_order, q.place AS j_order FROM c JOIN n p ON p.covariable = i JOIN n q ON q.covariable = j""")
def cor_heatmap(spark, sf_dir):
    return rounded(pca.cor_heatmap(embedding_w(spark, sf_dir))[0])


@query("pca_totals", f"WITH {EMBEDDING_W} SELECT least(count(DISTINCT env), count(DISTINCT covariable)) AS components, CAST(count(DISTINCT covariable) AS DOUBLE) AS variance, 1.0::DOUBLE AS share FROM w")
def pca_totals(spark, sf_dir):
    """Variances of the components add up to the number of standardised covariables."""
    variance = pca.env_pca(embedding_w(spark, sf_dir)).variance
    return rounded(variance.agg(F.count("*").alias("components"), F.sum(F.col("sd") * F.col("sd")).alias("variance"), F.sum("prop").alias("share")), 6)


@query("pca_score_moments", f"WITH {EMBEDDING_W}, z AS (SELECT env, (value - avg(value) OVER v) / stddev_samp(value) OVER v AS z FROM w WINDOW v AS (PARTITION BY covariable)) SELECT env, round(sum(z * z), 4) AS length FROM z GROUP BY 1")
def pca_score_moments(spark, sf_dir):
    """An environment's scores are as long as its standardised covariables."""
    scores = pca.env_pca(embedding_w(spark, sf_dir)).scores
    return rounded(scores.groupBy("env").agg(F.sum(F.col("value") * F.col("value")).alias("length")))


@query("pca_scree")
def pca_scree(spark, sf_dir):
    return rounded(pca.pca_scree(pca.env_pca(embedding_w(spark, sf_dir))))


@query("pca_biplot")
def pca_biplot(spark, sf_dir):
    return rounded(pca.pca_biplot(pca.env_pca(embedding_w(spark, sf_dir))))


@query("copula_ties_max", f"WITH {ENV_DAYS}, w AS (SELECT env, 'T2M' AS covariable, round(avg(T2M)) AS value FROM d GROUP BY 1) SELECT env, 'cop_u_' || covariable AS covariable, round((rank() OVER (PARTITION BY covariable ORDER BY value) + count(*) OVER (PARTITION BY covariable, value) - 1) / CAST(count(*) OVER (PARTITION BY covariable) + 1 AS DOUBLE), 6) AS value FROM w")
def copula_ties_max(spark, sf_dir):
    w = env_days(spark, sf_dir).groupBy("env").agg(F.round(F.avg("T2M")).alias("value")).select("env", F.lit("T2M").alias("covariable"), "value")
    return rounded(copula.env_copula(w, ties="max"), 6)


# ---- kernel sets -----------------------------------------------------------------------------------------------------


@query("kernel_ranks", f"WITH {_PHENO}, q AS (SELECT * FROM p WHERE value IS NOT NULL) SELECT 'KE_E' AS kernel, 'D' AS type, count(*) AS n, count(DISTINCT env) AS rank FROM q UNION ALL SELECT 'KG_G', 'D', count(*), count(DISTINCT gid) FROM q UNION ALL SELECT 'KGE_GE', 'BD', count(*), count(*) FROM q")
def kernel_ranks(spark, sf_dir):
    data = _field(spark, sf_dir)
    return spark.createDataFrame(kernelset.get_kernel(data, model="EMDs").ranks(), "kernel string, type string, n long, rank long")


@query("kernel_decomposed_ranks", f"WITH {_PHENO}, q AS (SELECT * FROM p WHERE value IS NOT NULL) SELECT 'KE_E' AS kernel, 'D' AS type, count(*) AS n, count(DISTINCT env) AS rank FROM q UNION ALL SELECT 'KG_G', 'D', count(*), count(DISTINCT gid) FROM q")
def kernel_decomposed_ranks(spark, sf_dir):
    dense = kernelset.get_kernel(_field(spark, sf_dir), model="EMM", engine="dense")
    return spark.createDataFrame(kernelset.decompose_kernels(dense, tol=1e-8).ranks(), "kernel string, type string, n long, rank long")


@query("kernel_set_dense", f"""WITH {_PHENO}, q AS (SELECT * FROM p WHERE value IS NOT NULL), e AS (SELECT count(*) AS n FROM q) SELECT a.env || ':' || a.gid AS i, b.env || ':' || b.gid AS j, CASE WHEN a.env = b.env THEN 1.0 ELSE 0.0 END::DOUBLE AS ke, CASE WHEN a.gid = b.gid THEN 1.0 ELSE 0.0 END::DOUBLE AS kg FROM q a, q b""")
def kernel_set_dense(spark, sf_dir):
    """Cells of the dense kernels that the factored ones stand for."""
    data = _field(spark, sf_dir)
    dense = kernelset.undecompose_kernels(kernelset.get_kernel(data, model="EMM")).kernels
    names, n = (data["env"] + ":" + data["gid"]).to_numpy(), len(data)
    cells = {"i": names.repeat(n), "j": list(names) * n, "ke": dense["KE_E"].dense.ravel(), "kg": dense["KG_G"].dense.ravel()}
    return rounded(spark.createDataFrame(pd.DataFrame(cells)), 6).select("i", "j", F.abs("ke").alias("ke"), F.abs("kg").alias("kg"))


@query("kernel_truncated")
def kernel_truncated(spark, sf_dir):
    data = _field(spark, sf_dir)
    cut = kernelset.truncate_gxe_kernel(kernelset.get_kernel(data, model="EMDs", engine="dense"), 0.75)
    return spark.createDataFrame(kernelset.decompose_kernels(cut, tol=1e-6).ranks(), "kernel string, type string, n long, rank long")


@query("env_kernel_merged", f"""WITH {EMBEDDING_W}, s AS (SELECT covariable FROM w GROUP BY 1 HAVING stddev_samp(value) <= 0.5), v AS (SELECT * FROM w WHERE covariable IN (SELECT covariable FROM s)), k0 AS (SELECT a.env AS i, b.env AS j, sum(a.value * b.value) AS v FROM v a JOIN v b USING (covariable) GROUP BY 1, 2),
k AS (SELECT i, j, round(v / avg(CASE WHEN i = j THEN v END) OVER (), 5) AS value FROM k0), {_PHENO}, o AS (SELECT env || ':' || gid AS obs, 'L' || CAST(CAST(substr(env, 8) AS INTEGER) % 10 AS VARCHAR) AS env FROM p) SELECT a.obs AS i, b.obs AS j, round(value, 4) AS value FROM k JOIN o a ON a.env = k.i JOIN o b ON b.env = k.j""")
def env_kernel_merged(spark, sf_dir):
    obs = phenotypes(spark, sf_dir).select(F.concat_ws(":", "env", "gid").alias("obs"), F.concat(F.lit("L"), (F.substring("env", 8, 9).cast("int") % 10).cast("string")).alias("env"))
    return rounded(kernels.env_kernel(embedding_w(spark, sf_dir), sd_tol=0.5, observations=obs)["env_cov"])


# ---- fits ------------------------------------------------------------------------------------------------------------


def _fit(spark, sf_dir):
    data = _field(spark, sf_dir)
    return gibbs.kernel_model("value", data, kernelset.get_kernel(data, model="EMDs"), how=_HOW)


@query("fit_env_summary")
def fit_env_summary(spark, sf_dir):
    return rounded(spark.createDataFrame(reports.env_summary(_fit(spark, sf_dir))))


@query("fit_variance_proportions")
def fit_variance_proportions(spark, sf_dir):
    out = reports.variance_proportions(_fit(spark, sf_dir))
    return spark.createDataFrame(out.set_axis([str(c) if not isinstance(c, float) else f"q{c:g}".replace(".", "_") for c in out.columns], axis=1))


@query("cluster_environments")
def cluster_environments(spark, sf_dir):
    wide = _field(spark, sf_dir).pivot_table(index="gid", columns="env", values="value")
    return spark.createDataFrame(gibbs.cluster_environments(wide.corr())[0])


# ---- simulations -----------------------------------------------------------------------------------------------------


def _long_correlation(spark, c: simulate.Correlation):
    frame = c.frame().rename_axis("i").reset_index().melt("i", var_name="j", value_name="r")
    return rounded(spark.createDataFrame(frame), 6)


@query("sim_met_c_ar1", "SELECT 'E' || CAST(i AS VARCHAR) AS i, 'E' || CAST(j AS VARCHAR) AS j, round(pow(0.6, abs(i - j)), 6) AS r FROM range(1, 26) a(i), range(1, 26) b(j)")
def sim_met_c_ar1(spark, sf_dir):
    return _long_correlation(spark, simulate.sim_met_C(25, structure="ar1", rho=0.6))


@query("sim_met_c_equi", "SELECT 'E' || CAST(i AS VARCHAR) AS i, 'E' || CAST(j AS VARCHAR) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.4 END::DOUBLE AS r FROM range(1, 26) a(i), range(1, 26) b(j)")
def sim_met_c_equi(spark, sf_dir):
    return _long_correlation(spark, simulate.sim_met_C(25, structure="equi"))


@query("sim_met_c_block", "SELECT 'E' || CAST(i AS VARCHAR) AS i, 'E' || CAST(j AS VARCHAR) AS j, CASE WHEN i = j THEN 1.0 WHEN i % 3 = j % 3 THEN 0.7 ELSE 0.1 END::DOUBLE AS r FROM range(1, 26) a(i), range(1, 26) b(j)")
def sim_met_c_block(spark, sf_dir):
    return _long_correlation(spark, simulate.sim_met_C(25, structure="block", rho=0.7, between=0.1, n_blocks=3))


@query("sim_w")
def sim_w(spark, sf_dir):
    return simulate.sim_W(simulate.sim_met_C(12, structure="ar1", rho=0.6), noise=0.2, n_var=30, seed=1).to_spark(spark)


@query("sim_w_grid")
def sim_w_grid(spark, sf_dir):
    return simulate.sim_W_grid(spark, simulate.sim_met_C(8, structure="equi", rho=0.5), (0.1, 0.4), (10, 30), (0.0, 0.5), n_rep=3)


@query("sim_markers")
def sim_markers(spark, sf_dir):
    x = simulate.sim_markers(40, 60, n_subpop=2, fst=0.2, seed=5).x
    return spark.createDataFrame(x.rename_axis("gid").reset_index().melt("gid", var_name="marker", value_name="dose"))


@query("grid_scan")
def grid_scan(spark, sf_dir):
    met = simulate.sim_met(K=simulate.sim_markers(20, 100, seed=1).g, C=simulate.sim_met_C(8, structure="ar1", rho=0.6), h2=0.6, seed=2)
    data, w = met.data.sort_values(["env", "gid"]).reset_index(drop=True), simulate.sim_W(met.target, n_var=64, seed=3)
    ke = pd.DataFrame(simulate.gram(w.w.to_numpy()), w.w.index, w.w.index)
    fit = gibbs.kernel_model("value", data, kernelset.get_kernel(data, met.kinship, ke, "RNMM"), how=_HOW)
    new = embedding_w(spark, sf_dir).withColumn("covariable", F.concat(F.lit("V"), F.substring("covariable", 2, 2).cast("int").cast("string")))
    spread = F.stddev_samp("value").over(Window.partitionBy("covariable"))
    return scan.grid_scan(fit, w.to_spark(spark), new.withColumn("value", F.col("value") / spread), chunk_size=4).sites


# ---- mined types -----------------------------------------------------------------------------------------------------


def _mined(spark, sf_dir, mode: str):
    days = env_days(spark, sf_dir).withColumn("interval", F.lit("season"))
    return groups.mine_types(days, ["T2M_MAX", "T2M_MIN", "PRECTOT"], mode)[0]


@query("mined_types_total", f"WITH {ENV_DAYS}, v AS (SELECT env, unnest(['T2M_MAX', 'T2M_MIN', 'PRECTOT']) AS feature_set FROM d) SELECT env, feature_set, count(*) AS days FROM v GROUP BY 1, 2")
def mined_types_total(spark, sf_dir):
    """Every day of an environment is of one type of each variable."""
    return _mined(spark, sf_dir, "univariate").groupBy("env", "feature_set").agg(F.sum("freq").cast("long").alias("days"))


@query("mined_types_joint")
def mined_types_joint(spark, sf_dir):
    return _mined(spark, sf_dir, "joint")


@query("mined_types_combine")
def mined_types_combine(spark, sf_dir):
    return _mined(spark, sf_dir, "combine")


# ---- streams: all that a folder of files holds -----------------------------------------------------------------------


def _stream(spark, df):
    """A table written to the shared folder and read as a stream of files."""
    path = shared_folder(spark, "stream")
    df.write.parquet(f"{path}/in")
    return streams.day_stream(spark, f"{path}/in", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)), path


@query("stream_thermal_time", f"WITH {ENV_DAYS}, t AS (SELECT env, CAST(date_diff('day', DATE '2024-01-01', date) AS INTEGER) AS day, greatest((least(greatest(T2M_MAX, 8), 30) + least(greatest(T2M_MIN, 8), 30)) / 2 - 8, 0) AS g FROM d) SELECT env, day, round(g, 4) AS dTT, round(sum(g) OVER (PARTITION BY env ORDER BY day), 3) AS cumTT FROM t")
def stream_thermal_time(spark, sf_dir):
    days = env_days(spark, sf_dir).select("env", F.datediff("date", F.lit("2024-01-01").cast("date")).alias("day"), "T2M_MAX", "T2M_MIN")
    source, path = _stream(spark, days)
    out = streams.drained(streams.running_thermal_time(source, 8.0, 30.0), path)
    return out.select("env", "day", F.round("dTT", 4).alias("dTT"), F.round("cumTT", 3).alias("cumTT"))


@query("stream_soil_water", f"WITH RECURSIVE {phenology._WATER} SELECT env, day, round(ks, 4) AS ks, round(drainage, 4) AS drainage, round(dr, 4) AS depletion FROM bal")
def stream_soil_water(spark, sf_dir):
    source, path = _stream(spark, water.daily_demand(phenology._water_days(spark, sf_dir), phenology._capacity(spark)))
    return rounded(streams.drained(streams.running_water(source), path))


@query("stream_stress_runs", f"WITH {ENV_DAYS}, h AS (SELECT env, date, date_diff('day', DATE '2024-01-01', date) - row_number() OVER (PARTITION BY env ORDER BY date) AS g FROM d WHERE T2M_MAX > 29), r AS (SELECT env, min(date) AS first, max(date) AS last, count(*) AS n FROM h GROUP BY env, g), e AS (SELECT max(date) AS top FROM d WHERE T2M_MAX > 29) SELECT env, first, last, n FROM r, e WHERE date_diff('hour', CAST(last AS TIMESTAMP), CAST(top AS TIMESTAMP)) >= 36 + 24")
def stream_stress_runs(spark, sf_dir):
    """Runs that ended by the watermark: a day before the last day seen, less what a run may still wait for."""
    days = env_days(spark, sf_dir).select("env", F.col("date").cast("timestamp").alias("ts"), "T2M_MAX").where("T2M_MAX > 29")
    source, path = _stream(spark, days)
    out = streams.drained(streams.stress_runs(source, "ts", F.col("T2M_MAX") > 29), path)
    return out.select("env", F.to_date("first").alias("first"), F.to_date("last").alias("last"), "n")


@query("stream_interval_means", f"WITH {ENV_DAYS}, b AS (SELECT env, date_diff('day', DATE '1970-01-01', date) // 3 AS k, T2M, date FROM d), e AS (SELECT max(date) AS top FROM d) SELECT env, DATE '1970-01-01' + CAST(3 * k AS INTEGER) AS start, round(avg(T2M), 4) AS mean, count(*) AS n FROM b, e GROUP BY env, k, top HAVING date_diff('day', DATE '1970-01-01', top) - 1 >= 3 * (k + 1)")
def stream_interval_means(spark, sf_dir):
    """Windows that the watermark has passed: a day before the last day seen."""
    days = env_days(spark, sf_dir).select("env", F.col("date").cast("timestamp").alias("ts"), "T2M")
    source, path = _stream(spark, days)
    out = streams.drained(streams.interval_means(source, "ts", "T2M"), path)
    return rounded(out.select("env", F.to_date("start").alias("start"), "mean", "n"))
