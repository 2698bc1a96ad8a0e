"""Weather, summaries, covariables, types, copula and kernels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.operators import copula, covariables, kernels, summary, typing, weather
from agrolith.plans.base import EMBEDDING_W, ENV_DAYS, VARIABLES, embedding_w, env_days, melted, rounded, table
from agrolith.schema import empty_columns, long_to_wide, strip_fill, union_filled

PI = repr(math.pi)
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


BREAKS, NAMES = (0, 7, 15), ("VE", "V1_V6", "V6_VT")
STAGED = f"{ENV_DAYS}, i AS (SELECT *, CASE WHEN daysFromStart >= 15 THEN 'V6_VT' WHEN daysFromStart >= 7 THEN 'V1_V6' WHEN daysFromStart >= 0 THEN 'VE' END AS interval FROM d)"
STATS = "round(avg(value), 4) AS mean, round(sum(value), 4) AS sum, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75"


def _plain(df: DataFrame) -> DataFrame:
    return rounded(df.withColumnsRenamed({"prob_0.25": "p25", "prob_0.5": "p50", "prob_0.75": "p75"}))


@query("weather_summary_all", f"WITH {ENV_DAYS}, m AS ({melted()}) SELECT env, variable, {STATS} FROM m GROUP BY 1, 2")
def weather_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(summary.summarize_weather(env_days(spark, sf_dir), variables=VARIABLES))


@query("weather_summary_by_interval", f"WITH {STAGED}, m AS ({melted('i', keys='env, interval')}) SELECT env, interval, variable, {STATS} FROM m WHERE interval IS NOT NULL GROUP BY 1, 2, 3")
def weather_summary_by_interval(spark, sf_dir):
    return _plain(summary.summarize_weather(env_days(spark, sf_dir), variables=VARIABLES, by_interval=True, breaks=BREAKS, names=NAMES))


@query("strip_fill_values", "SELECT l_linestatus AS status, count(*) AS n, count(v) AS kept, round(sum(v), 2) AS total FROM (SELECT l_linestatus, CASE WHEN x IN (-99, -999, -9000, -9999, -99999) OR x <= -900 THEN NULL ELSE x END AS v FROM (SELECT l_linestatus, CASE l_linenumber WHEN 1 THEN -999 WHEN 2 THEN -99 WHEN 3 THEN -1200.5 ELSE l_quantity END AS x FROM lineitem)) GROUP BY 1")
def strip_fill_values(spark, sf_dir):
    n = F.col("l_linenumber")
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), F.when(n == 1, -999.0).when(n == 2, -99.0).when(n == 3, -1200.5).otherwise(F.col("l_quantity")).alias("v"))
    return strip_fill(df, ["v"]).groupBy("status").agg(F.count("*").alias("n"), F.count("v").alias("kept"), F.round(F.sum("v"), 2).alias("total"))


@query("empty_variables", "SELECT l_linestatus AS status, 'b' AS variable FROM lineitem GROUP BY 1")
def empty_variables(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("a"), F.lit(None).cast("double").alias("b"))
    return empty_columns(df, ["a", "b"], ["status"])


_SUN = f"""
b AS (SELECT *, median(ALLSKY_SFC_SW_DWN) OVER () AS med FROM d),
sun0 AS (SELECT *, asin(0.39795 * cos(0.2163108 + 2 * atan(0.9671396 * tan(0.00860 * (DOY - 186))))) AS p, radians(LAT) AS phi, 0.409 * sin(2 * {PI} * DOY / 365.0 - 1.39) AS dec, 1 + 0.033 * cos(2 * {PI} * DOY / 365.0) AS dr FROM b),
sun1 AS (SELECT *, 24.0 - (24.0 / {PI}) * acos(greatest(least((sin(radians(0.8333)) + sin(phi) * sin(p)) / (cos(phi) * cos(p)), 1.0), -1.0)) AS N, acos(greatest(least(-tan(phi) * tan(dec), 1.0), -1.0)) AS ws FROM sun0),
sun AS (SELECT *, greatest((1440.0 / {PI}) * 0.082 * dr * (ws * sin(phi) * sin(dec) + cos(phi) * cos(dec) * sin(ws)), 0.0) AS RTA FROM sun1)"""
_AIR = """
air0 AS (SELECT *, greatest((0.61078 * exp(17.27 * T2M_MIN / (T2M_MIN + 237.3)) + 0.61078 * exp(17.27 * T2M_MAX / (T2M_MAX + 237.3))) / 2 - 0.61078 * exp(17.27 * T2MDEW / (T2MDEW + 237.3)), 0) AS VPD,
  4098.0 * 0.6108 * exp(17.27 * ((T2M_MIN + T2M_MAX) / 2) / ((T2M_MIN + T2M_MAX) / 2 + 237.3)) / pow((T2M_MIN + T2M_MAX) / 2 + 237.3, 2) AS SPV, 0.665e-3 * 101.3 * pow((293 - 0.0065 * 600) / 293, 5.26) AS gam FROM {src}),
air AS (SELECT *, greatest(1.26 * SPV / (SPV + gam) * ALLSKY_SFC_SW_DWN * 0.408, 0) AS ETP FROM air0)"""
_HEAT = "greatest((least(T2M_MAX, 45) + T2M_MIN) / 2 - 9, 0) AS GDD, CASE WHEN t <= 9 OR t >= 45 THEN 0.0 WHEN t < 26 THEN (t - 9) / (26 - 9) WHEN t > 32 THEN (45 - t) / (45 - 32) ELSE 1.0 END AS FRUE, T2M_MAX - T2M_MIN AS T2M_RANGE"


@query("radiation_params", f"WITH {ENV_DAYS}, {_SUN} SELECT env, date, round(greatest(least(N * med_or / RTA, N), 0), 4) AS n_sun, round(N, 4) AS daylight, round(RTA, 4) AS RTA FROM (SELECT *, coalesce(ALLSKY_SFC_SW_DWN, med) AS med_or FROM sun)")
def radiation_params(spark, sf_dir):
    return rounded(weather.param_radiation(env_days(spark, sf_dir)).select("env", "date", "n_sun", F.col("N").alias("daylight"), "RTA"))


@query("atmospheric_params", f"WITH {ENV_DAYS}, {_AIR.format(src='d')} SELECT env, date, round(VPD, 4) AS VPD, round(SPV, 4) AS SPV, round(ETP, 4) AS ETP, round(PRECTOT - ETP, 4) AS PETP FROM air")
def atmospheric_params(spark, sf_dir):
    return rounded(weather.param_atmospheric(env_days(spark, sf_dir), merge=True).select("env", "date", "VPD", "SPV", "ETP", "PETP"))


@query("temperature_params", f"WITH {ENV_DAYS} SELECT env, date, round(GDD, 4) AS GDD, round(FRUE, 4) AS FRUE, round(T2M_RANGE, 4) AS T2M_RANGE FROM (SELECT env, date, {_HEAT} FROM (SELECT *, (T2M_MAX + T2M_MIN) / 2 AS t FROM d))")
def temperature_params(spark, sf_dir):
    return rounded(weather.param_temperature(env_days(spark, sf_dir), merge=True).select("env", "date", "GDD", "FRUE", "T2M_RANGE"))


@query("process_weather", f"WITH {ENV_DAYS}, {_SUN}, {_AIR.format(src='sun')} SELECT env, date, round(N, 4) AS daylight, round(RTA, 4) AS RTA, round(VPD, 4) AS VPD, round(ETP, 4) AS ETP, round(PRECTOT - ETP, 4) AS PETP, round(GDD, 4) AS GDD, round(FRUE, 4) AS FRUE FROM (SELECT *, {_HEAT} FROM (SELECT *, (T2M_MAX + T2M_MIN) / 2 AS t FROM air))")
def process_weather(spark, sf_dir):
    done = weather.process_weather(weather.process_weather(env_days(spark, sf_dir)))
    return rounded(done.select("env", "date", F.col("N").alias("daylight"), "RTA", "VPD", "ETP", "PETP", "GDD", "FRUE"))


@query("download_derived", f"""WITH {ENV_DAYS} SELECT env, date, CAST(datediff('day', DATE '2024-01-01', date) + 1 AS INTEGER) AS day_number, round((0.61078 * exp(17.27 * T2M_MIN / (T2M_MIN + 237.3)) + 0.61078 * exp(17.27 * T2M_MAX / (T2M_MAX + 237.3))) / 2 - 0.61078 * exp(17.27 * T2MDEW / (T2MDEW + 237.3)), 4) AS VPD,
  round((1.8 * T2M + 32) - (0.55 - 0.0055 * RH2M) * (1.8 * T2M - 26), 4) AS TH1, round(T2M + 0.36 * T2MDEW + 41.2, 4) AS TH2 FROM d""")
def download_derived(spark, sf_dir):
    df = env_days(spark, sf_dir).withColumnsRenamed({"date": "YYYYMMDD"}).drop("DOY", "daysFromStart").withColumn("start", F.lit("2024-01-01").cast("date"))
    done = weather.finish_download(df, ["T2M_MAX", "T2M_MIN", "T2MDEW", "T2M", "PRECTOT", "RH2M"])
    return rounded(done.select("env", F.col("YYYYMMDD").alias("date"), F.col("daysFromStart").alias("day_number"), "VPD", "TH1", "TH2"))


# ---- covariables -----------------------------------------------------------------------------------------------------

_W = f"{STAGED}, m AS ({melted('i', keys='env, interval')}), w AS (SELECT env, variable || '_mean_' || interval AS covariable, avg(value) AS value FROM m WHERE interval IS NOT NULL GROUP BY 1, 2)"


def _w(spark, sf_dir) -> DataFrame:
    return covariables.named_statistics(summary.summarize_weather(env_days(spark, sf_dir), variables=VARIABLES, statistic="mean", by_interval=True, breaks=BREAKS, names=NAMES))


@query("w_matrix_long", f"WITH {_W} SELECT env, covariable, round(value, 4) AS value FROM w")
def w_matrix_long(spark, sf_dir):
    return rounded(_w(spark, sf_dir))


@query("w_matrix_scaled", f"WITH {_W} SELECT env, covariable, round((value - avg(value) OVER v) / nullif(stddev_samp(value) OVER v, 0), 4) AS value FROM w WINDOW v AS (PARTITION BY covariable)")
def w_matrix_scaled(spark, sf_dir):
    return rounded(covariables.w_matrix(env_days(spark, sf_dir), variables=VARIABLES, by_interval=True, breaks=BREAKS, names=NAMES).values)


@query("w_matrix_status", f"WITH {_W} SELECT covariable, round(avg(value), 4) AS center, round(stddev_samp(value), 4) AS scale, CASE WHEN stddev_samp(value) > 0.9 THEN 'removed(too.variable)' WHEN stddev_samp(value) <= 0.15 THEN 'removed(near.constant)' ELSE 'kept' END AS status FROM w GROUP BY 1")
def w_matrix_status(spark, sf_dir):
    return rounded(covariables.scale_covariables(_w(spark, sf_dir), sd_tol=0.9, tol=0.15, qc=True).status.select("covariable", "center", "scale", "status"))


_HOLES = "h AS (SELECT env, covariable, CASE WHEN (ascii(substr(env, 2)) + length(covariable)) % 29 = 0 THEN NULL ELSE value END AS value FROM w)"


def _holes(spark, sf_dir) -> DataFrame:
    gap = (F.ascii(F.substring("env", 2, 1)) + F.length("covariable")) % 29 == 0
    return _w(spark, sf_dir).withColumn("value", F.when(~gap, F.col("value")))


@query("impute_mean", f"WITH {_W}, {_HOLES} SELECT env, covariable, round(coalesce(value, avg(value) OVER (PARTITION BY covariable)), 4) AS value FROM h")
def impute_mean(spark, sf_dir):
    return rounded(covariables.impute(_holes(spark, sf_dir), "mean"))


@query("impute_median", f"WITH {_W}, {_HOLES} SELECT env, covariable, round(coalesce(value, median(value) OVER (PARTITION BY covariable)), 4) AS value FROM h")
def impute_median(spark, sf_dir):
    return rounded(covariables.impute(_holes(spark, sf_dir), "median"))


@query("impute_drop", f"WITH {_W}, {_HOLES} SELECT env, covariable, round(value, 4) AS value FROM h WHERE covariable NOT IN (SELECT covariable FROM h WHERE value IS NULL)")
def impute_drop(spark, sf_dir):
    return rounded(covariables.impute(_holes(spark, sf_dir), "drop"))


@query("impute_knn", f"""WITH {_W}, {_HOLES}, z AS (SELECT *, (value - avg(value) OVER v) / coalesce(nullif(stddev_samp(value) OVER v, 0), 1) AS z FROM h WINDOW v AS (PARTITION BY covariable)),
near AS (SELECT a.env AS a, b.env AS b, sqrt(avg(pow(a.z - b.z, 2))) AS dist FROM z a JOIN z b USING (covariable) WHERE a.env <> b.env AND a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY 1, 2),
donors AS (SELECT h.env, h.covariable, o.value, row_number() OVER (PARTITION BY h.env, h.covariable ORDER BY dist, n.b) AS r FROM h JOIN near n ON n.a = h.env JOIN h o ON o.env = n.b AND o.covariable = h.covariable AND o.value IS NOT NULL WHERE h.value IS NULL),
f AS (SELECT env, covariable, avg(value) AS fill FROM donors WHERE r <= 3 GROUP BY 1, 2) SELECT h.env, h.covariable, round(coalesce(h.value, fill, avg(h.value) OVER (PARTITION BY h.covariable)), 4) AS value FROM h LEFT JOIN f ON f.env = h.env AND f.covariable = h.covariable""")
def impute_knn(spark, sf_dir):
    return rounded(covariables.impute(_holes(spark, sf_dir), "knn", 3))


_PAIRS = "c AS (SELECT a.covariable AS i, b.covariable AS j, corr(a.value, b.value) AS r FROM w a JOIN w b USING (env) WHERE a.covariable < b.covariable GROUP BY 1, 2)"


@query("env_cor_pairs", f"WITH {EMBEDDING_W}, {_PAIRS} SELECT i, j, round(r, 4) AS r FROM c")
def env_cor_pairs(spark, sf_dir):
    return rounded(covariables.correlations(embedding_w(spark, sf_dir)))


@query("corr_diagnosis", f"WITH {EMBEDDING_W}, {_PAIRS}, b AS (SELECT i, j, abs(r) AS m FROM c UNION ALL SELECT j, i, abs(r) FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY m DESC, j) AS k FROM b) SELECT i AS covariable, round(m, 4) AS max_abs_cor, j AS partner FROM t WHERE k = 1")
def corr_diagnosis(spark, sf_dir):
    return covariables.diagnose(embedding_w(spark, sf_dir))


@query("decollinearized")
def decollinearized(spark, sf_dir):
    return rounded(covariables.scale_covariables(embedding_w(spark, sf_dir), max_cor=0.8).status.select("covariable", "center", "scale", "status"))


@query("grouped_covariables")
def grouped_covariables(spark, sf_dir):
    return rounded(covariables.scale_covariables(embedding_w(spark, sf_dir), tol=1e-9, max_cor=0.7, group=True).values)


_PHENO = "p AS (SELECT n_name AS env, p_brand AS gid, round(avg(l_extendedprice), 4) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"


def phenotypes(spark, sf_dir) -> DataFrame:
    """(env, gid, value): mean price of a brand by nation; the three small tables are joined by sizes that Spark checks."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    part, supplier, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("env"), F.col("p_brand").alias("gid")).agg(F.round(F.avg("l_extendedprice"), 4).alias("value"))


@query("env_expand_join", f"WITH {_PHENO}, {ENV_DAYS}, w AS (SELECT 'NATION_' || substr(env, 2) AS env, avg(T2M_MAX) AS T2M_MAX, avg(T2M_MIN) AS T2M_MIN FROM d GROUP BY 1) SELECT env, gid, round(value, 2) AS value, round(T2M_MAX, 4) AS T2M_MAX, round(T2M_MIN, 4) AS T2M_MIN FROM p JOIN w USING (env)")
def env_expand_join(spark, sf_dir):
    w = env_days(spark, sf_dir).groupBy(F.concat(F.lit("NATION_"), F.substring("env", 2, 9)).alias("env")).agg(F.round(F.avg("T2M_MAX"), 4).alias("T2M_MAX"), F.round(F.avg("T2M_MIN"), 4).alias("T2M_MIN"))
    return covariables.env_expand(w, phenotypes(spark, sf_dir).withColumn("value", F.round("value", 2)))


# ---- types -----------------------------------------------------------------------------------------------------------

_CARD = {"T2M_MAX": [20.0, 29.0, 32.0, 60.0], "PRECTOT": [0.0, 1.0, 3.0, 100.0]}
_CLASS = """CASE WHEN var = 'T2M_MAX' THEN CASE WHEN value > 20 AND value <= 29 THEN 'T2M_MAX_(20,29]' WHEN value > 29 AND value <= 32 THEN 'T2M_MAX_(29,32]' WHEN value > 32 AND value <= 60 THEN 'T2M_MAX_(32,60]' END
 ELSE CASE WHEN value > 0 AND value <= 1 THEN 'PRECTOT_(0,1]' WHEN value > 1 AND value <= 3 THEN 'PRECTOT_(1,3]' WHEN value > 3 AND value <= 100 THEN 'PRECTOT_(3,100]' END END"""
_MENU = "menu AS (SELECT * FROM (VALUES ('T2M_MAX', 'T2M_MAX_(20,29]'), ('T2M_MAX', 'T2M_MAX_(29,32]'), ('T2M_MAX', 'T2M_MAX_(32,60]'), ('PRECTOT', 'PRECTOT_(0,1]'), ('PRECTOT', 'PRECTOT_(1,3]'), ('PRECTOT', 'PRECTOT_(3,100]')) AS t(var, type))"
_TYPES = f"""{STAGED}, {_MENU}, m AS ({melted('i', ('T2M_MAX', 'PRECTOT'), 'env, interval', 'var')}), k AS (SELECT env, interval, var, {_CLASS} AS type FROM m WHERE interval IS NOT NULL),
n AS (SELECT env, interval, var, type, count(*) AS freq FROM k WHERE type IS NOT NULL GROUP BY 1, 2, 3, 4),
grid AS (SELECT env, interval, var, type FROM (SELECT DISTINCT env FROM i) CROSS JOIN (SELECT DISTINCT interval FROM i WHERE interval IS NOT NULL) CROSS JOIN menu),
t AS (SELECT env, interval, var, type || '_' || interval AS env_variable, CAST(coalesce(freq, 0) AS DOUBLE) AS freq FROM grid LEFT JOIN n USING (env, interval, var, type))"""


def _types(spark, sf_dir, **more) -> DataFrame:
    return typing.env_typing(env_days(spark, sf_dir), variables=["T2M_MAX", "PRECTOT"], cardinals=_CARD, by_interval=True, breaks=BREAKS, names=NAMES, **more)


@query("typing_cardinals", f"WITH {_TYPES} SELECT * FROM t")
def typing_cardinals(spark, sf_dir):
    return _types(spark, sf_dir)


@query("typing_ratio", f"WITH {_TYPES} SELECT env, interval, var, env_variable, round(CASE WHEN sum(freq) OVER v > 0 THEN freq / sum(freq) OVER v ELSE 0 END, 4) AS freq FROM t WINDOW v AS (PARTITION BY env, interval, var)")
def typing_ratio(spark, sf_dir):
    return rounded(_types(spark, sf_dir, ratio=True))


@query("typing_quantiles", f"""WITH {ENV_DAYS}, q AS (SELECT round(quantile_cont(T2M_MAX, 0.01), 3) AS a, round(quantile_cont(T2M_MAX, 0.25), 3) AS b, round(quantile_cont(T2M_MAX, 0.5), 3) AS c, round(quantile_cont(T2M_MAX, 0.75), 3) AS e, round(quantile_cont(T2M_MAX, 0.99), 3) AS f FROM d),
k AS (SELECT env, CASE WHEN T2M_MAX > a AND T2M_MAX <= b THEN 1 WHEN T2M_MAX > b AND T2M_MAX <= c THEN 2 WHEN T2M_MAX > c AND T2M_MAX <= e THEN 3 WHEN T2M_MAX > e AND T2M_MAX <= f THEN 4 END AS class FROM d, q)
SELECT env, CAST(class AS INTEGER) AS class, count(*)::DOUBLE AS freq FROM k WHERE class IS NOT NULL GROUP BY 1, 2""")
def typing_quantiles(spark, sf_dir):
    types = typing.env_typing(env_days(spark, sf_dir), variables=["T2M_MAX"])
    order = F.dense_rank().over(_by_break())
    return types.withColumn("class", order).where("freq > 0").select("env", F.col("class").cast("int").alias("class"), "freq")


def _by_break():
    from pyspark.sql import Window

    return Window.partitionBy("env").orderBy(F.regexp_extract("env_variable", r"\((-?[0-9.]+),", 1).cast("double"))


@query("typing_wide", f"WITH {_TYPES}, u AS (SELECT env, env_variable, median(freq) AS freq FROM t GROUP BY 1, 2) SELECT * FROM u")
def typing_wide(spark, sf_dir):
    return typing.typing_wide(_types(spark, sf_dir))


@query("t_matrix", f"""WITH {_TYPES}, u AS (SELECT env, env_variable AS covariable, median(freq) AS freq FROM t GROUP BY 1, 2), r AS (SELECT env, covariable, CASE WHEN sum(freq) OVER v > 0 THEN freq / sum(freq) OVER v ELSE freq END AS value FROM u WINDOW v AS (PARTITION BY env)),
s AS (SELECT covariable FROM r GROUP BY 1 HAVING stddev_samp(value) >= 0.001) SELECT env, covariable, round(value, 4) AS value FROM r JOIN s USING (covariable)""")
def t_matrix(spark, sf_dir):
    return rounded(typing.t_matrix(_types(spark, sf_dir)).values)


@query("interval_indices", f"WITH {ENV_DAYS}, x AS (SELECT env, CAST(floor((daysFromStart - 1) / 3) + 1 AS INTEGER) AS interval, avg(T2M_MAX) AS T2M_MAX, sum(PRECTOT) AS PRECTOT FROM d WHERE daysFromStart BETWEEN 1 AND 30 GROUP BY 1, 2), m AS ({melted('x', ('T2M_MAX', 'PRECTOT'), 'env, interval', 'factor')}) SELECT env, factor || '_i' || lpad(CAST(interval AS VARCHAR), 3, '0') AS covariable, round(value, 4) AS value, ((interval - 1) * 3 + 1 + least((interval - 1) * 3 + 3, 30)) / 2 AS mid FROM m")
def interval_indices(spark, sf_dir):
    out = typing.env_indices(env_days(spark, sf_dir), variables=["T2M_MAX", "PRECTOT"], end_day=30, statistic_by={"PRECTOT": "sum"}, require_complete=False)
    return rounded(out.select("env", "covariable", "value", F.col("mid").cast("double").alias("mid")))


# ---- copula ----------------------------------------------------------------------------------------------------------

#: Eight blocks of eight covariables.
_BLOCKS = {f"v{i:02d}": f"b{(i - 1) // 8 + 1}" for i in range(1, 65)}
_U = f"{EMBEDDING_W}, u AS (SELECT env, covariable, 'b' || ((CAST(substr(covariable, 2) AS INTEGER) - 1) // 8 + 1) AS block, (rank() OVER (PARTITION BY covariable ORDER BY value) + (count(*) OVER (PARTITION BY covariable, value) - 1) / 2.0) / (count(*) OVER (PARTITION BY covariable) + 1) AS value FROM w)"


def _dominates(sign: str) -> str:
    return f"jj AS (SELECT a.block, a.env, b.env AS other, min(CASE WHEN b.value {sign} a.value THEN 1 ELSE 0 END) AS al FROM u a JOIN u b USING (covariable) GROUP BY 1, 2, 3), j AS (SELECT block, env, sum(al) / (count(*) + 1) AS value FROM jj GROUP BY 1, 2)"


@query("copula_pobs", f"WITH {_U} SELECT env, 'cop_u_' || covariable AS covariable, round(value, 6) AS value FROM u")
def copula_pobs(spark, sf_dir):
    return rounded(copula.env_copula(embedding_w(spark, sf_dir)), 6)


@query("copula_joint", f"WITH {_U}, {_dominates('<=')} SELECT env, 'cop_C_' || block AS covariable, round(value, 6) AS value FROM j")
def copula_joint(spark, sf_dir):
    return rounded(copula.env_copula(embedding_w(spark, sf_dir), "joint", _BLOCKS), 6)


@query("copula_survival", f"WITH {_U}, {_dominates('>=')} SELECT env, 'cop_surv_' || block AS covariable, round(value, 6) AS value FROM j")
def copula_survival(spark, sf_dir):
    return rounded(copula.env_copula(embedding_w(spark, sf_dir), "survival", _BLOCKS), 6)


@query("copula_kendall", f"WITH {_U}, {_dominates('<=')}, k AS (SELECT block, env, cume_dist() OVER (PARTITION BY block ORDER BY value) * count(*) OVER (PARTITION BY block) / (count(*) OVER (PARTITION BY block) + 1) AS k FROM j) SELECT env, 'cop_K_' || block AS covariable, round(CASE WHEN max(k) OVER v > min(k) OVER v THEN (k - min(k) OVER v) / (max(k) OVER v - min(k) OVER v) ELSE k END, 6) AS value FROM k WINDOW v AS (PARTITION BY block)")
def copula_kendall(spark, sf_dir):
    return rounded(copula.env_copula(embedding_w(spark, sf_dir), "kendall", _BLOCKS), 6)


# ---- kernels ---------------------------------------------------------------------------------------------------------

_DOT = "k0 AS (SELECT a.env AS i, b.env AS j, sum(a.value * b.value) AS v, sum(pow(a.value - b.value, 2)) AS d2 FROM w a JOIN w b USING (covariable) GROUP BY 1, 2)"


@query("kernel_linear", f"WITH {EMBEDDING_W}, {_DOT} SELECT i, j, round(v / avg(CASE WHEN i = j THEN v END) OVER (), 4) AS value FROM k0")
def kernel_linear(spark, sf_dir):
    return rounded(kernels.linear_kernel(embedding_w(spark, sf_dir)))


@query("kernel_gaussian", f"WITH {EMBEDDING_W}, {_DOT}, q AS (SELECT CASE WHEN quantile_cont(d2, 0.5) > 0 THEN quantile_cont(d2, 0.5) WHEN quantile_cont(d2, 0.05) > 0 THEN quantile_cont(d2, 0.05) ELSE 1 END AS q FROM k0) SELECT i, j, round(exp(-d2 / q), 4) AS value FROM k0, q")
def kernel_gaussian(spark, sf_dir):
    return rounded(kernels.gaussian_kernel(embedding_w(spark, sf_dir)))


_ARC = "SELECT x.i, x.j, sqrt(a.v * b.v) * (sin(t) + ({pi} - t) * cos(t)) / {pi} AS v FROM (SELECT k.*, acos(greatest(least(k.v / nullif(sqrt(p.v * q.v), 0), 1.0), -1.0)) AS t FROM {k} k JOIN {k} p ON p.i = k.i AND p.j = k.i JOIN {k} q ON q.i = k.j AND q.j = k.j) x JOIN {k} a ON a.i = x.i AND a.j = x.i JOIN {k} b ON b.i = x.j AND b.j = x.j"


@query("kernel_arccos", f"WITH {EMBEDDING_W}, {_DOT}, k1 AS ({_ARC.format(pi=PI, k='k0')}), k2 AS ({_ARC.format(pi=PI, k='k1')}) SELECT i, j, round(v, 4) AS value FROM k2")
def kernel_arccos(spark, sf_dir):
    return rounded(kernels.arc_cosine_kernel(embedding_w(spark, sf_dir), 2))


# ---- tables ----------------------------------------------------------------------------------------------------------


@query("rbind_fill", "SELECT n_name AS name, n_regionkey AS key, NULL::VARCHAR AS note FROM nation UNION ALL SELECT r_name, NULL, 'region' FROM region")
def rbind_fill(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("key"))
    return union_filled([a, table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("note"))])


@query("long_to_wide", "SELECT o_custkey % 50 AS k, max_by(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS F, max_by(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') AS O, max_by(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def long_to_wide_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 50)
    return long_to_wide(orders, ["k"], "o_orderstatus", "o_totalprice", "o_orderkey", ["F", "O", "P"])
