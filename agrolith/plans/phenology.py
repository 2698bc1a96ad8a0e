"""Phenology, risk, water, hourly weather, climate, zones and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from agrolith.functions import moisture
from agrolith.operators import climate, hourly, phenology, risk, water, zones
from agrolith.plans.base import ENV_DAYS, SITE_DAYS, env_days, rounded, site_days, table
from agrolith.plans.weather import _AIR, _SUN, PI
from agrolith.sources import raster, runlog

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


_STAGES = {"VE": 40, "V6": 120, "VT": 220, "R6": 330}


def _staged(tt: str, source: str = "d", keys: str = "env", more: str = "") -> str:
    bins = " ".join(f"WHEN cum > {a} AND cum <= {b} THEN {i}" if a else f"WHEN cum >= 0 AND cum <= {b} THEN {i}" for i, (a, b) in enumerate(zip([0, *_STAGES.values()], _STAGES.values()), 1))
    lo = "CASE so " + " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate([0, *_STAGES.values()][:-1], 1)) + " END"
    hi = "CASE so " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(_STAGES.values(), 1)) + " END"
    names = "CASE so " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_STAGES, 1)) + " END"
    return f"""tt AS (SELECT *, {tt} AS dTT FROM {source}), cu AS (SELECT *, sum(dTT) OVER (PARTITION BY {keys} ORDER BY daysFromStart ROWS UNBOUNDED PRECEDING) AS cum FROM tt),
so AS (SELECT *, CASE {bins} END AS so FROM cu),
ph AS (SELECT *, {names} AS stage, (cum - {lo}) / ({hi} - {lo}) AS dstage, CASE WHEN so IS NOT NULL THEN row_number() OVER (PARTITION BY {keys}, so ORDER BY daysFromStart) END AS stage_day{more} FROM so)"""


_PICK = "SELECT env, daysFromStart AS day, round(dTT, 4) AS dTT, round(cum, 4) AS cumTT, stage, round(dstage, 4) AS dstage, CAST(stage_day AS INTEGER) AS stage_day FROM ph"
_GDD = "greatest((greatest(least(T2M_MAX, 30), 10) + greatest(least(T2M_MIN, 30), 10)) / 2 - 10, 0)"
_TRAP = "CASE WHEN T2M <= 10 OR T2M >= 45 THEN 0 WHEN T2M <= 20 THEN T2M - 10 ELSE (20 - 10) * (45 - T2M) / (45 - 20) END"
_SINE = f"""greatest(CASE WHEN least(T2M_MIN, 30) >= 12.5 THEN (least(T2M_MAX, 30) + least(T2M_MIN, 30)) / 2 - 12.5 WHEN least(T2M_MAX, 30) <= 12.5 THEN 0 ELSE
 (((least(T2M_MAX, 30) + least(T2M_MIN, 30)) / 2 - 12.5) * ({PI} / 2 - asin(greatest(least((12.5 - (least(T2M_MAX, 30) + least(T2M_MIN, 30)) / 2) / nullif((least(T2M_MAX, 30) - least(T2M_MIN, 30)) / 2, 0), 1), -1)))
 + (least(T2M_MAX, 30) - least(T2M_MIN, 30)) / 2 * cos(asin(greatest(least((12.5 - (least(T2M_MAX, 30) + least(T2M_MIN, 30)) / 2) / nullif((least(T2M_MAX, 30) - least(T2M_MIN, 30)) / 2, 0), 1), -1)))) / {PI} END, 0)"""


def _pick(df):
    return rounded(df.select("env", F.col("daysFromStart").alias("day"), "dTT", "cumTT", "stage", "dstage", "stage_day"))


@query("phenology_gdd", f"WITH {ENV_DAYS}, {_staged(_GDD)} {_PICK}")
def phenology_gdd(spark, sf_dir):
    return _pick(phenology.env_phenology(env_days(spark, sf_dir), stages=_STAGES))


@query("phenology_trapezoid", f"WITH {ENV_DAYS}, {_staged(_TRAP)} {_PICK}")
def phenology_trapezoid(spark, sf_dir):
    return _pick(phenology.env_phenology(env_days(spark, sf_dir), stages=_STAGES, method="trapezoid", upper=20.0))


@query("phenology_sine", f"WITH {ENV_DAYS}, {_staged(_SINE)} {_PICK}")
def phenology_sine(spark, sf_dir):
    return _pick(phenology.env_phenology(env_days(spark, sf_dir), stages=_STAGES, method="baskerville", base=12.5))


@query("phenology_photoperiod", f"WITH {ENV_DAYS}, {_SUN}, {_staged(f'{_GDD} * greatest(least(1 - 0.02 * greatest(N - 12.5, 0), 1), 0)', 'sun')} {_PICK}")
def phenology_photoperiod(spark, sf_dir):
    return _pick(phenology.env_phenology(env_days(spark, sf_dir), stages=_STAGES, photoperiod=True))


@query("phenology_relative", f"WITH {ENV_DAYS}, tt AS (SELECT env, daysFromStart, {_GDD} AS x FROM d), cu AS (SELECT env, daysFromStart, sum(x) OVER (PARTITION BY env ORDER BY daysFromStart ROWS UNBOUNDED PRECEDING) AS cum FROM tt), top AS (SELECT max(cum) AS m FROM cu) SELECT env, 'TT' || CAST(CASE WHEN cum <= m / 3 THEN 1 WHEN cum <= m * 2 / 3 THEN 2 ELSE 3 END AS VARCHAR) AS stage, count(*) AS days FROM cu, top GROUP BY 1, 2")
def phenology_relative(spark, sf_dir):
    return phenology.env_phenology(env_days(spark, sf_dir), stages=3).groupBy("env", "stage").agg(F.count("*").alias("days"))


@query("phenology_summary", f"WITH {ENV_DAYS}, {_staged(_GDD)} SELECT env, stage, count(*) AS days, min(daysFromStart) AS first_day, round(max(cum), 4) AS cumTT FROM ph WHERE stage IS NOT NULL GROUP BY 1, 2")
def phenology_summary(spark, sf_dir):
    ph = phenology.env_phenology(env_days(spark, sf_dir), stages=_STAGES).where(F.col("stage").isNotNull())
    return rounded(ph.groupBy("env", "stage").agg(F.count("*").alias("days"), F.min("daysFromStart").alias("first_day"), F.max("cumTT").alias("cumTT")))


@query("phenology_templates", "SELECT * FROM (VALUES ('maize', 10.0::DOUBLE, 30.0::DOUBLE, 'short', 8, 'R6', 2700.0::DOUBLE), ('sorghum', 10.0::DOUBLE, 34.0::DOUBLE, 'short', 7, 'PM', 2300.0::DOUBLE), ('pearl_millet', 10.0::DOUBLE, 34.0::DOUBLE, 'short', 7, 'PM', 1700.0::DOUBLE), ('sugarcane', 12.0::DOUBLE, 32.0::DOUBLE, 'neutral', 4, 'MAT', 6500.0::DOUBLE), ('wheat', 0.0::DOUBLE, 26.0::DOUBLE, 'long', 7, 'PM', 2400.0::DOUBLE), ('barley', 0.0::DOUBLE, 26.0::DOUBLE, 'long', 7, 'PM', 2100.0::DOUBLE), ('oat', 0.0::DOUBLE, 25.0::DOUBLE, 'long', 7, 'PM', 2250.0::DOUBLE), ('rice', 10.0::DOUBLE, 30.0::DOUBLE, 'short', 7, 'PM', 2300.0::DOUBLE), ('soybean', 10.0::DOUBLE, 30.0::DOUBLE, 'short', 7, 'R8', 2400.0::DOUBLE), ('common_bean', 10.0::DOUBLE, 30.0::DOUBLE, 'short', 7, 'R9', 1500.0::DOUBLE), ('chickpea', 0.0::DOUBLE, 30.0::DOUBLE, 'long', 6, 'PM', 1900.0::DOUBLE), ('groundnut', 10.0::DOUBLE, 32.0::DOUBLE, 'neutral', 7, 'R8', 2300.0::DOUBLE), ('cowpea', 11.0::DOUBLE, 32.0::DOUBLE, 'short', 6, 'PM', 1450.0::DOUBLE), ('canola', 5.0::DOUBLE, 27.0::DOUBLE, 'long', 7, 'PM', 2100.0::DOUBLE), ('sunflower', 6.0::DOUBLE, 30.0::DOUBLE, 'neutral', 7, 'R9', 2000.0::DOUBLE), ('cotton', 15.6::DOUBLE, 32.0::DOUBLE, 'neutral', 6, 'CO', 2100.0::DOUBLE), ('potato', 7.0::DOUBLE, 30.0::DOUBLE, 'long', 5, 'MAT', 1900.0::DOUBLE), ('cassava', 13.0::DOUBLE, 30.0::DOUBLE, 'neutral', 5, 'MAT', 6000.0::DOUBLE), ('safflower', 5.0::DOUBLE, 30.0::DOUBLE, 'long', 7, 'PM', 2200.0::DOUBLE), ('alfalfa', 5.0::DOUBLE, 30.0::DOUBLE, 'long', 6, 'LF', 1000.0::DOUBLE)) AS t(crop, t_base, t_upper, day_type, n_stages, final_stage, final_tt)")
def phenology_templates(spark, sf_dir):
    return phenology.phenology_templates(spark).select("crop", "t_base", "t_upper", "day_type", "n_stages", "final_stage", "final_tt")


@query("show_phenology", "SELECT * FROM (VALUES (1, 'VE', 125.0::DOUBLE, 125.0::DOUBLE), (2, 'V6', 475.0, 350.0), (3, 'V12', 740.0, 265.0), (4, 'VT', 1135.0, 395.0), (5, 'R1', 1250.0, 115.0), (6, 'R3', 1660.0, 410.0), (7, 'R5', 2110.0, 450.0), (8, 'R6', 2700.0, 590.0)) AS t(stage_order, stage, cum_tt, increment)")
def show_phenology(spark, sf_dir):
    return phenology.show_phenology(spark, "maize")


# ---- risk ------------------------------------------------------------------------------------------------------------

_SEASON = """y AS (SELECT DISTINCT site, year(date) AS season FROM s),
c0 AS (SELECT s.*, season, datediff('day', make_date(season, 3, 1), date) + 1 AS day FROM s JOIN y USING (site) WHERE date BETWEEN make_date(season, 3, 1) AND make_date(season, 3, 1) + 119),
cut AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY site, season) AS n FROM c0) WHERE n >= 30)"""


@query("season_cut", f"WITH {SITE_DAYS}, {_SEASON} SELECT site, CAST(season AS INTEGER) AS season, count(*) AS n, CAST(min(day) AS INTEGER) AS first_day, CAST(max(day) AS INTEGER) AS last_day FROM cut GROUP BY 1, 2")
def season_cut(spark, sf_dir):
    cut = risk.season_cut(site_days(spark, sf_dir), planting="03-01", length=120)
    return cut.groupBy("site", "season").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


_RSTAGES = {"early": 300, "mid": 700, "late": 5000}
_RISK = f"""{SITE_DAYS}, {_SEASON}, tt AS (SELECT *, {_GDD.replace("30), 10", "30), 10")} AS x FROM cut), cu AS (SELECT *, sum(x) OVER (PARTITION BY site, season ORDER BY day ROWS UNBOUNDED PRECEDING) AS cum FROM tt),
st AS (SELECT *, CASE WHEN cum <= 300 THEN 'early' WHEN cum <= 700 THEN 'mid' WHEN cum <= 5000 THEN 'late' END AS stage FROM cu),
days AS (SELECT site, season, stage, 'T2M_MAX' AS var, T2M_MAX AS value, CASE WHEN T2M_MAX <= 30 THEN 'safe' WHEN T2M_MAX <= 35 THEN 'heat_mild' ELSE 'heat_severe' END AS class FROM st WHERE stage IS NOT NULL
  UNION ALL SELECT site, season, stage, 'PRECTOT', PRECTOT, CASE WHEN PRECTOT <= 6 THEN 'dry' WHEN PRECTOT <= 8 THEN 'moderate' ELSE 'wet' END FROM st WHERE stage IS NOT NULL),
menu AS (SELECT * FROM (VALUES ('T2M_MAX', 'safe'), ('T2M_MAX', 'heat_mild'), ('T2M_MAX', 'heat_severe'), ('PRECTOT', 'dry'), ('PRECTOT', 'moderate'), ('PRECTOT', 'wet')) AS t(var, class)),
grid AS (SELECT site, season, stage, var, class FROM (SELECT DISTINCT site, season FROM st WHERE stage IS NOT NULL) JOIN (SELECT DISTINCT site, stage FROM st WHERE stage IS NOT NULL) USING (site) CROSS JOIN menu),
cn AS (SELECT site, season, stage, var, class, count(*) AS days FROM days GROUP BY ALL),
se AS (SELECT site, season, stage, var, class, coalesce(days, 0) AS days FROM grid LEFT JOIN cn USING (site, season, stage, var, class)),
fr AS (SELECT site, var, stage, class, count(DISTINCT season) AS n_years, CAST(sum(CASE WHEN days > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_occur, avg(days) AS mean_days, max(days) AS max_days FROM se GROUP BY ALL),
f AS (SELECT *, n_occur / n_years AS freq FROM fr)"""


def _profile(spark, sf_dir, df=None) -> risk.RiskProfile:
    return risk.env_risk_profile(site_days(spark, sf_dir) if df is None else df, variables=["T2M_MAX", "PRECTOT"], planting="03-01", length=120, stages=_RSTAGES, cardinals={"PRECTOT": ((6.0, 8.0), ("dry", "moderate", "wet"))})


@query("risk_frequency", f"WITH {_RISK} SELECT site, var, stage, class, n_years, n_occur, round(mean_days, 4) AS mean_days, max_days, round(freq, 4) AS freq FROM f")
def risk_frequency(spark, sf_dir):
    return rounded(_profile(spark, sf_dir).frequency)


@query("risk_severity", f"WITH {_RISK} SELECT site, var, stage, class, count(value) AS n_days, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.9), 4) AS p90 FROM days GROUP BY ALL")
def risk_severity(spark, sf_dir):
    return rounded(_profile(spark, sf_dir).severity)


@query("return_period", f"WITH {_RISK} SELECT site, var, stage, class, n_years, round(freq, 4) AS freq, round(1 / nullif(freq, 0), 4) AS return_period, coalesce(1 / nullif(freq, 0) <= n_years / 3, false) AS reliable FROM f")
def return_period(spark, sf_dir):
    return rounded(_profile(spark, sf_dir).return_period)


_BENIGN = "('safe', 'none', 'non_limiting', 'optimal', 'low', 'wet', 'moderate')"


@query("tpe_weights", f"WITH {_RISK}, t AS (SELECT site AS \"group\", sum(mean_days) AS total FROM f WHERE class NOT IN {_BENIGN} GROUP BY 1) SELECT \"group\", round(total / sum(total) OVER (), 4) AS weight FROM t")
def tpe_weights(spark, sf_dir):
    return rounded(risk.tpe_weights(_profile(spark, sf_dir).frequency, by="site", measure="days"))


def _halved(text: str, test: str, prefix: str) -> str:
    names = ("sg", "s", "y", "c0", "cut", "tt", "cu", "st", "days", "menu", "grid", "cn", "se", "fr", "f")
    import re

    text = text.replace("GROUP BY 1, 2),\ns AS", f"WHERE_HERE GROUP BY 1, 2),\ns AS").replace("FROM lineitem WHERE_HERE", f"FROM lineitem WHERE {test}")
    for n in names:
        text = re.sub(rf"(?<![\w.']){n} AS \(", f"{prefix}{n} AS (", text)
        text = re.sub(rf"(FROM|JOIN) {n}(?![\w(])", rf"\1 {prefix}{n}", text)
    return text.replace("s.*", f"{prefix}s.*")


@query("project_risk", f"""WITH {_halved(_RISK, "l_shipdate < DATE '1998-07-01'", 'a_')}, {_halved(_RISK, "l_shipdate >= DATE '1998-07-01'", 'b_')}
SELECT site, var, stage, class, round(coalesce(a.freq, 0), 4) AS freq_base, round(coalesce(b.freq, 0), 4) AS freq_future, round(coalesce(b.freq, 0) - coalesce(a.freq, 0), 4) AS freq_diff, round(coalesce(b.mean_days, 0) - coalesce(a.mean_days, 0), 4) AS days_diff FROM a_f a FULL JOIN b_f b USING (site, var, stage, class)""")
def project_risk(spark, sf_dir):
    days, cut = site_days(spark, sf_dir), F.lit("1998-07-01").cast("date")
    a, b = (_profile(spark, sf_dir, days.where(x)).frequency for x in (F.col("date") < cut, F.col("date") >= cut))
    return rounded(risk.project_risk(a, b).select("site", "var", "stage", "class", "freq_base", "freq_future", "freq_diff", "days_diff"))


# ---- hours, climate, zones -------------------------------------------------------------------------------------------

_HOURS = "h AS (SELECT 'E' || CAST(user_id % 10 AS VARCHAR) AS env, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, 10 + sqrt(avg(value)) AS T2M, 8 + sqrt(min(value)) AS T2MDEW FROM events GROUP BY 1, 2, 3)"


def env_hours(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.concat(F.lit("E"), (F.col("user_id") % 10).cast("string")).alias("env"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg((10 + F.sqrt(F.avg("value"))).alias("T2M"), (8 + F.sqrt(F.min("value"))).alias("T2MDEW"))


_VPD = "greatest(0.6108 * exp(17.27 * T2M / (T2M + 237.3)) - 0.6108 * exp(17.27 * T2MDEW / (T2MDEW + 237.3)), 0)"


@query("hourly_daynight", f"""WITH {_HOURS}, n AS (SELECT *, hour IN (20, 21, 22, 23, 0, 1, 2, 3, 4, 5) AS night FROM h), nh AS (SELECT DISTINCT env, hour FROM n WHERE night),
dd AS (SELECT env, date, avg(T2M) AS dm, stddev_samp(T2M) AS ds, count(*) AS dh FROM n WHERE NOT night GROUP BY 1, 2),
nn AS (SELECT env, CASE WHEN hour >= 12 THEN date ELSE date - 1 END AS date, avg(T2M) AS nm, count(*) AS nh, avg(CASE WHEN hour IN (2, 3, 4, 5) THEN T2M END) AS pm, avg({_VPD}) AS vn, count(*) FILTER (T2M > 17) AS above, count(*) FILTER (hour >= 12) > 0 AND count(*) FILTER (hour < 12) > 0 AS whole FROM n JOIN nh USING (env, hour) GROUP BY 1, 2),
w AS (SELECT env, date, max(T2M) - min(T2M) AS dtr FROM n GROUP BY 1, 2)
SELECT env, date, round(dtr, 4) AS DTR, round(dm, 4) AS T2M_day_mean, round(ds, 4) AS T2M_day_sd, round(nm, 4) AS T2M_night_mean, round(pm, 4) AS T2M_predawn_mean, round(vn, 4) AS VPD_night_mean, above AS hours_above_T2M, coalesce(dh, 0) AS day_hours, coalesce(nh, 0) AS night_hours, coalesce(whole, false) AS night_complete FROM w LEFT JOIN dd USING (env, date) LEFT JOIN nn USING (env, date)""")
def hourly_daynight(spark, sf_dir):
    df = env_hours(spark, sf_dir)
    out = hourly.daily_from_hourly(df, ["T2M", "T2MDEW"], hourly.night_flag(df, "fixed", hourly.hour_window(20, 5)), thresholds={"T2M": 17.0})
    return rounded(out.select("env", "date", "DTR", "T2M_day_mean", "T2M_day_sd", "T2M_night_mean", "T2M_predawn_mean", "VPD_night_mean", "hours_above_T2M", "day_hours", "night_hours", "night_complete"))


@query("climate_delta", f"""WITH {SITE_DAYS}, yr AS (SELECT site, month(date) AS m, year(date) AS y, sum(T2M_MAX) AS sx, count(T2M_MAX) AS nx, sum(T2M_MIN) AS sn, sum(PRECTOT) AS r FROM s GROUP BY 1, 2, 3), b AS (SELECT site, m, sum(sx) / sum(nx) AS tx, sum(sn) / sum(nx) AS tn, avg(r) AS pr FROM yr GROUP BY 1, 2),
f AS (SELECT site, m, tx + 2 + m / 10.0 AS fx, tn + 1.5 AS fn, pr * (1 + (m - 6) / 20.0) AS fp, tx, tn, pr FROM b)
SELECT s.site AS site, date, round(T2M_MAX + (fx - tx), 4) AS T2M_MAX, round(T2M_MIN + (fn - tn), 4) AS T2M_MIN, round(PRECTOT * CASE WHEN pr > 1 THEN least(greatest(fp / pr, 0), 5) ELSE 1 END, 4) AS PRECTOT, round((T2M_MAX + (fx - tx) + T2M_MIN + (fn - tn)) / 2, 4) AS T2M FROM s JOIN f ON s.site = f.site AND month(date) = f.m""")
def climate_delta(spark, sf_dir):
    daily = site_days(spark, sf_dir).withColumnsRenamed({"site": "env", "date": "YYYYMMDD"}).drop("price")
    base = climate.monthly_baseline(daily)
    future = base.select("env", "month", (F.col("tmax") + 2 + F.col("month") / 10.0).alias("tmax"), (F.col("tmin") + 1.5).alias("tmin"), (F.col("prec") * (1 + (F.col("month") - 6) / 20.0)).alias("prec"))
    out = climate.climate_scenario(daily, future)
    return rounded(out.select(F.col("env").alias("site"), F.col("YYYYMMDD").alias("date"), "T2M_MAX", "T2M_MIN", "PRECTOT", "T2M"))


@query("zone_majority", "WITH c AS (SELECT o_custkey % 200 AS env, CAST(o_orderkey % 57 + 1 AS INTEGER) AS code, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY env ORDER BY n DESC, CAST(code AS VARCHAR)) AS k, n / sum(n) OVER (PARTITION BY env) AS share FROM c) SELECT env, code, round(share, 6) AS share FROM r WHERE k = 1")
def zone_majority(spark, sf_dir):
    cells = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("env"), (F.col("o_orderkey") % 57 + 1).cast("int").alias("code"))
    return rounded(zones.majority(cells), 6)


@query("legend_lookup", "SELECT c_custkey AS env, CAST(c_custkey % 60 + 1 AS INTEGER) AS code, CASE WHEN c_custkey % 60 + 1 BETWEEN 1 AND 44 THEN CASE (c_custkey % 60) % 4 WHEN 0 THEN 'semi-arid' WHEN 1 THEN 'sub-humid' WHEN 2 THEN 'humid' ELSE 'per-humid' END END AS moisture, CASE WHEN c_custkey % 60 + 1 <= 57 THEN c_custkey % 60 + 1 < 50 END AS arable FROM customer")
def legend_lookup(spark, sf_dir):
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("env"), (F.col("c_custkey") % 60 + 1).cast("int").alias("code"))
    return zones.with_legend(sites, zones.zone_legend(spark)).select("env", "code", "moisture", "arable")


@query("raster_sample", "SELECT s_suppkey AS env, layer, l_partkey AS cell, round(v, 4) AS value FROM (SELECT s_suppkey, CAST(floor((90 - (s_suppkey % 170 - 85 + 0.25)) / 10) AS INTEGER) AS r, CAST(floor((s_suppkey * 7 % 360 - 180 + 0.25 + 180) / 10) AS INTEGER) AS c FROM supplier) s JOIN (SELECT p_partkey AS l_partkey, CAST(p_partkey // 36 % 18 AS INTEGER) AS r, CAST(p_partkey % 36 AS INTEGER) AS c, 'layer' || CAST(p_partkey // 648 AS VARCHAR) AS layer, p_retailprice AS v FROM part) p USING (r, c)")
def raster_sample(spark, sf_dir):
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(k.alias("env"), (k % 170 - 85 + 0.25).alias("lat"), (k * 7 % 360 - 180 + 0.25).alias("lon"))
    p = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select(F.concat(F.lit("layer"), F.floor(p / 648).cast("string")).alias("layer"), p.alias("cell"), (F.floor(p / 36) % 18).cast("int").alias("row"), (p % 36).cast("int").alias("col"), F.col("p_retailprice").alias("value"))
    return rounded(raster.sample(points, cells, raster.Grid(-180.0, 90.0, 10.0)).where("cell IS NOT NULL").select("env", "layer", "cell", "value"))


# ---- water -----------------------------------------------------------------------------------------------------------

_SOIL_LAYERS = "(VALUES ('0-5cm', 0, 50), ('5-15cm', 50, 150), ('15-30cm', 150, 300), ('30-60cm', 300, 600), ('60-100cm', 600, 1000), ('100-200cm', 1000, 2000)) AS l(layer, top, bottom)"
_SOIL = f"so AS (SELECT env, layer, top, bottom, greatest((300 + 4 * e + length(layer)) / 1000.0 - (120 + 3 * e) / 1000.0, 0) AS water FROM (SELECT 'E' || CAST(e AS VARCHAR) AS env, e FROM range(10) t(e)) CROSS JOIN {_SOIL_LAYERS})"


def soil_wide(spark):
    e = F.col("id").cast("int")
    layers = ("0-5cm", "5-15cm", "15-30cm", "30-60cm", "60-100cm", "100-200cm")
    columns = [(300.0 + 4 * e + len(x)).alias(f"wv0033|{x}") for x in layers] + [(120.0 + 3 * e).alias(f"wv1500|{x}") for x in layers]
    return spark.range(10).select(F.concat(F.lit("E"), F.col("id").cast("string")).alias("env"), *columns)


def _capacity(spark):
    return water.water_capacity(water.parse_soil(soil_wide(spark)))


@query("soil_taw", f"WITH {_SOIL} SELECT env, dap, round(sum(water * greatest(least(bottom, depth) - least(top, depth), 0)), 4) AS taw FROM so CROSS JOIN (SELECT CAST(x AS INTEGER) AS dap, least(greatest(300 + 700 * x / 60.0, 300), 1000) AS depth FROM range(0, 91, 10) t(x)) GROUP BY 1, 2")
def soil_taw(spark, sf_dir):
    dap = spark.range(0, 91, 10).select(F.col("id").cast("int").alias("dap"))
    layers = _capacity(spark).groupBy("env").agg(F.collect_list(F.struct("top", "bottom", "water")).alias("l"))
    taw = water._kept(F.col("l"), water.root_depth(F.col("dap").cast("double"), 1000.0, 300.0, 60.0))
    return rounded(layers.crossJoin(dap).select("env", "dap", taw.alias("taw")))


_WATER = f"""{ENV_DAYS}, {_SUN}, {_AIR.format(src='sun')}, {_SOIL}, t AS (SELECT env, dap, sum(water * greatest(least(bottom, depth) - least(top, depth), 0)) AS taw FROM so CROSS JOIN (SELECT CAST(x AS INTEGER) AS dap, least(greatest(300 + 700 * x / 60.0, 300), 1000) AS depth FROM range(1, 32) t(x)) GROUP BY 1, 2),
e AS (SELECT a.env, daysFromStart AS day, row_number() OVER (PARTITION BY a.env ORDER BY daysFromStart) AS k, PRECTOT AS rain, ETP AS et0, CASE WHEN daysFromStart <= 1 THEN 0.4 WHEN daysFromStart <= 20 THEN 0.4 + (0.75 - 0.4) / 19 * (daysFromStart - 1) ELSE 0.75 + (1.15 - 0.75) / 25 * (daysFromStart - 20) END * ETP AS etc, taw FROM air a JOIN t ON t.env = a.env AND t.dap = a.daysFromStart),
p AS (SELECT *, least(greatest(0.55 + 0.04 * (5 - etc), 0.1), 0.8) * taw AS raw FROM e),
bal AS (SELECT env, k, day, etc, taw, raw, rain, 1.0::DOUBLE AS ks, greatest(-(0 - rain + etc), 0)::DOUBLE AS drainage, least(greatest(0 - rain + etc, 0), taw)::DOUBLE AS dr FROM p WHERE k = 1
 UNION ALL SELECT env, k, day, etc, taw, raw, rain, ks, greatest(-(was - rain + ks * etc), 0), least(greatest(was - rain + ks * etc, 0), taw) FROM (SELECT p.*, q.dr AS was, CASE WHEN p.taw <= 0 THEN 0 WHEN q.dr <= p.raw THEN 1 ELSE greatest((p.taw - q.dr) / (p.taw - p.raw), 0) END AS ks FROM p JOIN bal q ON p.env = q.env AND p.k = q.k + 1))"""


def _water_days(spark, sf_dir):
    from agrolith.operators.weather import process_weather

    return process_weather(env_days(spark, sf_dir).withColumn("PRECTOT", F.col("PRECTOT")))


def _balance(spark, sf_dir, digits=None):
    return water.water_balance(_water_days(spark, sf_dir), _capacity(spark), digits=digits)


@query("water_balance", f"WITH RECURSIVE {_WATER} SELECT env, day, round(etc, 4) AS etc, round(taw, 4) AS taw, round(ks, 4) AS ks, round(ks * etc, 4) AS eta, round(drainage, 4) AS drainage, round(dr, 4) AS depletion FROM bal")
def water_balance(spark, sf_dir):
    return rounded(_balance(spark, sf_dir).select("env", "day", "etc", "taw", "ks", "eta", "drainage", "depletion"))


@query("water_summary", f"WITH RECURSIVE {_WATER} SELECT env, count(*) AS n_days, round(avg(ks), 4) AS mean_ks, round(sum(ks * etc), 4) AS total_eta, round(sum(rain), 4) AS total_rain, round(sum(drainage), 4) AS total_drainage, round(avg(taw - dr), 4) AS mean_asw FROM bal GROUP BY 1")
def water_summary(spark, sf_dir):
    return rounded(water.summarize_water_balance(_balance(spark, sf_dir)).select("env", "n_days", "mean_ks", "total_eta", "total_rain", "total_drainage", "mean_asw"))


@query("stress_run", f"WITH {ENV_DAYS}, o AS (SELECT env, daysFromStart AS day, T2M_MAX > 30 AS hot, row_number() OVER (PARTITION BY env ORDER BY daysFromStart) AS n FROM d), i AS (SELECT *, n - row_number() OVER (PARTITION BY env, hot ORDER BY day) AS g FROM o), r AS (SELECT env, hot, g, count(*) AS len FROM i GROUP BY 1, 2, 3) SELECT env, coalesce(max(len) FILTER (hot), 0) AS longest_run FROM r GROUP BY 1")
def stress_run(spark, sf_dir):
    return water.longest_run(env_days(spark, sf_dir), ["env"], "daysFromStart", F.col("T2M_MAX") > 30)


# ---- runs and sources ------------------------------------------------------------------------------------------------


@query("latest_log", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1")
def latest_log(spark, sf_dir):
    return runlog.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("resume_todo", "WITH l AS (SELECT conv_id, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1) SELECT c_custkey AS env FROM customer WHERE c_custkey NOT IN (SELECT conv_id FROM l WHERE role = 'assistant')")
def resume_todo(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("env"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "ok").otherwise("failed").alias("status"))
    return runlog.todo(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("env")), log)


@query("json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


_SPARSE = f"""{ENV_DAYS}, sp AS (SELECT env, min(date) AS date, avg(T2M) AS x FROM d GROUP BY env, date_diff('day', DATE '2024-01-01', date) // 8), sn AS (SELECT env, min(date) AS a, max(date) AS b FROM sp GROUP BY 1),
dy AS (SELECT env, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM sn), jo AS (SELECT dy.env, dy.date, sp.x, CASE WHEN sp.x IS NOT NULL THEN dy.date END AS known FROM dy LEFT JOIN sp ON sp.env = dy.env AND sp.date = dy.date),
wi AS (SELECT *, last_value(x IGNORE NULLS) OVER p AS lx, last_value(known IGNORE NULLS) OVER p AS ld, first_value(x IGNORE NULLS) OVER f AS rx, first_value(known IGNORE NULLS) OVER f AS rd FROM jo
WINDOW p AS (PARTITION BY env ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY env ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
gp AS (SELECT *, date_diff('day', ld, rd) AS gap FROM wi)"""
_FILLED = {"linear": "lx + (rx - lx) * coalesce(date_diff('day', ld, date) / nullif(gap, 0), 0)", "constant": "lx", "none": "x"}


def _composites(spark, sf_dir):
    """A value for every eight days, dated by the first: as composites of a satellite come."""
    days = env_days(spark, sf_dir).groupBy("env", F.floor(F.datediff("date", F.lit("2024-01-01").cast("date")) / 8).alias("at"))
    return days.agg(F.min("date").alias("YYYYMMDD"), F.avg("T2M").alias("ndvi")).drop("at")


def _gaps(method: str, name: str):
    @query(name, f"WITH {_SPARSE} SELECT env, date AS YYYYMMDD, round(CASE WHEN gap <= 16 THEN {_FILLED[method]} END, 4) AS ndvi, coalesce(gap > 16, true) AS ndvi_gap FROM gp")
    def run(spark, sf_dir):
        from agrolith.sources.satellite import to_daily

        return rounded(to_daily(_composites(spark, sf_dir), ["ndvi"], method))

    return run


gap_interpolation, gap_constant, gap_none = _gaps("linear", "gap_interpolation"), _gaps("constant", "gap_constant"), _gaps("none", "gap_none")
