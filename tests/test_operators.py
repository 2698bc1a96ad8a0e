import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agrolith import schema
from agrolith.functions import bins, composition
from agrolith.operators import climate, covariables, groups, hourly, kernels, pca, phenology, risk, summary, typing, water, weather, zones
from agrolith.plans import base
from agrolith.sources import raster, runlog, satellite
from agrolith.sources import weather as sources
from agrolith.streaming import days as streams


@pytest.fixture(scope="module")
def days(spark):
    return base.env_days(spark, "/root/testdata/sf0.01").cache()


@pytest.fixture(scope="module")
def w(spark):
    return base.embedding_w(spark, "/root/testdata/sf0.01").cache()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="LAT"):
        weather.param_radiation(spark.range(1).withColumn("DOY", F.lit(1)))


def test_fill_values(spark):
    df = spark.createDataFrame([(-999.0,), (-99.0,), (-900.0,), (-98.0,), (None,)], "x double")
    assert [r[0] for r in schema.strip_fill(df, ["x"]).collect()] == [None, None, None, -98.0, None]


def test_processing_is_idempotent_and_bounded(days):
    once = weather.process_weather(days)
    twice = weather.process_weather(once)
    assert once.columns == twice.columns
    frue = once.agg(F.min("FRUE"), F.max("FRUE")).first()
    assert frue[0] >= 0 and frue[1] <= 1


def test_all_missing_group_is_null(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, None)], "env string, daysFromStart int, x double")
    out = {r["env"]: r for r in summary.summarize_weather(df, variables=["x"]).collect()}
    assert out["b"]["mean"] is None and out["b"]["sum"] is None and out["a"]["sum"] == 1


def test_interval_bins(spark):
    df = spark.range(1, 31).select(F.col("id").cast("int").alias("daysFromStart"))
    breaks, names = summary.interval_bins(df, "daysFromStart")
    assert breaks[:2] == [0.0, 10.0] and names[0] == "Interval_0" and names[-1] is None
    assert summary.interval_bins(df, "daysFromStart", [0, 10], ["a"])[1] == ["a", "Interval_10"]
    with pytest.raises(ValueError):
        summary.interval_bins(df, "daysFromStart", [0, 10, 20], ["a"])


def test_scaled_covariables_have_mean_zero(days):
    out = covariables.w_matrix(days, variables=base.VARIABLES)
    assert all(abs(r[0]) < 1e-9 for r in out.values.groupBy("covariable").agg(F.avg("value")).select("avg(value)").collect())


def test_decollinearize_drops_copies(spark, w):
    more = w.union(w.where("covariable = 'v01'").select("env", F.lit("copy").alias("covariable"), (F.col("value") * 2).alias("value")))
    kept = covariables.scale_covariables(more, tol=1e-9, max_cor=0.999).values
    names = {r[0] for r in kept.select("covariable").distinct().collect()}
    assert len(names & {"v01", "copy"}) == 1
    grouped = covariables.scale_covariables(more, tol=1e-9, max_cor=0.999, group=True)
    assert any(r["block"] and "(+1)" in r["block"] for r in grouped.status.collect())


def test_type_matrix_rows_sum_to_one(days):
    t = typing.t_matrix(typing.env_typing(days, variables=["T2M_MAX"]), drop_constant=False).values
    assert all(abs(r[0] - 1) < 1e-9 for r in t.groupBy("env").agg(F.sum("value").alias("s")).select("s").collect())


def test_incomplete_indices_raise(days):
    with pytest.raises(ValueError, match="missing"):
        typing.env_indices(days, variables=["T2M"], end_day=60)


def test_kernels_are_symmetric_and_psd(w):
    for k in (kernels.linear_kernel(w), kernels.gaussian_kernel(w), kernels.arc_cosine_kernel(w, 2)):
        m, _, _ = kernels.to_matrix(k, "i", "j")
        assert np.allclose(m, m.T) and np.linalg.eigvalsh(m).min() > -1e-8
    both = kernels.env_kernel(w)
    assert set(both) == {"var_cov", "env_cov"} and set(kernels.env_kernel(w, stages=["v0", "v1"])) == {"v0", "v1"}


def test_pca(w, spark):
    p = pca.env_pca(w)
    v = p.variance.orderBy("pc_order").toPandas()
    assert v["cum"].is_monotonic_increasing and v["cum"].iloc[-1] == pytest.approx(1)
    assert pca.pca_scree(p, 3).count() == 3
    assert pca.pca_biplot(p).count() == 10
    with pytest.raises(ValueError):
        pca.pca_biplot(p, ("PC1", "PC99"))
    y = w.where("covariable IN ('v01', 'v02')").select("env", F.col("covariable").alias("column"), "value")
    out = pca.pc_associate(p, y, 3).toPandas()
    assert len(out) == 6 and out["p_adj"].is_monotonic_increasing and (out["p_adj"] >= out["p"] - 1e-12).all()
    m, envs, covs = kernels.to_matrix(w)
    s = p.scores.where("PC = 'PC1'").toPandas().set_index("env")["value"]
    direct = np.corrcoef(s.loc[envs], m[:, covs.index("v01")])[0, 1]
    assert out[(out["PC"] == "PC1") & (out["column"] == "v01")]["r"].iloc[0] == pytest.approx(direct)
    assert pca.pc_associate(p, y, 2, method="spearman").count() == 4
    heat, mean = pca.cor_heatmap(w, most=10)
    assert heat.count() == 100 and 0 <= mean <= 1


def test_loading_curve(days):
    out = typing.env_indices(days, variables=["T2M_MAX", "T2M_MIN"], end_day=30, require_complete=False)
    p = pca.env_pca(out.select("env", "covariable", "value"))
    curve = pca.loading_curve(p, out.select("covariable", "mid").distinct())
    assert curve.count() == 20 and curve.where("smooth IS NULL").count() == 0


def test_groups(w, days):
    found = groups.env_cluster(w)
    assert found.clusters.count() == 10 and 2 <= found.k <= 9
    kin = kernels.to_matrix(found.kinship, "i", "j")[0]
    assert np.allclose(kin, kin.T) and np.allclose(np.diag(kin), 1)
    top, _ = groups.env_target_importance(w.where("covariable < 'v05'"), w.where("covariable < 'v09'"), k=2, trees=20)
    assert top.count() == 8
    counts, text = groups.mine_types(days.withColumn("interval", F.lit("all")), ["T2M_MAX", "PRECTOT"], "combine", k_range=range(2, 4), starts=2)
    assert counts.select("feature_set").distinct().count() == 3
    assert counts.agg(F.sum("freq")).first()[0] == 3 * days.count()
    with pytest.raises(ValueError):
        groups.mine_types(days, ["T2M"], "other")


def test_soil_zones_find_planted_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(f"S{i:02d}", *map(float, rng.normal(5 * (i % 3), 0.3, 2)), *map(float, rng.dirichlet([20, 10, 5]))) for i in range(60)]
    df = spark.createDataFrame(rows, "env string, a double, b double, clay double, sand double, silt double")
    out = groups.soil_classification(df, ["a", "b"], groups=range(1, 6), families=("EII", "VVV"), risk={"a": 1.0})
    zones_ = out.zones.toPandas()
    assert zones_["zone"].nunique() == 3 and (zones_["uncertainty"] < 0.3).all()
    assert zones_.groupby(zones_["env"].str[1:].astype(int) % 3)["zone"].nunique().eq(1).all()
    mixed = groups.soil_classification(df, ["a", "clay", "sand", "silt"], groups=range(2, 4), families=("EEI",), texture=["clay", "sand", "silt"], pca=True)
    assert mixed.zones.count() == 60


def test_ilr_is_orthonormal(spark):
    row = spark.createDataFrame([(0.2, 0.3, 0.5)], "a double, b double, c double")
    parts = [F.col(x) for x in "abc"]
    out = row.select(*[x.alias(f"c{i}") for i, x in enumerate(composition.clr(parts))], *[x.alias(f"i{i}") for i, x in enumerate(composition.ilr(parts))]).first()
    c, i = np.array(out[:3]), np.array(out[3:])
    assert abs(c.sum()) < 1e-12 and np.isclose((c**2).sum(), (i**2).sum())


def test_phenology(days, spark):
    ph = phenology.env_phenology(days, stages=3)
    assert ph.where("stage IS NULL").count() == 0
    assert phenology.unfinished(phenology.env_phenology(days), 8).count() == 10
    with pytest.raises(ValueError):
        phenology.env_phenology(days, crop="moss")
    assert phenology.phenology_templates(spark).count() == 20


def test_season_over_new_year(spark):
    df = spark.sql("SELECT 'A' AS site, explode(sequence(date'2000-01-01', date'2002-12-31')) AS date")
    cut = risk.season_cut(df, planting="11-01", length=120)
    n = {r["season"]: r["count"] for r in cut.groupBy("season").count().collect()}
    assert n == {2000: 120, 2001: 120, 2002: 61}
    assert risk.season_cut(df, planting={"A": "02-01"}, length=30).where("season = 2001").count() == 30
    assert risk.season_cut(df, planting=["2001-05-01", "2001-06-01"], length=40).agg(F.min("date")).first()[0].isoformat() == "2001-05-01"


def test_risk_profile_keeps_zeros(spark, sf):
    profile = risk.env_risk_profile(base.site_days(spark, "/root/testdata/sf0.01"), variables=["T2M_MAX"], by_stage=False, cardinals={"T2M_MAX": ((30.0, 99.0), ("safe", "heat_mild", "heat_severe"))})
    assert profile.seasons.where("days = 0").count() > 0
    assert profile.frequency.where("freq > 1").count() == 0
    assert profile.top().count() <= 10
    with pytest.raises(ValueError):
        risk.tpe_weights(profile.frequency.limit(0))


def test_water_balance_conserves(spark, days):
    soil = spark.createDataFrame([(f"E{i}", 0.0, 1000.0, 0.15) for i in range(10)], "env string, top double, bottom double, water double")
    wb = water.water_balance(weather.process_weather(days), soil, digits=None).toPandas().sort_values(["env", "day"])
    for _, g in wb.groupby("env"):
        before = g["depletion"].shift(fill_value=0)
        assert np.allclose(before - g["rain"] + g["eta"] + g["drainage"], g["depletion"], atol=1e-9) or (g["depletion"] == g["taw"]).any()
        assert g["ks"].between(0, 1).all()
    assert water.without_soil(days, soil.where("env <> 'E3'")).collect()[0][0] == "E3"


def test_longest_run(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, 0, 1, 1, 1, None, 1])], "day int, v int").withColumn("env", F.lit("a"))
    assert water.longest_run(df, ["env"], "day", F.col("v") == 1).first()["longest_run"] == 3


def test_hours():
    assert hourly.hour_window(22, 2) == [22, 23, 0, 1, 2]
    assert hourly.is_radiation("ALLSKY_SFC_SW_DWN") and not hourly.is_radiation("T2M")


def test_night_hours_are_pooled(spark):
    rows = [("a", d, h, 10.0 + h) for d in ("2024-01-01", "2024-01-02") for h in range(24)]
    df = spark.createDataFrame(rows, "env string, date string, hour int, T2M double").withColumn("date", F.to_date("date"))
    night = (F.col("hour") < 6) | ((F.col("hour") == 20) & (F.col("date") == "2024-01-01"))
    out = {str(r["date"]): r for r in hourly.daily_from_hourly(df, ["T2M"], night).collect()}
    # 20 h is night on one date only, but belongs to a night on both; on the second it is counted for the day as well.
    assert out["2024-01-02"]["night_hours"] == 1 and out["2024-01-02"]["day_hours"] == 18
    assert out["2024-01-01"]["night_complete"] and not out["2024-01-02"]["night_complete"]


def test_climate_models():
    assert "FIO-ESM-2-0" not in climate.models_for("ssp370") and len(climate.models_for("ssp126")) == 14


def test_zone_legend(spark):
    legend = zones.zone_legend(spark)
    assert legend.count() == 57 and legend.where("arable").count() == 49
    assert legend.where("code = 1").first()["thermal"] == "Tropics"
    assert legend.where("moisture = 'per-humid'").count() == 11


def test_raster(spark):
    cells = spark.createDataFrame([("elev", 0, 1, 7.0), ("elev", 1, 1, 8.0)], "layer string, row int, col int, value double")
    points = spark.createDataFrame([("a", -169.0, 89.0), ("b", -169.0, -89.0)], "env string, lon double, lat double")
    grid = raster.Grid(-180, 90, 10)
    out = {r["env"]: r["value"] for r in raster.sample(points, cells, grid).collect()}
    assert out == {"a": 7.0, "b": None}
    assert raster.within_radius(points, cells, grid, 1).where("env = 'a'").count() == 2
    assert raster.sample_layers(points, cells, grid, ["elev"]).where("env = 'a'").first()["elev"] == 7.0
    assert raster.bioclim_layers(["BIO12", 1]) == ["BIO1", "BIO12"]


def test_runs_resume(spark, tmp_path):
    sites = spark.createDataFrame([("a",), ("b",), ("c/d",)], "env string")
    calls = []

    def fetch(site):
        calls.append(site["env"])
        if site["env"] == "b" and calls.count("b") < 3:
            raise OSError("no answer")
        return spark.createDataFrame([(site["env"], 1.0)], "env string, x double")

    path = str(tmp_path / "run")
    first = runlog.Run(spark, path, {"kind": "weather", "sites": ["a"]})
    assert first.go(sites, fetch, tries=1).count() == 2
    again = runlog.Run(spark, path, {"kind": "weather", "sites": ["a", "b"]})
    assert again.go(sites, fetch, tries=2, sleep=0).count() == 3
    assert calls.count("a") == 1
    with pytest.raises(ValueError, match="another request"):
        runlog.Run(spark, path, {"kind": "soil"})


def test_run_in_batches_and_restart(spark, tmp_path):
    sites = spark.createDataFrame([(f"s{i}", float(i)) for i in range(7)], "env string, lat double")
    gate = tmp_path / "open"

    def service(site):
        if site["env"] == "s3" and not gate.exists():
            raise OSError("no answer")
        return pd.DataFrame({"env": [site["env"]] * 2, "x": [site["lat"], 1.0]})

    path = str(tmp_path / "run")
    run = runlog.Run(spark, path, {"kind": "weather", "years": [1, 2]})
    assert run.go_parallel(sites, service, "env string, x double", chunk=3, tries=1).count() == 12
    states = {r["env"]: (r["status"], r["key"]) for r in runlog.latest(run.log()).collect()}
    assert states["s3"][0] == "failed" and len({k for _, k in states.values()}) == 3
    gate.touch()
    again = runlog.Run.restart(spark, path)
    assert again.request == {"kind": "weather", "years": [1, 2]} and again.sites().count() == 7
    out = again.go_parallel(again.sites(), service, "env string, x double", tries=1)
    assert out.count() == 14 and out.select("env").distinct().count() == 7 and again.log().count() == 8
    with pytest.raises(ValueError, match="no run"):
        runlog.Run.restart(spark, str(tmp_path / "other"))


def test_restart_from_log(spark, tmp_path):
    sites, path = spark.createDataFrame([("a",), ("b",)], "env string"), str(tmp_path / "run")
    broken = lambda site: spark.createDataFrame([(site["env"], 1.0)], "env string, x double") if site["env"] == "a" else 1 / 0
    assert runlog.Run(spark, path, {"kind": "soil"}).go(sites, broken, tries=1).count() == 1
    assert runlog.restart_from_log(spark, path, lambda site: spark.createDataFrame([(site["env"], 2.0)], "env string, x double")).count() == 2


def test_log_with_a_cut_line(spark, tmp_path):
    lines = [json.dumps({"seq": 1, "env": "a", "key": "a", "status": "failed", "time": "t", "message": ""}), json.dumps({"seq": 2, "env": "a", "key": "a", "status": "ok", "time": "t", "message": ""}), '{"seq": 3, "env": "b", "ke']
    (tmp_path / "log.json").write_text("\n".join(lines))
    assert [(r["env"], r["status"]) for r in runlog.read_log(spark, str(tmp_path / "log.json")).collect()] == [("a", "ok")]
    assert runlog.safe_key("a/b c") == "a_b_c"


def test_retry_gives_up():
    tries = []
    with pytest.raises(OSError):
        runlog.retry(lambda: tries.append(1) or (_ for _ in ()).throw(OSError()), 3, 0)
    assert len(tries) == 3 and runlog.chunks([1, 2, 3], 2) == [[1, 2], [3]]


def test_weather_source(spark):
    sites = spark.createDataFrame([("a", -20.0, -45.0, "2024-01-01", "2024-01-03"), ("b", 10.0, 5.0, "2024-02-01", "2024-02-03")], "env string, lat double, lon double, start string, end string")

    def service(site):
        d = pd.date_range(site["start"], site["end"])
        return pd.DataFrame({"env": site["env"], "YYYYMMDD": d.date, "T2M_MAX": 30.0, "T2M_MIN": 20.0, "T2MDEW": 15.0, "PRECTOTCORR": -999.0})

    out = sources.get_weather(sites, service, ["T2M_MAX", "T2M_MIN", "T2MDEW", "PRECTOTCORR"], parallel=2)
    rows = out.orderBy("env", "daysFromStart").collect()
    assert [r["daysFromStart"] for r in rows] == [1, 2, 3] * 2 and rows[0]["PRECTOT"] is None and rows[0]["VPD"] > 0
    with pytest.raises(ValueError, match="a"):
        sources.check_sites(sites.withColumn("lat", F.lit(95.0)))


def test_hourly_source(spark):
    sites = spark.createDataFrame([("a", 0.0, 0.0, "2024-01-01", "2024-01-02")], "env string, lat double, lon double, start string, end string")

    def service(site):
        return pd.DataFrame([{"env": "a", "date": pd.Timestamp(d).date(), "hour": h, "T2M": 20.0 + h, "T2MDEW": 15.0} for d in ("2024-01-01", "2024-01-02") for h in range(24)])

    out = sources.get_weather_hourly(sites, service, ["T2M", "T2MDEW"], thresholds={"T2M": 40.0})
    assert out.count() == 2 and out.where("night_complete").count() == 1
    with pytest.raises(ValueError):
        sources.get_weather_hourly(sites, service, [f"v{i}" for i in range(16)])


def test_soil_source(spark):
    body = {"properties": {"layers": [{"name": "clay", "unit_measure": {"mapped_units": "g/kg"}, "depths": [{"label": "0-5cm", "values": {"Q0.05": 1, "Q0.5": 2, "Q0.95": 3, "mean": 2.5, "uncertainty": 4}}]}]}}
    sites = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0)], "env string, lon double, lat double")
    out = sources.get_soil(sites, lambda s: json.dumps(body), sleep=0)
    assert out.count() == 2 and out.first()["feature"] == "clay|0-5cm" and out.first()["mean"] == 2.5
    assert sources.get_soil(sites, lambda s: json.dumps(body), wide=True, sleep=0).columns == ["env", "lon", "lat", "clay|0-5cm"]


def test_satellite(spark):
    assert spark.range(1).select(satellite.bit_field(F.lit(0b11011000), 3, 5)).first()[0] == 0b011
    rows = [("a", "2024-01-01", 1.0), ("a", "2024-01-05", 5.0), ("a", "2024-02-05", 9.0)]
    df = spark.createDataFrame(rows, "env string, d string, v double").select("env", F.to_date("d").alias("YYYYMMDD"), "v")
    out = {str(r["YYYYMMDD"]): r for r in satellite.to_daily(df, ["v"]).collect()}
    assert out["2024-01-03"]["v"] == 3.0 and not out["2024-01-03"]["v_gap"]
    assert out["2024-01-20"]["v"] is None and out["2024-01-20"]["v_gap"]
    assert out["2024-02-05"]["v"] == 9.0


def test_piecewise(spark):
    df = spark.createDataFrame([(0.0,), (15.0,), (99.0,), (None,)], "x double")
    assert [r[0] for r in df.select(bins.interpolated(F.col("x"), [10, 20], [1, 2])).collect()] == [1.0, 1.5, 2.0, None]


def test_streamed_thermal_time_equals_batch(spark, days, tmp_path):
    src = str(tmp_path / "in")
    table = days.select("env", F.col("daysFromStart").alias("day"), "T2M_MAX", "T2M_MIN")
    table.where("day <= 15").coalesce(1).write.parquet(src)
    stream = streams.running_thermal_time(streams.day_stream(spark, src, "env string, day int, T2M_MAX double, T2M_MIN double"), 10.0, 30.0)
    q = stream.writeStream.format("memory").queryName("tt").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        table.where("day > 12").coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    batch = phenology.env_phenology(days).select("env", F.col("daysFromStart").alias("day"), F.round("cumTT", 6).alias("t"))
    got = spark.table("tt").select("env", "day", F.round("cumTT", 6).alias("t"))
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0


def test_streamed_water_and_runs_go_on_from_where_they_were(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(e, d, float(r), 0.0, 5.0, 40.0, 20.0) for e in ("a", "b") for d, r in enumerate(rng.choice([0, 0, 0, 30], 30))]
    schema, src = "env string, day int, rain double, irrigation double, etc double, taw double, raw double", str(tmp_path / "in")
    for part in (rows[:20] + rows[30:40], rows[20:30] + rows[40:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        out = streams.drained(streams.running_water(streams.day_stream(spark, src, schema)), str(tmp_path / "s"))
    got, want = {(r["env"], r["day"]): (r["ks"], r["drainage"], r["depletion"]) for r in out.collect()}, {}
    for e in ("a", "b"):
        before = 0.0
        for _, day, rain, _, etc, taw, raw in (r for r in rows if r[0] == e):
            ks = 1.0 if before <= raw else max((taw - before) / (taw - raw), 0.0)
            balance = before - rain + ks * etc
            before = min(max(balance, 0.0), taw)
            want[e, day] = (ks, max(-balance, 0.0), before)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_stream_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.sql("SELECT 'a' AS env, ts, CAST(day(ts) AS DOUBLE) AS x FROM (SELECT explode(sequence(timestamp'2024-01-01', timestamp'2024-01-12', interval 1 hour)) AS ts)")
    df.write.parquet(src)
    stream = streams.day_stream(spark, src, "env string, ts timestamp, x double")
    for name, out in (("i", streams.interval_means(stream, "ts", "x")), ("n", streams.night_means(stream, "ts", "x")), ("o", streams.once_per_day(stream.withColumn("date", F.to_date("ts"))))):
        q = out.writeStream.format("memory").queryName(f"s_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("s_o").count() == 12
    assert spark.table("s_i").where("n = 72").count() >= 2
    assert spark.table("s_n").where("n = 10").count() >= 8


def test_quantiles_are_exact(spark):
    from agrolith.operators.ranks import exact_quantiles

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25)])
    df = spark.createDataFrame([(float(v), float(round(v)), None) if i % 7 else (None, float(round(v)), None) for i, v in enumerate(x)], "a double, b double, c double")
    probs = (0.0, 0.05, 0.5, 0.77, 1.0)
    got = exact_quantiles(df, ["a", "b", "c"], probs, ranges=20)
    assert got["c"] == []
    assert got["a"] == pytest.approx(np.quantile([v for i, v in enumerate(x) if i % 7], probs)) and got["b"] == pytest.approx(np.quantile(np.round(x), probs))
    assert exact_quantiles(df.limit(0), ["a"], probs) == {"a": []}
