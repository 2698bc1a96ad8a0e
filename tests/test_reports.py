import pytest
from pyspark.sql import functions as F

from agrolith.models import gibbs, kernelset, reports, simulate
from agrolith.operators import covariables, pca, risk, zones
from agrolith.plans import base
from agrolith.sources import raster, sinks


def test_reports(spark):
    met = simulate.sim_met(K=simulate.sim_markers(10, 40, seed=1).g, n_env=4, seed=1)
    data = met.data.sort_values(["env", "gid"]).reset_index(drop=True)
    ks = kernelset.get_kernel(data, model="EMM")
    fit = gibbs.kernel_model("value", data, ks, how=gibbs.Sampling(60, 20, 2))
    w = base.embedding_w(spark, "/root/testdata/sf0.001")
    for x in (met, ks, fit, simulate.sim_envirome(6, seed=1), simulate.sim_markers(10, 40, seed=1), pca.env_pca(w), covariables.scale_covariables(w)):
        assert len(reports.report(x)) > 20
    assert len(reports.recovery(met)) == 6 and len(reports.env_summary(fit)) == 4
    assert reports.variance_proportions(fit)[0.5].between(0, 1).all()
    profile = risk.env_risk_profile(base.site_days(spark, "/root/testdata/sf0.01"), variables=["T2M_MAX"], by_stage=False)
    assert "stress" in reports.report(profile)
    assert "0 classes rise" in reports.report_delta(risk.project_risk(profile.frequency, profile.frequency))


def test_sinks(spark, tmp_path):
    assert sinks.report_path(None, "a.csv") is None and sinks.report_path(True, "a.csv") == "a.csv"
    assert sinks.report_path("x/b.csv", "a.csv") == "x/b.csv" and sinks.report_path("x", "a.csv") == "x/a.csv"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "env string, x int")
    path = sinks.write_report(df, str(tmp_path), "r.csv")
    assert spark.read.option("header", "true").csv(path).count() == 2
    sinks.write_by_env(df, str(tmp_path / "by"))
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.is_dir()) == ["env=a", "env=b"]


def test_raster_wrappers(spark):
    cells = spark.createDataFrame([(n, r, c, float(r + c)) for n in ("elev", "BIO1", "BIO2") for r in range(4) for c in range(4)], "layer string, row int, col int, value double")
    points = spark.createDataFrame([("a", -165.0, 85.0)], "env string, lon double, lat double")
    grid = raster.Grid(-180, 90, 10)
    assert raster.get_elevation(points, cells, grid).first()["ALT"] == 1.0
    assert raster.get_bioclim(points, cells, grid, [2, "BIO1"]).columns == ["env", "lon", "lat", "BIO1", "BIO2"]
    assert raster.get_spatial(points, cells, grid, ["elev"], merge=True).first()["elev"] == 1.0
    legend = zones.zone_legend(spark)
    one = cells.where("layer = 'elev'")
    assert raster.get_zones(points, one, grid, legend).first()["label"] == "Tropics, lowland; semi-arid"
    around = raster.get_zones(points, one, grid, legend, cells_around=1).first()
    assert around["code"] == 1 and around["share"] == pytest.approx(2 / 6)  # of equals the first by text
    assert raster.sample(points.withColumn("lon", F.lit(170.0)), one, grid).first()["value"] is None
