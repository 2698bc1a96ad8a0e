"""Downloads of soil in batches, restarts, and runs that stop after a streak of failures."""

import pandas as pd
import pytest

from agrolith.sources import runlog, weather


def test_soil_in_batches_asks_each_place_once_and_goes_on(spark, tmp_path):
    sites = spark.createDataFrame([(f"S{i}", float(i % 5), 10.0) for i in range(8)], "env string, lon double, lat double")
    def response(site):
        import json

        depth = {"label": "0-5cm", "values": {"Q0.05": 1.0, "Q0.5": 2.0, "Q0.95": 3.0, "mean": site["lon"] + site["lat"], "uncertainty": 0.1}}
        return json.dumps({"properties": {"layers": [{"name": "clay", "unit_measure": {"mapped_units": "g/kg"}, "depths": [depth]}]}})

    gate, asked = tmp_path / "open", tmp_path / "asked"
    asked.mkdir()

    def service(site):
        (asked / f"{site['env']}-{len(list(asked.glob(site['env'] + '-*')))}").touch()
        if site["lon"] == 3 and not gate.exists():
            raise OSError("no answer")
        return response(site)

    path = str(tmp_path / "run")
    first = weather.get_soil_in_batches(spark, path, sites, service, {"properties": ["clay"]}, chunk=2, tries=1)
    assert {r["env"]: r["mean"] for r in first.collect()} == {f"S{i}": i % 5 + 10.0 for i in range(8) if i % 5 != 3}
    gate.touch()
    ask = lambda site: pd.DataFrame([{"env": site["env"], "lon": site["lon"], "lat": site["lat"], "json": response(site)}])
    rows = runlog.restart_in_batches(spark, path, ask, weather._SOIL, tries=1)
    assert rows.count() == 5
    wide = weather.get_soil_in_batches(spark, path, sites, service, {"properties": ["clay"]}, wide=True, tries=1)
    assert wide.count() == 8 and "clay|0-5cm" in wide.columns
    assert len(list(asked.iterdir())) == 5  # nothing that is done is asked again
    with pytest.raises(ValueError, match="another request"):
        weather.get_soil_in_batches(spark, path, sites, service, {"properties": ["sand"]})


@pytest.mark.parametrize("chunk", [1, 2, 29])
def test_a_streak_over_batches_ends_a_run(spark, tmp_path, chunk):
    sites = spark.createDataFrame([(f"s{i:02d}",) for i in range(12)], "env string")

    def service(site):
        if site["env"] >= "s03":
            raise OSError("down")
        return pd.DataFrame({"env": [site["env"]], "x": [1.0]})

    run = runlog.Run(spark, str(tmp_path / "run"), {"kind": "weather"}, max_streak=4)
    assert run.go_parallel(sites, service, "env string, x double", chunk=chunk, tries=1).count() == 3
    assert run.log().count() == {1: 7, 2: 8, 29: 12}[chunk]
