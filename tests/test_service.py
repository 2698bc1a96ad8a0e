import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from agrolith.plans.base import env_days
from agrolith.sources import service
from agrolith.streaming.days import drained

FACTORY = "agrolith.sources.service:file_service"


@pytest.fixture(scope="module")
def served(spark, sf, tmp_path_factory):
    """Days of ten environments as a service's files, and sites in chunks of three."""
    root = str(tmp_path_factory.mktemp("service"))
    days = env_days(spark, sf).select("env", F.col("date").alias("YYYYMMDD"), "T2M_MAX", "PRECTOT")
    days.repartition("env").write.partitionBy("env").parquet(f"{root}/days")
    sites = days.groupBy("env").agg(F.min("YYYYMMDD").alias("start"), F.max("YYYYMMDD").alias("end")).select("env", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), "start", "end")
    service.write_sites(sites.coalesce(1), f"{root}/sites", 3)
    return root, days.cache()


def asked_of(root, log):
    folder = f"{root}/{log}"
    return [json.load(open(f"{folder}/{f}")) for f in os.listdir(folder)] if os.path.isdir(folder) else []


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_scan_equals_the_table(spark, served):
    root, days = served
    got = service.scan(spark, f"{root}/sites", FACTORY, ["T2M_MAX", "PRECTOT"], path=f"{root}/days", log=f"{root}/all")
    assert rows(got) == rows(days)
    asked = asked_of(root, "all")
    assert sorted(len(a["sites"]) for a in asked) == [1, 3, 3, 3]  # a request for each chunk


def test_filters_and_columns_reach_the_request(spark, served):
    root, days = served
    got = service.scan(spark, f"{root}/sites", FACTORY, ["T2M_MAX", "absent"], path=f"{root}/days", log=f"{root}/some")
    condition = "env IN ('E1', 'E2', 'E7') AND YYYYMMDD > DATE '2024-01-05' AND YYYYMMDD <= DATE '2024-01-20' AND T2M_MAX > 25"
    part = got.where(condition)
    assert rows(part) == rows(days.where(condition).select("env", "YYYYMMDD", "T2M_MAX", F.lit(None).cast("double")))
    asked = asked_of(root, "some")
    assert sorted(e for a in asked for e in a["sites"]) == ["E1", "E2", "E7"] and {(a["first"], a["last"]) for a in asked} == {("2024-01-06", "2024-01-20")}
    assert all(a["variables"] == ["T2M_MAX", "absent"] for a in asked)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "T2M_MAX" in plan[plan.index("Filter") : plan.index("BatchScan")] and "YYYYMMDD" not in plan[plan.index("Filter") : plan.index("BatchScan")].split("\n")[0]


def test_nothing_is_asked_outside_the_filters(spark, served):
    root, _ = served
    got = service.scan(spark, f"{root}/sites", FACTORY, ["T2M_MAX"], path=f"{root}/days", log=f"{root}/none")
    assert got.where("env = 'unknown'").count() == 0 and got.where("YYYYMMDD > DATE '2024-02-01' AND YYYYMMDD < DATE '2024-01-01'").count() == 0
    assert asked_of(root, "none") == []


def test_a_lost_task_asks_for_its_chunk_again(served):
    root, _ = served
    options = service.options(f"{root}/sites", FACTORY, ["T2M_MAX"], path=f"{root}/days", log=f"{root}/lost")
    source = service.WeatherService(options)
    from pyspark.sql.types import StructType

    reader = source.reader(StructType.fromDDL(source.schema()))
    chunks = reader.partitions()
    assert len(chunks) == 4
    first = list(reader.read(chunks[0]))
    assert [b.to_pylist() for b in reader.read(chunks[0])] == [b.to_pylist() for b in first]
    asked = asked_of(root, "lost")
    assert len(asked) == 2 and asked[0]["sites"] == asked[1]["sites"]


def test_stream_goes_on_from_the_last_complete_day(spark, sf, served, tmp_path):
    root, days = served
    own = f"{tmp_path}/days"
    early = days.where("YYYYMMDD <= DATE '2024-01-10'")
    early.repartition("env").write.partitionBy("env").parquet(own)
    make = lambda: service.stream(spark, f"{root}/sites", FACTORY, ["T2M_MAX", "PRECTOT"], path=own, log=f"{tmp_path}/log")
    last = early.groupBy("env").agg(F.max("YYYYMMDD").alias("d")).agg(F.min("d")).first()[0]
    out = drained(make(), f"{tmp_path}/run")
    assert rows(out) == rows(days.where(F.col("YYYYMMDD") <= F.lit(last)))
    days.where("YYYYMMDD > DATE '2024-01-10'").repartition("env").write.mode("append").partitionBy("env").parquet(own)
    out = drained(make(), f"{tmp_path}/run")
    last = days.groupBy("env").agg(F.max("YYYYMMDD").alias("d")).agg(F.min("d")).first()[0]
    assert rows(out) == rows(days.where(F.col("YYYYMMDD") <= F.lit(last)))
    assert {a["first"] for a in asked_of(tmp_path, "log")} >= {"0001-01-02", str(date(2024, 1, 11))} or len({a["first"] for a in asked_of(tmp_path, "log")}) == 2


def test_no_sites(spark, served, tmp_path):
    root, _ = served
    empty = spark.createDataFrame([], "env string, lat double, lon double, start date, end date")
    assert service.scan(spark, service.write_sites(empty, f"{tmp_path}/sites"), FACTORY, ["T2M_MAX"], path=f"{root}/days").collect() == []
