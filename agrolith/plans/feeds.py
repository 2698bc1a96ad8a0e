"""Services, ingest and timed state, over what the tables hold: each is written to the shared folder as its source would give it."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.operators import water
from agrolith.plans import phenology
from agrolith.plans.base import ENV_DAYS, env_days, rounded, table
from agrolith.session import shared_folder
from agrolith.sources import service
from agrolith.streaming import timers
from agrolith.streaming.days import day_stream, drained
from agrolith.streaming.ingest import Ingested

QUERIES, SQL = {}, {}
_FACTORY = "agrolith.sources.service:file_service"
_VARIABLES = ("T2M_MAX", "T2M_MIN", "PRECTOT")


def _served(spark, sf_dir):
    """A service's folder of days, and its sites' files of at most three each."""
    folder = shared_folder(spark, "service")
    days = env_days(spark, sf_dir).select("env", F.col("date").alias("YYYYMMDD"), *_VARIABLES)
    days.repartition("env").write.partitionBy("env").parquet(f"{folder}/days")
    sites = days.groupBy("env").agg(F.min("YYYYMMDD").alias("start"), F.max("YYYYMMDD").alias("end"))
    service.write_sites(sites.withColumns({"lat": F.lit(0.0), "lon": F.lit(0.0)}), f"{folder}/sites", 3)
    return folder


def scan_data_source(spark, sf_dir):
    folder = _served(spark, sf_dir)
    days = service.scan(spark, f"{folder}/sites", _FACTORY, _VARIABLES, path=f"{folder}/days")
    return rounded(days.where("env <> 'E3' AND YYYYMMDD > DATE '2024-01-03' AND YYYYMMDD <= DATE '2024-01-25'"), 6)


SQL["scan_data_source"] = f"WITH {ENV_DAYS} SELECT env, date AS YYYYMMDD, round(T2M_MAX, 6) AS T2M_MAX, round(T2M_MIN, 6) AS T2M_MIN, round(PRECTOT, 6) AS PRECTOT FROM d WHERE env <> 'E3' AND date > DATE '2024-01-03' AND date <= DATE '2024-01-25'"


def stream_data_source(spark, sf_dir):
    """Days up to the last that all sites have."""
    folder = _served(spark, sf_dir)
    days = service.stream(spark, f"{folder}/sites", _FACTORY, _VARIABLES, path=f"{folder}/days")
    return rounded(drained(days, f"{folder}/run"), 6)


SQL["stream_data_source"] = f"WITH {ENV_DAYS}, t AS (SELECT min(m) AS top FROM (SELECT max(date) AS m FROM d GROUP BY env)) SELECT env, date AS YYYYMMDD, round(T2M_MAX, 6) AS T2M_MAX, round(T2M_MIN, 6) AS T2M_MIN, round(PRECTOT, 6) AS PRECTOT FROM d, t WHERE date <= top"


def ingest_upsert(spark, sf_dir):
    """Prices of a supplier and day from a stream of line items: the greatest order key is the last correction."""
    folder = shared_folder(spark, "ingest")
    line = table(spark, sf_dir, "lineitem")
    sent = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = line.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("env"), F.to_date("l_shipdate").alias("day"), F.round("l_extendedprice", 2).alias("value"), sent.cast("long").alias("sent"))
    rows.repartition(6, "sent").write.parquet(f"{folder}/in")
    schema = "env string, day date, value double, sent long"
    out = Ingested(spark, f"{folder}/table", schema, ("env", "day"), "sent", "concat(year(day), '-', pmod(hash(env), 2))")
    out.run(day_stream(spark, f"{folder}/in", schema, 2))
    return out.table()


SQL["ingest_upsert"] = "SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS env, CAST(l_shipdate AS DATE) AS day, arg_max(round(l_extendedprice, 2), (l_orderkey * 8 + l_linenumber, round(l_extendedprice, 2))) AS value, CAST(max(l_orderkey * 8 + l_linenumber) AS BIGINT) AS sent FROM lineitem GROUP BY 1, 2"


def _shuffled(spark, rows, name):
    """Rows as a stream of files in which a day comes up to three days late, the order within a file being that of a hash."""
    folder = shared_folder(spark, name)
    arrives = F.datediff("date", F.lit("2024-01-01").cast("date")) + F.pmod(F.xxhash64("env", "date"), F.lit(4))
    files = rows.withColumn("_arrives", arrives.cast("int"))
    for (k,) in sorted(files.select("_arrives").distinct().collect()):  # a file for each day of arrival
        files.where(F.col("_arrives") == k).drop("_arrives").orderBy(F.xxhash64("date", "env")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return day_stream(spark, f"{folder}/in", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), 4), folder


def timed_thermal_time(spark, sf_dir):
    days = env_days(spark, sf_dir).select("env", "date", "T2M_MAX", "T2M_MIN")
    with timers.timed_state(spark):
        source, folder = _shuffled(spark, days, "timed")
        out = drained(timers.thermal_time(source, 8.0, 30.0, late="8 days"), f"{folder}/run")
    return out.select("env", "day", F.round("dTT", 4).alias("dTT"), F.round("cumTT", 3).alias("cumTT"))


_PASSED = "date_diff('day', DATE '1970-01-01', date) + 1 <= date_diff('day', DATE '1970-01-01', top) - 8"
SQL["timed_thermal_time"] = f"""WITH {ENV_DAYS}, e AS (SELECT max(date) AS top FROM d), t AS (SELECT env, date, greatest((least(greatest(T2M_MAX, 8), 30) + least(greatest(T2M_MIN, 8), 30)) / 2 - 8, 0) AS g FROM d)
SELECT env, CAST(date_diff('day', DATE '1970-01-01', date) AS INTEGER) AS day, round(g, 4) AS dTT, round(sum(g) OVER (PARTITION BY env ORDER BY date), 3) AS cumTT FROM t, e QUALIFY {_PASSED}"""


def timed_soil_water(spark, sf_dir):
    demand = water.daily_demand(phenology._water_days(spark, sf_dir), phenology._capacity(spark)).withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))
    rows = demand.select("env", "date", "rain", "irrigation", "etc", "taw", "raw")
    with timers.timed_state(spark):
        source, folder = _shuffled(spark, rows, "timed")
        out = drained(timers.soil_water(source, late="8 days"), f"{folder}/run")
    return rounded(out.select("env", F.datediff(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), F.lit("2024-01-01").cast("date")).alias("day"), "ks", "drainage", "depletion"))


SQL["timed_soil_water"] = f"WITH RECURSIVE {phenology._WATER} SELECT env, day, round(ks, 4) AS ks, round(drainage, 4) AS drainage, round(dr, 4) AS depletion FROM bal, (SELECT max(day) AS top FROM bal) WHERE day + 1 <= top - 8"

QUERIES |= {f.__name__: f for f in (scan_data_source, stream_data_source, ingest_upsert, timed_thermal_time, timed_soil_water)}
