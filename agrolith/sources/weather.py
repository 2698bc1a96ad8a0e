"""Sources of weather and soil: adapters to services, offline readers, and what follows a download.

A service is any function of one site that returns rows; it runs in tasks, one site a row, and never on the driver. No
service ships with the package: the container and most clusters have no route to one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.constants import DAILY_VARIABLES, HOURLY_VARIABLES, SOIL_DIVISORS
from agrolith.operators.hourly import daily_from_hourly, night_flag
from agrolith.operators.weather import finish_download
from agrolith.schema import require
from agrolith.sources.runlog import Run, retry

MAX_HOURLY = 15


def check_sites(sites: DataFrame) -> DataFrame:
    """(env, lat, lon, start, end) as a table; raises on coordinates off the globe or dates in the wrong order."""
    require(sites, ["env", "lat", "lon", "start", "end"])
    bad = sites.where(~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180) | (F.to_date("start") > F.to_date("end")) | F.col("lat").isNull() | F.col("lon").isNull())
    names = [r[0] for r in bad.select("env").limit(20).collect()]
    if names:
        raise ValueError(f"coordinates or dates are wrong for {', '.join(map(str, names))}")
    return sites.withColumns({"start": F.to_date("start"), "end": F.to_date("end")})


def fetch_sites(sites: DataFrame, service: Callable[[dict], pd.DataFrame], schema: str, parallel: int = 4, tries: int = 3, sleep: float = 1.0) -> DataFrame:
    """Rows of a service for all sites, so many sites at once as partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for site in batch.to_dict("records"):
                yield retry(lambda site=site: service(site), tries, sleep)

    return sites.repartition(parallel, "env").mapInPandas(run, schema)


def get_weather(sites: DataFrame, service: Callable[[dict], pd.DataFrame], variables: Sequence[str] = DAILY_VARIABLES, **fetching) -> DataFrame:
    """Daily weather of sites: the service returns env, YYYYMMDD (date) and the variables."""
    sites = check_sites(sites)
    schema = "env string, YYYYMMDD date, " + ", ".join(f"{v} double" for v in variables)
    rows = fetch_sites(sites, service, schema, **fetching)
    return daily_weather(rows, sites, variables)


def daily_weather(rows: DataFrame, sites: DataFrame, variables: Sequence[str] = DAILY_VARIABLES) -> DataFrame:
    """Downloaded or stored days with their sites' coordinates, day numbers and derived columns."""
    at = sites.select("env", F.col("lat").alias("LAT"), F.col("lon").alias("LON"), F.to_date("start").alias("_start"))
    return finish_download(rows.join(at, "env"), variables, "_start").drop("_start")


def get_weather_hourly(sites: DataFrame, service: Callable[[dict], pd.DataFrame], variables: Sequence[str] = HOURLY_VARIABLES, night: str = "solar", night_hours: Sequence[int] = (), predawn: Sequence[int] = (2, 3, 4, 5), summarise: bool = True, thresholds: dict[str, float] | None = None, **fetching) -> DataFrame:
    """Hourly weather, or its daily summary with day and night parts. Services allow fifteen variables at once."""
    if len(variables) > MAX_HOURLY:
        raise ValueError(f"at most {MAX_HOURLY} hourly variables at once")
    sites = check_sites(sites)
    schema = "env string, date date, hour int, " + ", ".join(f"{v} double" for v in variables)
    rows = fetch_sites(sites, service, schema, **fetching).join(sites.select("env", F.col("lat").alias("LAT")), "env")
    rows = rows.withColumns({v: F.when(F.col(v) >= -900, F.col(v)) for v in variables})
    return daily_from_hourly(rows, variables, night_flag(rows, night, night_hours), predawn, thresholds=thresholds) if summarise else rows


def soil_profiles(responses: DataFrame, sites: DataFrame, wide: bool = False, stat: str = "mean") -> DataFrame:
    """Long soil profiles from JSON responses (lon, lat, json), for every site at those coordinates; or one column property|layer each."""
    depth = "struct<label:string, values:struct<`Q0.05`:double,`Q0.5`:double,`Q0.95`:double,mean:double,uncertainty:double>>"
    layer = f"struct<name:string, unit_measure:struct<mapped_units:string>, depths:array<{depth}>>"
    parsed = responses.select("lon", "lat", F.inline(F.from_json("json", f"struct<properties:struct<layers:array<{layer}>>>")["properties"]["layers"]))
    long = parsed.select("lon", "lat", F.col("name").alias("property"), F.col("unit_measure.mapped_units").alias("unit"), F.inline("depths"))
    long = long.select("lon", "lat", "property", F.col("label").alias("depth"), F.concat_ws("|", "property", "label").alias("feature"), "unit", F.col("values.`Q0.05`").alias("q_5"), F.col("values.`Q0.5`").alias("q_50"), F.col("values.`Q0.95`").alias("q_95"), F.col("values.mean").alias("mean"), F.col("values.uncertainty").alias("uncertainty"))
    out = sites.select("env", "lon", "lat").join(long, ["lon", "lat"])
    if not wide:
        return out.select("env", "lon", "lat", "property", "depth", "feature", "unit", "q_5", "q_50", "q_95", "mean", "uncertainty")
    names = sorted(r[0] for r in out.select("feature").distinct().collect())
    return out.groupBy("env", "lon", "lat").pivot("feature", names).agg(F.first(stat))


def get_soil(sites: DataFrame, service: Callable[[dict], str], wide: bool = False, stat: str = "mean", parallel: int = 1, tries: int = 3, sleep: float = 12.0, properties: Sequence[str] = tuple(SOIL_DIVISORS)) -> DataFrame:
    """Soil profiles: each place is asked once, however many sites share it. The service returns a JSON response."""
    unknown = set(properties) - set(SOIL_DIVISORS)
    if unknown:
        raise ValueError(f"unknown soil properties: {', '.join(sorted(unknown))}")
    places = sites.select("lon", "lat").dropDuplicates().withColumn("env", F.concat_ws(",", "lon", "lat"))
    rows = fetch_sites(places, lambda site: pd.DataFrame([{"lon": site["lon"], "lat": site["lat"], "json": service(site)}]), "lon double, lat double, json string", parallel, tries, sleep)
    return soil_profiles(rows, sites, wide, stat)


def get_weather_resumable(spark: SparkSession, path: str, sites: DataFrame, fetch: Callable[[dict], DataFrame], request: dict, **going) -> DataFrame:
    """Daily weather by a run that can be taken up again; ``fetch`` gives one site's table."""
    return Run(spark, path, {"kind": "weather", **request}).go(check_sites(sites), fetch, **going)


def get_weather_in_batches(spark: SparkSession, path: str, sites: DataFrame, service: Callable[[dict], pd.DataFrame], request: dict, variables: Sequence[str] = DAILY_VARIABLES, **going) -> DataFrame:
    """Daily weather by a run that can be taken up again, in batches of sites that tasks fetch; see ``Run.go_parallel``."""
    sites, schema = check_sites(sites), "env string, YYYYMMDD date, " + ", ".join(f"{v} double" for v in variables)
    return daily_weather(Run(spark, path, {"kind": "weather", **request}).go_parallel(sites, service, schema, **going), sites, variables)


def get_soil_resumable(spark: SparkSession, path: str, sites: DataFrame, fetch: Callable[[dict], DataFrame], request: dict, wide: bool = False, stat: str = "mean", **going) -> DataFrame:
    """Soil profiles by a run that can be taken up again; parts are stored long and pivoted at the end."""
    long = Run(spark, path, {"kind": "soil", **request}).go(sites, fetch, **going)
    if not wide:
        return long
    names = sorted(r[0] for r in long.select("feature").distinct().collect())
    return long.groupBy("env").pivot("feature", names).agg(F.first(stat))


_SOIL = "env string, lon double, lat double, json string"


def get_soil_in_batches(spark: SparkSession, path: str, sites: DataFrame, service: Callable[[dict], str], request: dict, wide: bool = False, stat: str = "mean", **going) -> DataFrame:
    """Soil profiles by a run that can be taken up again, in batches of places that tasks fetch; see ``Run.go_parallel``.

    Each place is asked once, however many sites share it. ``service`` returns a JSON response; responses are stored as they come and
    parsed at the end, so a restart (``restart_in_batches``) needs no service for what is done.
    """
    places = sites.select("lon", "lat").dropDuplicates().select(F.concat_ws(",", "lon", "lat").alias("env"), "lon", "lat")
    ask = lambda site: pd.DataFrame([{"env": site["env"], "lon": site["lon"], "lat": site["lat"], "json": service(site)}])
    responses = Run(spark, path, {"kind": "soil", **request}).go_parallel(places, ask, _SOIL, **going)
    return soil_profiles(responses.drop("env"), sites, wide, stat)
