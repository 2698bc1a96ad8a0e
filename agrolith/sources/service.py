"""Weather services as a Spark data source: ``spark.read.format("weather_service")`` and the same for streams.

A scan's partitions are chunks of sites, as large as a service takes at once; each task asks for its chunk alone, so a lost task asks
again for that. Filters on env and YYYYMMDD become part of the request, and only the asked variables are fetched. A stream's offset
is the last day that the service has for all sites: each batch asks for the days after the last offset.

A service is any object with ``days(sites, variables, first, last)``, which yields record batches of env, YYYYMMDD and the variables, and
``complete_until()``, the last complete day or None. The option ``service`` names its factory as module:function, and ``service_options``
holds that function's keyword arguments as JSON: tasks build it themselves. Sites are files of (env, lat, lon, start, end), a chunk each, in a shared folder.

Defined results: a site's own dates bound its request; sites without days give no rows; repeated sites are asked twice; variables a service
lacks are null; an empty table of sites gives no rows.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from datetime import date, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

NAME = "weather_service"
_DAY = timedelta(days=1)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if urlsplit(uri).scheme else (fs.LocalFileSystem(), uri)


class FileService:
    """Days in a folder of Parquet files, one subfolder env=... for each site. ``log`` is a folder that gets a file for each request."""

    def __init__(self, path: str, log: str | None = None):
        self.path, self.log = path, log

    def days(self, sites: Sequence[dict], variables: Sequence[str], first: date | None, last: date | None) -> Iterator[pa.RecordBatch]:
        if self.log:
            self._note(sites, variables, first, last)
        store, root = _opened(self.path)
        for site in sites:
            folder = f"{root}/env={site['env']}"
            if store.get_file_info(folder).type == fs.FileType.NotFound:
                continue
            found = ds.dataset(folder, filesystem=store, format="parquet")
            low = max((x for x in (first, site["start"]) if x), default=date.min)
            high = min((x for x in (last, site["end"]) if x), default=date.max)
            asked = [v for v in variables if v in found.schema.names]
            day = ds.field("YYYYMMDD")
            for batch in found.to_batches(columns=["YYYYMMDD", *asked], filter=(day >= low) & (day <= high)):
                yield batch.append_column("env", pa.array([site["env"]] * batch.num_rows, pa.string()))

    def complete_until(self) -> date | None:
        store, root = _opened(self.path)
        tops = []
        for info in store.get_file_info(fs.FileSelector(root)):
            if info.type == fs.FileType.Directory and info.base_name.startswith("env="):
                found = ds.dataset(info.path, filesystem=store, format="parquet").to_table(columns=["YYYYMMDD"])
                tops.append(max(found["YYYYMMDD"].to_pylist(), default=None))
        return None if not tops or None in tops else min(tops)

    def _note(self, sites, variables, first, last) -> None:
        store, root = _opened(self.log)
        store.create_dir(root)
        asked = {"sites": [s["env"] for s in sites], "variables": list(variables), "first": str(first), "last": str(last)}
        with store.open_output_stream(f"{root}/{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(asked).encode())


def file_service(**options) -> FileService:
    return FileService(**options)


@dataclass(frozen=True)
class Asked:
    """What filters leave of the request; ``envs`` None stands for all."""

    envs: frozenset[str] | None = None
    first: date | None = None
    last: date | None = None

    def and_envs(self, names) -> Asked:
        return replace(self, envs=frozenset(names) if self.envs is None else self.envs & frozenset(names))

    def and_days(self, first: date | None = None, last: date | None = None) -> Asked:
        return replace(self, first=max((x for x in (self.first, first) if x), default=None), last=min((x for x in (self.last, last) if x), default=None))

    def narrowed(self, f: Filter) -> Asked | None:
        """With a filter's condition; None if it can't be asked of a service."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name == "env" and isinstance(f, EqualTo):
            return self.and_envs([f.value])
        if name == "env" and isinstance(f, In):
            return self.and_envs(f.value)
        if name == "YYYYMMDD" and isinstance(getattr(f, "value", None), date):
            if isinstance(f, EqualTo):
                return self.and_days(f.value, f.value)
            if isinstance(f, GreaterThanOrEqual):
                return self.and_days(first=f.value)
            if isinstance(f, GreaterThan):
                return self.and_days(first=f.value + _DAY)
            if isinstance(f, LessThanOrEqual):
                return self.and_days(last=f.value)
            if isinstance(f, LessThan):
                return self.and_days(last=f.value - _DAY)
        if name in ("env", "YYYYMMDD") and isinstance(f, IsNotNull):
            return self  # a service gives no nulls there
        return None


@dataclass
class Chunk(InputPartition):
    path: str
    asked: Asked


class _Requests:
    """What scans and streams share: the service, the files of sites, and the reading of one chunk."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = dict(options), schema
        self.variables = [f.name for f in schema.fields if f.name not in ("env", "YYYYMMDD")]

    def service(self):
        module, _, name = self.options["service"].partition(":")
        return getattr(importlib.import_module(module), name)(**json.loads(self.options.get("service_options", "{}")))

    def chunks(self, asked: Asked) -> list[Chunk]:
        store, root = _opened(self.options["sites"])
        files = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".parquet")]
        return [Chunk(path, asked) for path in sorted(files)]

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        sites = pq.read_table(chunk.path, filesystem=_opened(self.options["sites"])[0]).to_pylist()
        asked = chunk.asked
        sites = [s for s in sites if asked.envs is None or s["env"] in asked.envs]
        if not sites or (asked.first and asked.last and asked.first > asked.last):
            return
        names = [f.name for f in self.schema.fields]
        for batch in self.service().days(sites, self.variables, asked.first, asked.last):
            n = batch.num_rows
            kinds = {"env": pa.string(), "YYYYMMDD": pa.date32()}
            columns = [batch.column(c).cast(kinds.get(c, pa.float64())) if c in batch.schema.names else pa.nulls(n, kinds.get(c, pa.float64())) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)


class Reader(DataSourceReader):
    def __init__(self, requests: _Requests):
        self.requests, self.asked = requests, Asked()

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            narrowed = self.asked.narrowed(f)
            if narrowed is None:
                yield f
            else:
                self.asked = narrowed

    def partitions(self) -> Sequence[InputPartition]:
        return self.requests.chunks(self.asked)

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        return self.requests.read(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are days: {"day": the last one that has come}."""

    def __init__(self, requests: _Requests):
        self.requests = requests

    def initialOffset(self) -> dict:
        return {"day": self.requests.options.get("after", "0001-01-01")}

    def latestOffset(self) -> dict:
        day = self.requests.service().complete_until()
        return {"day": max(str(day), self.initialOffset()["day"])} if day else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = date.fromisoformat(start["day"]) + _DAY, date.fromisoformat(end["day"])
        return self.requests.chunks(Asked(None, first, last)) if first <= last else []

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        return self.requests.read(partition)


class WeatherService(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(["env string", "YYYYMMDD date", *[f"`{v}` double" for v in self.options["variables"].split(",")]])

    def reader(self, schema: StructType) -> Reader:
        return Reader(_Requests(self.options, schema))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(_Requests(self.options, schema))


def write_sites(sites: DataFrame, folder: str, chunk: int = 29) -> str:
    """Files of at most ``chunk`` sites (env, lat, lon, start, end), by env; each becomes a partition of a scan."""
    rows = sites.select(F.col("env").cast("string").alias("env"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    rows.sort("env").write.option("maxRecordsPerFile", chunk).mode("overwrite").parquet(folder)
    return folder


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WeatherService)


def options(sites: str, service: str, variables: Sequence[str], **service_options) -> dict[str, str]:
    """Options of a scan or stream over sites that ``write_sites`` wrote."""
    return {"sites": sites, "service": service, "variables": ",".join(variables), "service_options": json.dumps(service_options)}


def scan(spark: SparkSession, sites: str, service: str, variables: Sequence[str], **service_options) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).options(**options(sites, service, variables, **service_options)).load()


def stream(spark: SparkSession, sites: str, service: str, variables: Sequence[str], after: str | None = None, **service_options) -> DataFrame:
    """Days after ``after``, as they become complete for all sites."""
    register(spark)
    start = {"after": after} if after else {}
    return spark.readStream.format(NAME).options(**options(sites, service, variables, **service_options), **start).load()
