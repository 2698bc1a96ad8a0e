"""Resumable runs: parts of a result stored by environment, and a log that tells what is done.

A run is a folder: ``manifest`` (fingerprint of the request, and the request), ``sites`` (Parquet), ``progress`` (JSON lines:
seq, env, key, status, time, message) and ``parts`` (Parquet, one folder for each environment or batch of them). The folder
alone is enough to go on with a run: see ``Run.restart``.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_SCHEMA = "seq long, env string, key string, status string, time string, message string"


def fingerprint(request: dict) -> str:
    """Of the request without its sites, so that a run can go on with more of them."""
    kept = {k: v for k, v in request.items() if k not in ("env", "lat", "lon", "sites")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()[:16]


def safe_key(env: str) -> str:
    """A name for files: other characters than letters, digits, dot, dash and underscore become underscores."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", env)


def read_log(spark: SparkSession, path: str, all_records: bool = False) -> DataFrame:
    """Records of a log, by default the latest of each environment. A line that was cut off is passed over."""
    log = spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("env IS NOT NULL")
    return log if all_records else latest(log)


def latest(log: DataFrame, key: str = "env", order: str = "seq") -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def todo(sites: DataFrame, log: DataFrame, retry_failed: bool = True, key: str = "env") -> DataFrame:
    """Sites without a successful record; without ``retry_failed`` also without a failed one."""
    done = latest(log, key)
    if retry_failed:
        done = done.where("status = 'ok'")
    return sites.join(done.select(key), key, "left_anti")


def retry(call: Callable, tries: int = 3, sleep: float = 1.0, exponential: bool = False, most: float = 60.0):
    """The call's result; waits grow linearly, or double up to ``most``."""
    for i in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if i == tries:
                raise
            time.sleep(min(most, sleep * (2 ** (i - 1) if exponential else i)))


_MANIFEST = "fingerprint string, request string"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    place, store = _place(spark, path)
    return store.exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    place, store = _place(spark, path)
    store.delete(place, True)


def restart_from_log(spark: SparkSession, path: str, fetch: Callable[[dict], DataFrame], retry_failed: bool = True, **going) -> DataFrame:
    """Go on with the run of a folder, which holds its request and sites."""
    run = Run.restart(spark, path)
    return run.go(run.sites(), fetch, retry_failed, **going)


def restart_in_batches(spark: SparkSession, path: str, service: Callable[[dict], pd.DataFrame], schema: str, retry_failed: bool = True, **going) -> DataFrame:
    """Like ``restart_from_log``, in batches of sites that tasks fetch; see ``Run.go_parallel``."""
    run = Run.restart(spark, path)
    return run.go_parallel(run.sites(), service, schema, retry_failed=retry_failed, **going)


def chunks(items: Sequence, size: int) -> list:
    return [items[i : i + size] for i in range(0, len(items), size)]


class Run:
    """A resumable run over sites. The folder is read and written by Spark, so it can be in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, request: dict, max_streak: int = 5):
        self.spark, self.path, self.print, self.max_streak = spark, path.rstrip("/"), fingerprint(request), max_streak
        self.request = request
        found = self._read(f"{self.path}/manifest", _MANIFEST)
        known = [r[0] for r in found.limit(1).collect()] if found is not None else []
        if known and known[0] != self.print:
            raise ValueError("the folder holds a run of another request")
        if not known:
            row = (self.print, json.dumps(request, sort_keys=True, default=str))
            spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest")

    @classmethod
    def restart(cls, spark: SparkSession, path: str, max_streak: int = 5) -> Run:
        """The run that a folder holds, with the request of its manifest; its sites are ``sites()``."""
        manifest = f"{path.rstrip('/')}/manifest"
        if not _exists(spark, manifest):
            raise ValueError(f"no run in {path}")
        row = spark.read.schema(_MANIFEST).json(manifest).first()
        return cls(spark, path, json.loads(row["request"]), max_streak)

    def _read(self, path: str, schema: str):
        return self.spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path) if _exists(self.spark, path) else None

    def sites(self) -> DataFrame:
        """The sites that the run was last asked for."""
        if not _exists(self.spark, f"{self.path}/sites"):
            raise ValueError("the folder holds no sites")
        return self.spark.read.parquet(f"{self.path}/sites")

    def _kept_sites(self, sites: DataFrame) -> DataFrame:
        """The sites, stored: a list of places that was asked for, one short row each, read before its folder is written."""
        self.spark.createDataFrame(sites.collect(), sites.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sites")
        return self.sites()

    def log(self) -> DataFrame:
        found = self._read(f"{self.path}/progress", LOG_SCHEMA)
        return found.where("env IS NOT NULL") if found is not None else self.spark.createDataFrame([], LOG_SCHEMA)

    def _record(self, records: list[tuple]) -> None:
        self.spark.createDataFrame(records, LOG_SCHEMA).coalesce(1).write.mode("append").json(f"{self.path}/progress")

    def go(self, sites: DataFrame, fetch: Callable[[dict], DataFrame], retry_failed: bool = True, tries: int = 3, sleep: float = 1.0) -> DataFrame:
        """Fetch what is left, site by site as services with rate limits need it, and return all parts together. Ends early after a streak of failures."""
        self._check(sites)
        sites = self._kept_sites(sites)
        streak = 0
        for site in todo(sites, self.log(), retry_failed).orderBy("env").collect():
            now = lambda: datetime.now(timezone.utc).isoformat(timespec="seconds")
            key, seq = safe_key(site["env"]), time.time_ns()
            try:
                retry(lambda: fetch(site.asDict()), tries, sleep).write.mode("overwrite").parquet(f"{self.path}/parts/part={key}")
                self._record([(seq, site["env"], key, "ok", now(), "")])
                streak = 0
            except Exception as e:  # one site's failure is a record, not the end
                self._record([(seq, site["env"], key, "failed", now(), str(e)[:200])])
                streak += 1
                if streak >= self.max_streak:
                    break
        return self.assemble()

    def _check(self, sites: DataFrame) -> None:
        if not sites.groupBy("env").count().where("count > 1").isEmpty():
            raise ValueError("environments must have names of their own")

    def go_parallel(self, sites: DataFrame, service: Callable[[dict], pd.DataFrame], schema: str, parallel: int = 4, chunk: int = 29, pause: float = 0.0, retry_failed: bool = True, tries: int = 3, sleep: float = 1.0) -> DataFrame:
        """Fetch what is left in batches of ``chunk`` sites, so many at once in tasks, with a pause between batches; return all parts together.

        A batch is one job that writes its rows and one that writes its records. A batch that is lost midway has no records, so its
        sites are fetched again. ``service`` runs in tasks, and its rows follow ``schema``, with a string ``env``. Ends early, after a batch, when
        the last ``max_streak`` sites or more have failed, counted by name and over batches.
        """
        self._check(sites)
        sites = self._kept_sites(sites)
        names = [f.name for f in self.spark.createDataFrame([], schema).schema.fields]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for site in batch.to_dict("records"):
                    try:
                        rows = retry(lambda site=site: service(site), tries, sleep)
                        yield rows[names].assign(_env=site["env"], _message=None)
                    except Exception as e:  # one site's failure is a record, not the end
                        yield pd.DataFrame([{**dict.fromkeys(names), "_env": site["env"], "_message": str(e)[:200] or type(e).__name__}])

        left, streak = todo(sites, self.log(), retry_failed).orderBy("env").collect(), 0
        for at, own in enumerate(chunks(left, chunk)):
            if at and pause:
                time.sleep(pause)
            seq, now = time.time_ns(), datetime.now(timezone.utc).isoformat(timespec="seconds")
            key, batch = f"batch-{seq}", self.spark.createDataFrame(own, sites.schema)
            fetched = batch.repartition(parallel, "env").mapInPandas(run, f"{schema}, _env string, _message string")
            fetched.write.parquet(f"{self.path}/staging/{key}")
            stored = self.spark.read.parquet(f"{self.path}/staging/{key}")
            stored.where("_message IS NULL").drop("_env", "_message").write.parquet(f"{self.path}/parts/part={key}")
            states = batch.select("env").join(stored.groupBy(F.col("_env").alias("env")).agg(F.max("_message").alias("message")), "env", "left")
            ok = F.col("message").isNull()
            records = states.select(F.lit(seq).alias("seq"), "env", F.lit(key).alias("key"), F.when(ok, "ok").otherwise("failed").alias("status"), F.lit(now).alias("time"), F.coalesce("message", F.lit("")).alias("message"))
            records.coalesce(1).write.mode("append").json(f"{self.path}/progress")
            _remove(self.spark, f"{self.path}/staging/{key}")
            for r in self.log().where(F.col("seq") == seq).orderBy("env").select("status").collect():  # a batch's records
                streak = streak + 1 if r["status"] == "failed" else 0
            if streak >= self.max_streak:
                break
        return self.assemble()

    def assemble(self) -> DataFrame:
        """All parts, by column name; the log tells which environments they are of."""
        done = latest(self.log()).where("status = 'ok'")
        if done.isEmpty():
            raise ValueError("no environment is done yet")
        parts = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/parts")
        return parts.join(done.select(F.col("key").alias("part")).distinct(), "part", "left_semi").drop("part")
