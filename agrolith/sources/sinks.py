"""CSV sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame


def report_path(where: str | bool | None, name: str) -> str | None:
    """Where a report goes: nowhere (None, False), the working folder (True), a file as named, or a folder under the given name."""
    if where is None or where is False:
        return None
    if where is True:
        return name
    return where if os.path.splitext(where)[1].lower() == ".csv" else os.path.join(where, name)


def write_report(df: DataFrame, where: str | bool | None, name: str) -> str | None:
    """A small table as CSV with a header, in one part; the path, if it was written."""
    path = report_path(where, name)
    if path is not None:
        df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
    return path


def write_by_env(df: DataFrame, path: str, env: str = "env", kind: str = "csv") -> None:
    """One folder for each environment; rows of one meet in one task, so that it gets one file."""
    writer = df.repartition(env).write.mode("overwrite").partitionBy(env)
    writer.option("header", "true").csv(path) if kind == "csv" else writer.parquet(path)
