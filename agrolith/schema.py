"""Column checks and the treatment of vendor fill values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.constants import FILL_FLOOR, FILL_VALUES


def require(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise, before any job runs, naming all columns that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def numeric_columns(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def without_fill(x: Column) -> Column:
    """The value, or null where it is a vendor's code for a missing one."""
    return F.when(x.isin(*FILL_VALUES) | (x <= FILL_FLOOR), None).otherwise(x)


def strip_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require(df, columns)
    return df.withColumns({c: without_fill(F.col(c).cast("double")) for c in columns})


def empty_columns(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable): the columns that hold no value at all, in each group."""
    counted = df.groupBy(*by).agg(*[F.count(c).alias(c) for c in columns])
    return counted.unpivot(list(by), list(columns), "variable", "n").where("n = 0").drop("n")


def union_filled(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name, null where a frame lacks a column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def long_to_wide(df: DataFrame, ids: Sequence[str], key: str, value: str, order: str, keys: Sequence[str] | None = None, fill=None) -> DataFrame:
    """A column for each key, sorted; of several rows with equal ids and key the last by ``order`` counts.

    Without ``keys`` the distinct keys are found first, by a job of their own.
    """
    require(df, [*ids, key, value, order])
    names = sorted(keys if keys is not None else [r[0] for r in df.select(key).distinct().collect()])
    wide = df.groupBy(*ids).pivot(key, names).agg(F.max_by(value, order))
    return wide if fill is None else wide.fillna(fill, subset=names)
