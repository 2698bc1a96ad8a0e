"""Exact quantiles of long columns, without a task that holds them all."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.session import checkpointed


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], ranges: int | None = None) -> dict[str, list[float]]:
    """Quantiles with linear interpolation of each column, nulls left out; an empty list where a column has no value.

    The columns are evaluated once. Up to a million values one aggregate holds them; beyond, three passes: approximate cuts
    and counts, counts between cuts, and the values between the two cuts where a wanted rank lies. Equal values are counted before they
    are ordered, so an ordered range holds few rows, whatever is common.
    """
    long = df.select([F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    long = long.unpivot([], long.columns, "variable", "value").where("value IS NOT NULL") if len(columns) > 1 else long.select(F.lit("c0").alias("variable"), F.col("c0").alias("value")).where("value IS NOT NULL")
    long = checkpointed(long)
    counts = {r["variable"]: r["n"] for r in long.groupBy("variable").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {c: [] for c in columns}
    if ranges is None and max(counts.values()) <= 1_000_000:
        at = {r["variable"]: list(r["q"]) for r in long.groupBy("variable").agg(F.percentile("value", F.array(*[F.lit(float(p)) for p in probs])).alias("q")).collect()}
        return {c: at.get(f"c{i}", []) for i, c in enumerate(columns)}
    ranges = ranges or min(2000, max(16, max(counts.values()) // 1_000_000))
    share = [i / ranges for i in range(1, ranges)]
    cuts = {r["variable"]: sorted(set(r["cuts"])) for r in long.groupBy("variable").agg(F.percentile_approx("value", share, 20 * ranges).alias("cuts")).collect()}
    bucket = F.lit(None).cast("int")
    for v, own in cuts.items():
        bucket = F.when(F.col("variable") == v, F.size(F.filter(F.array(*[F.lit(c) for c in own]), lambda c: c < F.col("value")))).otherwise(bucket)
    dealt = long.withColumn("bucket", bucket)
    sizes = {(r["variable"], r["bucket"]): r["n"] for r in dealt.groupBy("variable", "bucket").agg(F.count("*").alias("n")).collect()}
    wanted: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for v, n in counts.items():
        before = 0
        ranks = sorted({r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))})
        for b in range(len(cuts[v]) + 1):
            size = sizes.get((v, b), 0)
            own = [(r, r - before) for r in ranks if before <= r < before + size]
            if own:
                wanted[v, b] = own
            before += size
    picked = F.lit(False)
    for v, b in wanted:
        picked = picked | ((F.col("variable") == v) & (F.col("bucket") == b))
    order = Window.partitionBy("variable", "bucket").orderBy("value")
    values = dealt.where(picked).groupBy("variable", "bucket", "value").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(order))
    ends = F.lit(False)
    for (v, b), own in wanted.items():
        for _, at in own:
            ends = ends | ((F.col("variable") == v) & (F.col("bucket") == b) & (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at))
    found: dict[tuple[str, int], float] = {}
    for r in values.where(ends).collect():
        for rank, at in wanted[r["variable"], r["bucket"]]:
            if r["upto"] - r["n"] <= at < r["upto"]:
                found[r["variable"], rank] = r["value"]
    out = {}
    for i, c in enumerate(columns):
        v, n = f"c{i}", counts.get(f"c{i}", 0)
        at = [(n - 1) * p for p in probs]
        out[c] = [found[v, math.floor(h)] + (h - math.floor(h)) * (found[v, math.ceil(h)] - found[v, math.floor(h)]) for h in at] if n else []
    return out
