"""Types mined by k-means from sufficient statistics: no task or group holds a feature set.

Days are counted by their values first. Lloyd's steps then run for all feature sets, numbers of clusters and starts at once: each task adds up, for
every centre, the days nearest to it (how many, their sums and squares), and those sums are added by an aggregate. What reaches the driver
are centres: feature sets x starts x clusters, whatever the number of days. The index of Calinski and Harabasz comes from the same sums.

Starts are distinct values in the order of a hash, so reruns agree. A centre without days stays where it is; ties go to the first centre.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.session import checkpointed

#: Most numbers that the centres of all configurations may be.
MAX_CENTRES = 4_000_000


@dataclass
class Mined:
    """Of each feature set: its variables, the centres (in their units, in the order of types), the index by k, and the mean and spread of days."""

    variables: tuple[str, ...]
    centres: np.ndarray
    index: dict[int, float]
    middle: np.ndarray
    spread: np.ndarray


_POINTS = "feature_set string, x array<double>, n long"
_SUMS = "config int, centre int, n long, sums array<double>, within double"


def counted(days: DataFrame, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """(feature_set, x, n): distinct complete values of each feature set and how many days have them."""
    rows = days.select(F.explode(F.array(*[F.struct(F.lit(name).alias("feature_set"), F.array(*[F.col(v).cast("double") for v in own]).alias("x")) for name, own in sets.items()])).alias("r")).select("r.*")
    return rows.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v))).groupBy("feature_set", "x").agg(F.count("*").alias("n"))


def _moments(points: DataFrame) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """(days, mean, standard deviation) of each feature set, by aggregates around the mean."""
    each = points.select("feature_set", "n", F.posexplode("x").alias("at", "v"))
    mean = each.groupBy("feature_set", "at").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean"))
    spread = each.join(mean.drop("n"), ["feature_set", "at"]).groupBy("feature_set", "at").agg((F.sum(F.col("n") * F.pow(F.col("v") - F.col("mean"), F.lit(2.0))) / F.greatest(F.sum("n") - 1, F.lit(1))).alias("var"))
    out: dict[str, dict] = {}
    for r in mean.join(spread, ["feature_set", "at"]).collect():
        out.setdefault(r["feature_set"], {})[r["at"]] = r["n"], r["mean"], r["var"]
    return {s: (own[0][0], np.array([own[i][1] for i in range(len(own))]), np.sqrt([own[i][2] for i in range(len(own))])) for s, own in out.items()}


def first_points(points: DataFrame, most: int, seed: int) -> dict[str, list[list[float]]]:
    """Of each feature set up to ``most`` distinct values, in the order of a hash."""
    order = Window.partitionBy("feature_set").orderBy(F.xxhash64(F.lit(seed), "x"), "x")
    rows = points.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).orderBy("feature_set", "k").collect()
    out: dict[str, list[list[float]]] = {}
    for r in rows:
        out.setdefault(r["feature_set"], []).append(list(r["x"]))
    return out


def _assigned(z: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the squared distance."""
    d = ((z[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    near = d.argmin(axis=1)
    return near, d[np.arange(len(z)), near]


def _summing(configs: Mapping[str, list[tuple[int, np.ndarray]]], scale: Mapping[str, tuple[np.ndarray, np.ndarray]]):
    """A task that adds up its values by the centres they are nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            x, n = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            for name in set(names.tolist()):
                rows = np.flatnonzero(names == name)
                middle, spread = scale[name]
                for part in np.array_split(rows, -(-len(rows) // 4096)):
                    z, w = (np.array([x[i] for i in part]) - middle) / spread, n[part]
                    for config, centres in configs[name]:
                        near, d = _assigned(z, centres)
                        for c in np.unique(near).tolist():
                            own = near == c
                            sums = total.setdefault((config, c), [0, np.zeros(z.shape[1]), 0.0])
                            sums[0] += int(w[own].sum())
                            sums[1] += w[own] @ z[own]
                            sums[2] += float(w[own] @ d[own])
        rows = [(config, c, n, s.tolist(), d) for (config, c), (n, s, d) in total.items()]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds, strict=True)], _SUMS.replace(",", "").split()[::2])

    return run


def lloyd(points: DataFrame, starts: Mapping[str, list[np.ndarray]], scale: Mapping[str, tuple[np.ndarray, np.ndarray]], most: int = 100) -> dict[str, list[tuple[np.ndarray, float]]]:
    """(centres, sum of squares within) of each feature set's configurations, from their starting centres, all in standardised units."""
    numbered = {name: list(enumerate(own, sum(len(v) for v in list(starts.values())[:i]))) for i, (name, own) in enumerate(starts.items())}
    centres = {config: c for own in numbered.values() for config, c in own}
    if sum(c.size for c in centres.values()) > MAX_CENTRES:
        raise ValueError(f"the configurations have more than {MAX_CENTRES} coordinates of centres: fewer sets, starts or clusters")
    if not centres:
        return {}
    live, within = set(centres), {}
    for _ in range(most + 1):
        asked = {name: [(i, centres[i]) for i, _ in own if i in live] for name, own in numbered.items()}
        use = [name for name, own in asked.items() if own]
        here = points.where(F.col("feature_set").isin(use))
        parts = here.mapInArrow(_summing(asked, scale), _SUMS)
        longest = max(c.shape[1] for c in centres.values())
        sums = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(longest)]
        moved = set()
        rows = parts.groupBy("config", "centre").agg(F.sum("n").alias("n"), F.sum("within").alias("within"), *sums).collect()
        for i in live:
            within[i] = 0.0
        for r in rows:
            i, c = r["config"], r["centre"]
            new = np.array([r[f"s{j}"] for j in range(centres[i].shape[1])]) / r["n"]
            within[i] += r["within"]
            if np.abs(new - centres[i][c]).max() > 1e-10:
                moved.add(i)
                centres[i] = centres[i].copy()
                centres[i][c] = new
        live = moved
        if not live:
            break
    return {name: [(centres[i], within[i]) for i, _ in own] for name, own in numbered.items()}


def mined(days: DataFrame, sets: Mapping[str, Sequence[str]], k_range: Sequence[int], starts: int, seed: int, most: int = 100) -> dict[str, Mined]:
    """The types of each feature set, k by the greatest index; those of one variable by their centres, others along the centres' first component."""
    points = checkpointed(counted(days, sets))
    moments = _moments(points)
    scale = {name: (middle, np.where(spread > 0, spread, 1.0)) for name, (_, middle, spread) in moments.items()}
    ks = sorted(set(k_range))
    found = first_points(points, starts * max(ks), seed)
    begin, of = {}, {}
    for name, values in found.items():
        z = (np.array(values) - scale[name][0]) / scale[name][1]
        own = [(k, s) for k in ks if k < len(z) for s in range(starts)]
        begin[name] = [z[(s * max(ks) + np.arange(k)) % len(z)] for k, s in own] or [np.zeros((1, z.shape[1]))]
        of[name] = own or [(1, 0)]
    out = {}
    for name, fits in lloyd(points, begin, scale, most).items():
        n, middle, spread = moments[name]
        total = (n - 1) * sum(s > 0 for s in spread)
        best: dict[int, tuple[float, np.ndarray]] = {}
        for (k, _), (centres, within) in zip(of[name], fits, strict=True):
            if k not in best or within < best[k][0] - 1e-12:
                best[k] = within, centres
        index = {k: (total - w) / max(k - 1, 1) / max(w, 1e-12) * (n - k) for k, (w, _) in best.items()}
        centres = best[max(index, key=lambda k: (index[k], -k))][1]
        along = centres[:, 0]
        if centres.shape[1] > 1 and len(centres) > 1:
            axis = np.linalg.svd(centres - centres.mean(axis=0))[2][0]
            along = centres @ (axis * (np.sign(axis[np.abs(axis).argmax()]) or 1.0))
        centres = centres[np.argsort(along, kind="stable")]
        out[name] = Mined(tuple(sets[name]), centres * scale[name][1] + middle, index, middle, scale[name][1])
    return out


def typed(days: DataFrame, found: Mapping[str, Mined]) -> DataFrame:
    """The days of every feature set with its ``type``, the nearest centre's number from 1; incomplete days are left out."""
    if not found:
        return days.withColumns({"feature_set": F.lit(None).cast("string"), "type": F.lit(None).cast("int")}).where(F.lit(False))
    cases = []
    for name, m in found.items():
        x = F.array(*[F.col(v).cast("double") for v in m.variables])
        bad = F.exists(x, lambda v: v.isNull() | F.isnan(v))
        z = F.zip_with(x, F.lit([float(v) for v in m.spread]), lambda v, s: v / s)
        far = F.transform(F.lit([[float(v) for v in c / m.spread] for c in m.centres]), lambda c: F.aggregate(F.zip_with(z, c, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda t, d: t + d))
        kind = F.array_position(far, F.array_min(far)).cast("int")
        cases.append(F.struct(F.lit(name).alias("feature_set"), F.when(~bad, kind).alias("type")))
    return days.withColumn("_set", F.explode(F.array(*cases))).select(*days.columns, "_set.feature_set", "_set.type").where("type IS NOT NULL")
