import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolith.operators import copula, covariables, kernels, pca, tiles


def cells(seed, n=23, p=17, lost=0.15):
    rng = random.Random(seed)
    return [(f"E{i}", f"c{j}", None if rng.random() < 0.05 else round(rng.gauss(0, 1), 1)) for i in range(n) for j in range(p) if rng.random() >= lost]


def table(spark, rows):
    return spark.createDataFrame(rows, "env string, covariable string, value double").repartition(4)


@pytest.mark.parametrize("width, depth", [(256, 512), (5, 4), (3, 100), (100, 2)])
def test_moments_equal_a_join(spark, width, depth):
    rows = cells(1) + [("alone", "only", 2.0), ("E1", "only", None), ("apart", "other", 1.0)]
    got = {(r["i"], r["j"]): r for r in tiles.moments(table(spark, rows), width=width, depth=depth).collect()}
    by = {}
    for e, c, v in rows:
        by.setdefault(e, {})[c] = v
    want = 0
    for i, a in by.items():
        for j, b in by.items():
            shared = [c for c in a if c in b]
            both = [(a[c], b[c]) for c in shared if a[c] is not None and b[c] is not None]
            if not shared:
                assert (i, j) not in got
                continue
            want += 1
            r = got[i, j]
            assert (r["shared"], r["n"]) == (len(shared), len(both))
            assert np.allclose([r["x"], r["y"], r["xx"], r["yy"], r["xy"]], [sum(u for u, _ in both), sum(v for _, v in both), sum(u * u for u, _ in both), sum(v * v for _, v in both), sum(u * v for u, v in both)])
            assert np.isclose(r["own_i"], sum(v * v for v in a.values() if v is not None))
    assert len(got) == want


@pytest.mark.parametrize("width, depth", [(1024, 256), (4, 5), (7, 1)])
@pytest.mark.parametrize("below", [True, False])
def test_dominance_equals_brute_force(spark, width, depth, below):
    rows = [(k, e, c, v) for k, seed in (("A", 2), ("B", 3)) for e, c, v in cells(seed, 21, 3)]
    w = spark.createDataFrame(rows, "block string, env string, covariable string, value double").where("value IS NOT NULL")
    got = {(r["key"], r["row"]): (r["on_side"], r["met"]) for r in tiles.dominance(w, "block", below, width=width, depth=depth).collect()}
    by = {}
    for k, e, c, v in rows:
        if v is not None:
            by.setdefault((k, e), {})[c] = v
    for (k, e), a in by.items():
        on = met = 0
        for (k2, _), b in by.items():
            shared = [c for c in a if c in b] if k == k2 else []
            met += bool(shared)
            on += bool(shared) and all((b[c] <= a[c]) if below else (b[c] >= a[c]) for c in shared)
        assert got.pop((k, e)) == (on, met)
    assert not got


def test_no_join_of_pairs(spark):
    w = table(spark, cells(4))
    for df in (kernels.linear_kernel(w), kernels.arc_cosine_kernel(w, 2), covariables.correlations(w), copula.env_copula(w.where("value IS NOT NULL"), "joint")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "MapInArrow" in plan


def test_correlations_equal_numpy(spark):
    rows = cells(5, 30, 12, 0.0) + [(f"E{i}", "flat", 0.1) for i in range(30)]
    got = {(r["i"], r["j"]): r["r"] for r in covariables.correlations(table(spark, rows)).collect()}
    by = {}
    for e, c, v in rows:
        by.setdefault(c, {})[e] = v
    for i in by:
        for j in by:
            if i < j:
                both = [(by[i][e], by[j][e]) for e in by[i] if e in by[j] and by[i][e] is not None and by[j][e] is not None]
                x, y = map(np.array, zip(*both))
                if x.std() == 0 or y.std() == 0 or "flat" in (i, j):
                    assert (i, j) not in got
                else:
                    assert np.isclose(got[i, j], np.corrcoef(x, y)[0, 1])


def test_nothing(spark):
    w = spark.createDataFrame([], "env string, covariable string, value double")
    assert tiles.moments(w).collect() == [] and tiles.dominance(w.withColumn("k", F.lit("a")), "k", True).collect() == []


@pytest.mark.parametrize("n, p", [(10, 64), (40, 7)])
@pytest.mark.parametrize("how", [{}, {"scale": False}, {"center": False}, {"rank": 3}])
def test_components_equal_the_svd(spark, n, p, how):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, p)) * rng.uniform(0.5, 3, p) + rng.normal(size=p)
    rows = [(f"E{i:02d}", f"c{j:02d}", float(m[i, j])) for i in range(n) for j in range(p)] + [(f"E{i:02d}", "flat", 2.0) for i in range(n)]
    got = pca.env_pca(table(spark, rows), **how)
    x = m - m.mean(axis=0) if how.get("center", True) else m
    x = x / m.std(axis=0, ddof=1) if how.get("scale", True) else x
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    sign = np.sign(vt[np.arange(len(s)), np.abs(vt).argmax(axis=1)])
    k = how.get("rank", len(s))
    variance = got.variance.orderBy("pc_order").toPandas()
    assert len(variance) == k and np.allclose(variance["sd"], s[:k] / np.sqrt(n - 1), atol=1e-6) and np.allclose(variance["prop"], (s**2 / (s**2).sum())[:k])
    own = int((s[:k] > 1e-6).sum())
    names = [f"PC{i + 1}" for i in range(own)]
    scores = got.scores.groupBy("env").pivot("PC", names).agg(F.first("value")).orderBy("env").toPandas()[names].to_numpy()
    loadings = got.loadings.where("covariable <> 'flat'").groupBy("covariable").pivot("PC", names).agg(F.first("value")).orderBy("covariable").toPandas()[names].to_numpy()
    assert np.allclose(scores, (u * s * sign)[:, :own], atol=1e-6) and np.allclose(loadings, (vt.T * sign)[:, :own], atol=1e-6)
    assert got.loadings.where("covariable = 'flat'").count() == 0


def test_components_need_complete_columns(spark):
    rows = [(f"E{i}", f"c{j}", float(i * j % 5)) for i in range(6) for j in range(1, 4)]
    for bad in (rows[:-1], [*rows[:-1], (*rows[-1][:2], None)], [(e, c, 1.0) for e, c, _ in rows]):
        with pytest.raises(ValueError, match="complete"):
            pca.env_pca(table(spark, bad))
