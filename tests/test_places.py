import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agrolith.models.scan import within_polygon
from agrolith.operators import shapes
from agrolith.plans import places
from agrolith.sources import raster, satellite


def ring(rng, x, y, r, n):
    a = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + r * rng.uniform(0.3, 1) * math.cos(t), y + r * rng.uniform(0.3, 1) * math.sin(t)) for t in a]


def inside(x, y, rings):
    odd = False
    for own in rings:
        for (x1, y1), (x2, y2) in zip(own, own[1:] + own[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


@pytest.mark.parametrize("size", [0.37, 1.0, 7.0])
def test_polygons_equal_brute_force(spark, size):
    rng = random.Random(2)
    polygons = {}
    for k in range(120):
        x, y, r = rng.uniform(-170, 170), rng.uniform(-80, 80), rng.choice([0.2, 1, 5, 9])
        own = [ring(rng, x, y, r, rng.randint(3, 12))]
        if k % 3 == 0:
            own.append(ring(rng, x, y, r / 4, 5))  # a hole, or a part that crosses
        if k % 5 == 0:
            own.append([(x + 11, y), (x + 13, y), (x + 13, y + 2), (x + 11, y + 2)])  # on lines of the grid
        polygons[f"P{k}"] = own
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(3000)]
    points += [(10_000 + i, x + rng.uniform(-3, 3), y + rng.uniform(-3, 3)) for i, own in enumerate(polygons.values()) for x, y in own[0][:3]]
    points += [(5000, None, 1.0), (5001, 1.0, None), (0, points[0][1], points[0][2])]
    vertices = [(p, j, i, x, y) for p, own in polygons.items() for j, r in enumerate(own) for i, (x, y) in enumerate(r)]
    table = spark.createDataFrame(vertices, "shape string, ring int, seq int, lon double, lat double")
    found = shapes.located(spark.createDataFrame(points, "id int, lon double, lat double"), table, size)
    want = sorted((i, p) for i, x, y in points if x is not None and y is not None for p, own in polygons.items() if inside(x, y, own))
    assert sorted((r["id"], r["shape"]) for r in found.collect()) == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = sum(any(inside(x, y, own) for own in polygons.values()) for _, x, y in points if x is not None and y is not None)
    assert shapes.clipped(spark.createDataFrame(points, "id int, lon double, lat double"), table, size).count() == rows


def test_one_polygon_as_before(spark):
    rng = random.Random(4)
    own = ring(rng, 0, 0, 8, 9)
    points = spark.createDataFrame([(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(500)], "id int, lon double, lat double")
    table = spark.createDataFrame([("P", 0, i, x, y) for i, (x, y) in enumerate(own)], "shape string, ring int, seq int, lon double, lat double")
    assert sorted(r["id"] for r in shapes.located(points, table, 0.5).collect()) == sorted(r["id"] for r in within_polygon(points, own).collect())
    assert shapes.located(points, table.where("seq < 2"), 0.5).count() == 0


@pytest.mark.parametrize("turned", [False, True])
def test_cells_with_many_edges(spark, turned):
    """A comb, so that one cell has dozens of edges and of ends to its east; nothing of the index goes through the driver as a broadcast."""
    rng = random.Random(6)
    own = [(-3.3, -3.1), *[(rng.uniform(1, 4) if i % 2 else rng.uniform(-3, 0), -3 + i * 0.05) for i in range(120)], (-3.3, 3.2)]
    points = [(i, rng.uniform(-4, 5), rng.uniform(-4, 4)) for i in range(2000)]
    if turned:
        own, points = [(y, x) for x, y in own], [(i, y, x) for i, x, y in points]
    table = spark.createDataFrame([("P", 0, i, x, y) for i, (x, y) in enumerate(own)], "shape string, ring int, seq int, lon double, lat double")
    found = shapes.located(spark.createDataFrame(points, "id int, lon double, lat double"), table, 1.0)
    want = sorted(i for i, x, y in points if inside(x, y, [own]))
    assert sorted(r["id"] for r in found.collect()) == want and 300 < len(want) < 1700
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_index_of_shapes_is_not_broadcast(spark, sf):
    """exploded edges and cells count as small by the size of their table, however many they are."""
    plan = places.sites_in_shapes(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_clipping_is_not_broadcast(spark, sf):
    """neither the index nor what was found inside, and a place is looked up to the first shape that holds it."""
    plan = places.sites_clipped(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == plan.count("LeftSemi") == 2 and "Broadcast" not in plan


@pytest.mark.parametrize("buffer", [10.0, 150_000.0, 900_000.0])
def test_circles_equal_brute_force(spark, buffer):
    """Near the poles and the date line too."""
    grid = raster.Grid(-180.0, 90.0, 2.5)
    cells = [("z", r, c, float((r * 7 + c * 3) % 11)) for r in range(72) for c in range(144) if (r + c) % 13]
    points = [("a", 0.3, 0.2), ("b", 179.9, 10.0), ("c", -179.95, -61.0), ("d", 33.0, 89.4), ("e", -100.0, -90.0), ("f", 12.0, 78.0), ("g", None, 1.0), ("h", 180.0, 0.0)]
    got = raster.within_metres(spark.createDataFrame(points, "env string, lon double, lat double"), spark.createDataFrame(cells, "layer string, row int, col int, value double"), grid, buffer)

    def metres(x1, y1, x2, y2):
        x1, y1, x2, y2 = map(math.radians, (x1, y1, x2, y2))
        h = math.sin((y1 - y2) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x1 - x2) / 2) ** 2
        return 2 * raster.RADIUS * math.asin(min(1.0, math.sqrt(h)))

    want = []
    for env, x, y in points:
        if x is None:
            continue
        centre = lambda r, c: (-180 + (c + 0.5) * 2.5, 90 - (r + 0.5) * 2.5)
        near = [(r, c) for r in range(72) for c in range(144) if metres(x, y, *centre(r, c)) <= buffer]
        near = near or [(int((90 - y) // 2.5), int((x + 180) // 2.5) % 144)]
        value = {(r, c): v for _, r, c, v in cells}
        want += [(env, "z", value[k]) for k in near if k in value]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def dense(x, y, at):
    """The spline by a full system for the pieces' coefficients."""
    n = len(x)
    a, b, row = np.zeros((4 * (n - 1), 4 * (n - 1))), np.zeros(4 * (n - 1)), 0
    power = lambda t, d: [math.perm(k, d) * t ** (k - d) if k >= d else 0.0 for k in range(4)]
    for i in range(n - 1):
        h = x[i + 1] - x[i]
        a[row, 4 * i : 4 * i + 4], b[row] = power(0, 0), y[i]
        a[row + 1, 4 * i : 4 * i + 4], b[row + 1] = power(h, 0), y[i + 1]
        row += 2
        if i < n - 2:
            for d in (1, 2):
                a[row, 4 * i : 4 * i + 4], a[row, 4 * i + 4 : 4 * i + 8] = power(h, d), -np.array(power(0, d))
                row += 1
    for i, four in ((0, slice(0, 4)), (n - 2, slice(n - 4, n))):
        a[row, 4 * i + 3], b[row] = 1, np.polyfit(x[four] - x[four][0], y[four], 3)[0]
        row += 1
    coefficients = np.linalg.solve(a, b).reshape(-1, 4)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    return sum(coefficients[k, j] * (at - x[k]) ** j for j in range(4))


@pytest.mark.parametrize("n", [4, 5, 9, 40])
def test_spline_equals_a_dense_solve(n):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.integers(1, 12, n)).astype(float)
    y = rng.normal(size=n)
    at = np.arange(x[0] - 5, x[-1] + 6)
    assert np.allclose(satellite.cubic(x, y, at), dense(x, y, at), atol=1e-6)
    assert np.allclose(satellite.cubic(x, x**3 - 2 * x, at), at**3 - 2 * at, rtol=1e-8, atol=1e-5)  # a cubic is its own spline


def test_spline_fills_days_within_the_gap(spark):
    rows = [("a", f"2024-01-{d:02d}", float(v)) for d, v in ((1, 3), (5, 4), (9, 1), (13, 7))] + [("a", "2024-02-20", 2.0), ("a", "2024-02-22", None), ("b", "2024-01-01", 1.0), ("b", "2024-01-05", 5.0), ("c", "2024-01-03", 9.0)]
    df = spark.createDataFrame(rows, "env string, d string, x double").select("env", F.to_date("d").alias("YYYYMMDD"), "x")
    out = satellite.to_daily(df, ["x"], "spline", 16).toPandas()
    day = pd.to_datetime(out["YYYYMMDD"]).map(lambda t: (t - pd.Timestamp("2024-01-01")).days)
    a = out[out["env"] == "a"].assign(day=day).set_index("day")["x"]
    want = dense(np.array([0.0, 4, 8, 12, 50]), np.array([3.0, 4, 1, 7, 2]), np.arange(53.0))
    assert np.allclose(a.loc[0:12], want[:13]) and a.loc[13:49].isna().all() and np.allclose(a.loc[50:52], want[50:53])
    assert out[out["env"] == "b"].sort_values("YYYYMMDD")["x"].tolist() == [1, 2, 3, 4, 5]  # too few values for a spline
    assert out[out["env"] == "c"]["x"].tolist() == [9.0]
