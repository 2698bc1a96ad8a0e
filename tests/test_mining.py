import numpy as np
import pytest

from agrolith.operators import groups, mining


def days(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"E{i % 7}", "season", float(np.round(rng.normal([5, 15, 30][i % 3], 1.0), 1)), float(np.round(rng.gamma(2, 3), 1)) if i % 11 else None) for i in range(n)]
    return spark.createDataFrame(rows, "env string, interval string, t double, r double"), rows


def lloyd(z, centres, most=100):
    """Plain numpy, all rows at once."""
    centres = centres.copy()
    for _ in range(most):
        near = ((z[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([z[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
        if np.abs(new - centres).max() <= 1e-10:
            break
        centres = new
    near = ((z[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    return centres, ((z - centres[near]) ** 2).sum()


def test_centres_equal_numpy_from_the_same_starts(spark):
    df, rows = days(spark)
    sets = {"t": ("t",), "both": ("t", "r")}
    points = mining.counted(df.repartition(5), sets)
    full = {"t": np.array([[t] for *_, t, _ in rows]), "both": np.array([[t, r] for *_, t, r in rows if r is not None])}
    moments = mining._moments(points)
    rng = np.random.default_rng(2)
    starts, scale, z = {}, {}, {}
    for name, x in full.items():
        n, middle, spread = moments[name]
        assert n == len(x) and np.allclose(middle, x.mean(axis=0)) and np.allclose(spread, x.std(axis=0, ddof=1))
        scale[name], z[name] = (middle, spread), (x - middle) / spread
        starts[name] = [z[name][rng.choice(len(x), k, replace=False)] for k in (2, 3, 5, 5)]
    found = mining.lloyd(points, starts, scale)
    for name, fits in found.items():
        for (centres, within), begin in zip(fits, starts[name]):
            want, sums = lloyd(z[name], begin)
            assert np.allclose(centres, want) and np.isclose(within, sums)


def test_the_index_and_the_number_of_types(spark):
    df, rows = days(spark)
    m = mining.mined(df, {"t": ("t",)}, range(2, 5), 10, 3)["t"]
    assert len(m.centres) == 3 and np.allclose(m.centres[:, 0], [5, 15, 30], atol=0.5)
    x = np.array([t for *_, t, _ in rows])
    near = np.abs(x[:, None] - m.centres[:, 0]).argmin(axis=1)
    within = sum(((x[near == k] - x[near == k].mean()) ** 2).sum() for k in range(3))
    between = ((x - x.mean()) ** 2).sum() - within
    assert np.isclose(m.index[3], (between / 2) / (within / (len(x) - 3)))


def test_no_group_holds_a_feature_set(spark):
    df, rows = days(spark)
    counts, text = groups.mine_types(df, ["t", "r"], "combine", k_range=range(2, 4), starts=2)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Python" not in plan
    total = {r["feature_set"]: r["n"] for r in counts.groupBy("feature_set").agg({"freq": "sum"}).withColumnRenamed("sum(freq)", "n").collect()}
    known = sum(r is not None for *_, r in rows)
    assert total == {"FC001": len(rows), "FC002": known, "FC003": known}
    assert text.where("upper IS NULL").count() >= 3


def test_odd_tables(spark):
    few = spark.createDataFrame([("E", "s", 1.0), ("E", "s", 1.0), ("E", "s", None)], "env string, interval string, t double")
    counts, _ = groups.mine_types(few, ["t"])
    assert [tuple(r) for r in counts.collect()] == [("E", "s", "t", 1, 2)]
    none = spark.createDataFrame([], "env string, interval string, t double")
    assert groups.mine_types(none, ["t"])[0].collect() == []
    with pytest.raises(ValueError, match="coordinates"):
        mining.lloyd(mining.counted(few, {"t": ("t",)}), {"t": [np.zeros((5_000_000, 1))]}, {"t": (np.zeros(1), np.ones(1))})
