import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from agrolith.streaming import timers
from agrolith.streaming.days import day_stream, drained

SCHEMA = "env string, date date, T2M_MAX double, T2M_MIN double"
FIRST = date(2024, 3, 1)


def number(d):
    return (d - date(1970, 1, 1)).days


def days_of(env, n, seed):
    rng = random.Random(seed)
    return [(env, FIRST + timedelta(i), rng.uniform(15, 35), rng.uniform(0, 15) if rng.random() < 0.95 else None) for i in range(n)]


def gdd(tmax, tmin, base=8, upper=30):
    if tmax is None or tmin is None:
        return 0.0
    return max((max(min(tmax, upper), base) + max(min(tmin, upper), base)) / 2 - base, 0.0)


def batch(rows):
    out, total = {}, {}
    for env, d, tmax, tmin in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        total[env] = total.get(env, 0.0) + gdd(tmax, tmin)
        out[env, number(d)] = (round(gdd(tmax, tmin), 9), round(total[env], 9))
    return out


def feed(spark, path, files):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, **how):
    with timers.timed_state(spark):
        stream = timers.thermal_time(day_stream(spark, f"{path}/in", SCHEMA, 1), 8.0, 30.0, **how)
        return drained(stream, f"{path}/run")


def test_any_order_within_the_watermark(spark, tmp_path):
    rows = days_of("A", 30, 1) + days_of(None, 28, 2)
    rng = random.Random(3)
    shuffled = sorted(rows, key=lambda r: number(r[1]) + rng.uniform(0, 4))  # a day is up to four days late
    feed(spark, f"{tmp_path}/in", [shuffled[i : i + 9] for i in range(0, len(shuffled), 9)])
    out = run(spark, tmp_path, late="6 days").collect()
    want = batch(rows)
    got = {(r["env"], r["day"]): (round(r["dTT"], 9), round(r["cumTT"], 9)) for r in out}
    assert len(got) == len(out) and all(r["final"] for r in out)
    assert got == {k: want[k] for k in got}
    last = number(FIRST) + 29 - 6
    assert {k for k in want if k[1] < last} <= set(got) and all(k[1] <= last for k in got)


def test_a_stream_goes_on_and_drops_what_is_too_late(spark, tmp_path):
    rows = days_of("A", 20, 4)
    feed(spark, f"{tmp_path}/in", [rows[:2] + rows[3:10]])
    run(spark, tmp_path, late="1 day")
    feed(spark, f"{tmp_path}/in", [[rows[2]] + rows[10:20]])  # the third day is long past the watermark
    out = {r["day"]: r["cumTT"] for r in run(spark, tmp_path, late="1 day").collect()}
    want = batch(rows[:2] + rows[3:])
    assert number(rows[2][1]) not in out and len(out) >= 16
    assert all(abs(out[d] - want["A", d][1]) < 1e-6 for d in out)


def test_a_late_day_is_replayed_with_all_after_it(spark, tmp_path):
    rows = days_of("A", 8, 5)
    feed(spark, f"{tmp_path}/in", [rows[:3] + rows[4:6], [rows[3]]])
    with timers.timed_state(spark):
        stream = timers.thermal_time(day_stream(spark, f"{tmp_path}/in", SCHEMA, 1), 8.0, 30.0, late="10 days", provisional=True)
        seen = []
        query = stream.writeStream.foreachBatch(lambda df, i: seen.append((i, sorted(map(tuple, df.select("day", "cumTT", "final").collect())))) and None).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    own = [rows_ for _, rows_ in sorted(seen) if rows_]
    first = number(FIRST)
    assert [r[0] - first for r in own[0]] == [0, 1, 2, 4, 5] and [r[0] - first for r in own[1]] == [3, 4, 5]
    want = batch(rows[:6])
    assert all(abs(r[1] - want["A", r[0]][1]) < 1e-6 and not r[2] for r in own[1])


def test_state_goes_when_nothing_comes(spark, tmp_path):
    a = days_of("A", 5, 6)
    later = [("A", d + timedelta(100), x, y) for _, d, x, y in days_of("A", 9, 7)]
    clock = [("B", FIRST + timedelta(60), 20.0, 10.0)], [("B", FIRST + timedelta(130), 20.0, 10.0)]
    feed(spark, f"{tmp_path}/in", [a, clock[0], later, clock[1]])
    out = {(r["env"], r["day"]): r["cumTT"] for r in run(spark, tmp_path, late="3 days", idle=30).collect()}
    assert all(abs(out[k] - v[1]) < 1e-6 for k, v in batch(a).items()) and all(abs(out[k] - v[1]) < 1e-6 for k, v in batch(later).items())


@pytest.mark.parametrize("taw", [0.0, 50.0])
def test_soil_water_equals_the_recurrence(spark, tmp_path, taw):
    rng = random.Random(8)
    rows = [("A", FIRST + timedelta(i), rng.choice([0.0, 0.0, 20.0]), 0.0, rng.uniform(2, 9), taw, taw * 0.55) for i in range(40)]
    schema = "env string, date date, rain double, irrigation double, etc double, taw double, raw double"
    spark.createDataFrame(rows, schema).repartition(4, "date").write.parquet(f"{tmp_path}/in")
    with timers.timed_state(spark):
        out = drained(timers.soil_water(day_stream(spark, f"{tmp_path}/in", schema, 4), late="1 day"), f"{tmp_path}/run").orderBy("day").collect()
    depletion = 0.0
    for r, x in zip(out, rows):
        ks = 0.0 if taw <= 0 else 1.0 if depletion <= x[6] else max((x[5] - depletion) / (x[5] - x[6]), 0.0)
        depletion = min(max(depletion - x[2] + ks * x[4], 0.0), taw)
        assert r["day"] == number(x[1]) and abs(r["ks"] - ks) < 1e-9 and abs(r["depletion"] - depletion) < 1e-9
    assert len(out) >= 38 and spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
