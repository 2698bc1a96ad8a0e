import random

import pytest
from pyspark.sql import functions as F

from agrolith.streaming.days import day_stream
from agrolith.streaming.ingest import Ingested

SCHEMA = "env string, day date, value double, sent long"


def table_at(spark, path):
    return Ingested(spark, str(path), SCHEMA, ("env", "day"), "sent", "concat(date_format(day, 'yyyyMM'), '-', pmod(hash(env), 2))")


def some(spark, seed, n=60):
    rng = random.Random(seed)
    rows = [(rng.choice(["E1", "E2", None]), f"2024-0{rng.randint(1, 3)}-{rng.randint(10, 14)}", rng.random(), rng.randint(0, 9) if rng.random() < 0.9 else None) for _ in range(n)]
    return spark.createDataFrame(rows, "env string, day string, value double, sent long").withColumn("day", F.to_date("day"))


def expected(*batches):
    best = {}
    for rows in batches:
        for r in rows.collect():
            k = (r["env"] or "", r["day"])
            best[k] = max(best.get(k, ((False, -1), -1.0)), ((r["sent"] is not None, r["sent"] if r["sent"] is not None else -1), r["value"]))
    return sorted((k[0], k[1], v[1]) for k, v in best.items())


def got(t):
    return sorted((r["env"] or "", r["day"], r["value"]) for r in t.table().collect())


def test_any_order_replays_and_corrections(spark, tmp_path):
    a, b, c = (some(spark, s) for s in (1, 2, 3))
    t = table_at(spark, tmp_path / "one")
    assert got(t) == []
    assert t.upsert(a, 0) and t.upsert(b, 1)
    assert got(t) == expected(a, b)
    assert not t.upsert(b, 1) and not t.upsert(c, 1)  # a replay changes nothing, whatever it brings
    assert got(t) == expected(a, b)
    assert t.upsert(c, 2)
    other = table_at(spark, tmp_path / "two")
    for i, rows in enumerate((c, a, b, a)):
        other.upsert(rows, i)
    assert got(t) == got(other) == expected(a, b, c)


def test_only_touched_partitions_are_written(spark, tmp_path):
    t = table_at(spark, tmp_path)
    t.upsert(some(spark, 1), 0)
    before = t.versions()
    one = spark.createDataFrame([("E1", 9.0, 99)], "env string, value double, sent long").withColumn("day", F.to_date(F.lit("2024-02-12")))
    t.upsert(one, 1)
    changed = {p for p, v in t.versions().items() if before.get(p) != v}
    assert len(changed) == 1 and next(iter(changed)).startswith("202402") and len(before) >= 5
    assert t.table().where("env = 'E1' AND day = DATE '2024-02-12'").first()["value"] == 9.0
    rows = got(t)
    assert t.vacuum() == 1 and got(t) == rows


@pytest.mark.parametrize("when", ["before data", "before ledger"])
def test_a_crash_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch, when):
    a, b = some(spark, 4), some(spark, 5)
    t = table_at(spark, tmp_path)
    t.upsert(a, 0)

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(Ingested, "_commit" if when == "before ledger" else "_latest", crash)
    with pytest.raises(OSError):
        t.upsert(b, 1)
    monkeypatch.undo()
    assert got(t) == expected(a) and 1 not in t.committed()
    assert t.upsert(b, 1) and got(t) == expected(a, b)


def test_a_stream_that_fails_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    batches = [some(spark, s) for s in range(4)]
    for i, rows in enumerate(batches[:3]):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    t = table_at(spark, tmp_path / "table")
    stream = lambda: day_stream(spark, f"{tmp_path}/in", SCHEMA, 1)
    real, calls = Ingested._commit, []

    def once(self, batch, partitions):
        calls.append(batch)
        if len(calls) == 2:
            raise OSError("lost")
        real(self, batch, partitions)

    monkeypatch.setattr(Ingested, "_commit", once)
    with pytest.raises(Exception, match="lost"):
        t.run(stream())
    assert list(t.committed()) == [0]
    t.run(stream())
    assert sorted(t.committed()) == [0, 1, 2] and got(t) == expected(*batches[:3])
    batches[3].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    t.run(stream())
    assert got(t) == expected(*batches)
