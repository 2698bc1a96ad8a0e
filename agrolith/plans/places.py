"""Polygons and circles: polygons around parts, sites of customers and suppliers, cells of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.operators import shapes, zones
from agrolith.plans.base import ENV_DAYS, env_days, rounded, table
from agrolith.sources import raster, satellite

QUERIES, SQL = {}, {}

#: Corners of a part's polygon and of the hole in it, as shares of its half width and height.
_OUTER = ((-1.0, -0.5), (0.25, -1.0), (1.0, 0.0), (0.5, 0.75), (0.75, 1.0), (-0.75, 0.5))
_HOLE = ((-0.25, -0.25), (0.25, -0.125), (0.0, 0.25))


def _polygons(spark, sf_dir):
    p = F.col("p_partkey")
    x, y, r = p * 37 % 3400 / 10.0 - 170, p * 53 % 1500 / 10.0 - 75, 1 + p % 7 * 0.5
    corners = [(j, i, cx, cy) for j, own in enumerate((_OUTER, _HOLE)) for i, (cx, cy) in enumerate(own)]
    vertices = F.array(*[F.struct(F.lit(j).alias("ring"), F.lit(i).alias("seq"), F.lit(cx).alias("cx"), F.lit(cy).alias("cy")) for j, i, cx, cy in corners])
    rows = table(spark, sf_dir, "part").select(p.alias("shape"), x.alias("x"), y.alias("y"), r.alias("r"), F.explode(vertices).alias("v"))
    return rows.select("shape", "v.ring", "v.seq", (F.col("x") + F.col("r") * F.col("v.cx")).alias("lon"), (F.col("y") + F.col("r") * F.col("v.cy")).alias("lat"))


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("env"), (k * 101 % 3407 / 10.0 - 170).alias("lon"), (k * 67 % 1511 / 10.0 - 75).alias("lat"))


_SHAPES = f"""pt AS (SELECT c_custkey AS env, c_custkey * 101 % 3407 / 10.0::DOUBLE - 170 AS lon, c_custkey * 67 % 1511 / 10.0::DOUBLE - 75 AS lat FROM customer),
ve AS (SELECT p_partkey AS shape, ring, seq, p_partkey * 37 % 3400 / 10.0::DOUBLE - 170 + (1 + p_partkey % 7 * 0.5::DOUBLE) * cx AS x1, p_partkey * 53 % 1500 / 10.0::DOUBLE - 75 + (1 + p_partkey % 7 * 0.5::DOUBLE) * cy AS y1
  FROM part, (VALUES {", ".join(f"({j}, {i}, {cx}::DOUBLE, {cy}::DOUBLE)" for j, own in enumerate((_OUTER, _HOLE)) for i, (cx, cy) in enumerate(own))}) AS c(ring, seq, cx, cy)),
ed AS (SELECT *, coalesce(lead(x1) OVER w, first_value(x1) OVER w) AS x2, coalesce(lead(y1) OVER w, first_value(y1) OVER w) AS y2 FROM ve WINDOW w AS (PARTITION BY shape, ring ORDER BY seq)),
hit AS (SELECT env, shape FROM pt JOIN ed ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY env, shape HAVING count(*) % 2 = 1)"""


def sites_in_shapes(spark, sf_dir):
    return shapes.located(_points(spark, sf_dir), _polygons(spark, sf_dir), 1.0).select("env", "shape")


SQL["sites_in_shapes"] = f"WITH {_SHAPES} SELECT env, shape FROM hit"


def sites_clipped(spark, sf_dir):
    return rounded(shapes.clipped(_points(spark, sf_dir), _polygons(spark, sf_dir), 2.0))


SQL["sites_clipped"] = f"WITH {_SHAPES} SELECT env, round(lon, 4) AS lon, round(lat, 4) AS lat FROM pt WHERE env IN (SELECT env FROM hit)"

_GRID = raster.Grid(-180.0, 90.0, 5.0)


def zone_within_metres(spark, sf_dir):
    """The most frequent zone within 600 km of each supplier, near the date line and the poles too."""
    k, o = F.col("s_suppkey"), F.col("o_orderkey")
    points = table(spark, sf_dir, "supplier").select(k.alias("env"), (k * 29 % 361 - 180 + 0.125).alias("lon"), (k * 17 % 179 - 89 + 0.25).alias("lat"))
    cells = table(spark, sf_dir, "orders").select(F.lit("zone").alias("layer"), F.floor(o / 72 % 36).cast("int").alias("row"), (o % 72).cast("int").alias("col"), (F.col("o_custkey") % 5 + 1).cast("int").alias("value"))
    return rounded(zones.majority(raster.within_metres(points, cells, _GRID, 600_000.0).select("env", F.col("value").alias("code"))), 6)


SQL["zone_within_metres"] = """WITH pt AS (SELECT s_suppkey AS env, s_suppkey * 29 % 361 - 180 + 0.125::DOUBLE AS lon, s_suppkey * 17 % 179 - 89 + 0.25::DOUBLE AS lat FROM supplier),
ce AS (SELECT CAST(o_orderkey // 72 % 36 AS INTEGER) AS r, CAST(o_orderkey % 72 AS INTEGER) AS c, CAST(o_custkey % 5 + 1 AS INTEGER) AS code FROM orders),
gr AS (SELECT r, c, -180 + (c + 0.5::DOUBLE) * 5 AS x, 90 - (r + 0.5::DOUBLE) * 5 AS y FROM (SELECT unnest(range(36)) AS r), (SELECT unnest(range(72)) AS c)),
ne AS (SELECT env, r, c FROM pt, gr WHERE 2 * 6371008.8 * asin(least(sqrt(pow(sin(radians(lat - y) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(lon - x) / 2), 2)), 1)) <= 600000),
al AS (SELECT env, r, c FROM ne UNION ALL SELECT env, CAST(floor((90 - lat) / 5) AS INTEGER), CAST(floor((lon + 180) / 5) AS INTEGER) % 72 FROM pt WHERE env NOT IN (SELECT env FROM ne)),
n AS (SELECT env, code, count(*) AS n FROM al JOIN ce USING (r, c) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY env ORDER BY n DESC, CAST(code AS VARCHAR)) AS k, n / sum(n) OVER (PARTITION BY env) AS share FROM n)
SELECT env, code, round(share, 6) AS share FROM k WHERE k = 1"""


def gap_spline(spark, sf_dir):
    """A composite for every three days but some, dated by the first: gaps of more than eight days stay empty."""
    at = F.floor(F.datediff("date", F.lit("2024-01-01").cast("date")) / 3)
    days = env_days(spark, sf_dir).groupBy("env", at.alias("at")).agg(F.min("date").alias("YYYYMMDD"), F.avg("T2M").alias("ndvi"))
    days = days.where((F.col("at") + F.substring("env", 2, 2).cast("int")) % 4 != 2).drop("at")
    gone = F.when(F.pmod(F.datediff("YYYYMMDD", F.lit("2024-01-01").cast("date")), F.lit(30)).between(12, 17), None).otherwise(F.col("ndvi"))
    return rounded(satellite.to_daily(days.withColumn("ndvi", gone), ["ndvi"], "spline", 8))


SQL["gap_spline"] = f"""WITH RECURSIVE {ENV_DAYS}, sp AS (SELECT env, date_diff('day', DATE '2024-01-01', date) // 3 AS k, min(date) AS date, avg(T2M) AS y FROM d GROUP BY 1, 2),
kp AS (SELECT env, date, date_diff('day', DATE '2024-01-01', date) AS x, CASE WHEN date_diff('day', DATE '2024-01-01', date) % 30 BETWEEN 12 AND 17 THEN NULL ELSE y END AS y FROM sp WHERE (k + CAST(substr(env, 2, 2) AS INTEGER)) % 4 <> 2),
sn AS (SELECT env, min(x) AS a, max(x) AS b FROM kp GROUP BY 1), dy AS (SELECT env, unnest(range(a, b + 1)) AS x FROM sn),
ls AS (SELECT env, count(*) AS n, list(x ORDER BY x)::DOUBLE[] AS xs, list(y ORDER BY x) AS ys FROM kp WHERE y IS NOT NULL GROUP BY 1),
hs AS (SELECT *, list_transform(range(1, n), lambda i: xs[i + 1] - xs[i]) AS h, list_transform(range(1, n), lambda i: (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i])) AS sl FROM ls WHERE n > 3),
th AS (SELECT *, ((sl[3] - sl[2]) / (xs[4] - xs[2]) - (sl[2] - sl[1]) / (xs[3] - xs[1])) / (xs[4] - xs[1]) AS t0, ((sl[n - 1] - sl[n - 2]) / (xs[n] - xs[n - 2]) - (sl[n - 2] - sl[n - 3]) / (xs[n - 1] - xs[n - 3])) / (xs[n] - xs[n - 3]) AS t1 FROM hs),
fw AS (SELECT env, CAST(1 AS BIGINT) AS i, -h[1] AS m, h[1] * h[1] * t0 AS r FROM th UNION ALL
  SELECT f.env, f.i + 1, (CASE WHEN f.i + 1 = n THEN -h[n - 1] ELSE 2 * (h[f.i] + h[f.i + 1]) END) - h[f.i] / f.m * h[f.i], (CASE WHEN f.i + 1 = n THEN -h[n - 1] * h[n - 1] * t1 ELSE sl[f.i + 1] - sl[f.i] END) - h[f.i] / f.m * f.r FROM fw f JOIN th USING (env) WHERE f.i < n),
bw AS (SELECT fw.env, fw.i, fw.r / fw.m AS s FROM fw JOIN th ON th.env = fw.env AND fw.i = n UNION ALL SELECT b.env, b.i - 1, (fw.r - h[b.i - 1] * b.s) / fw.m FROM bw b JOIN th ON th.env = b.env JOIN fw ON fw.env = b.env AND fw.i = b.i - 1),
ss AS (SELECT env, list(s ORDER BY i) AS s FROM bw GROUP BY 1),
ev AS (SELECT dy.env, dy.x, xs, ys, n, h, s, greatest(1, least(n - 1, len(list_filter(xs, lambda v: v <= dy.x)))) AS k, len(list_filter(xs, lambda v: v <= dy.x)) AS lo, list_contains(xs, dy.x::DOUBLE) AS exact FROM dy JOIN th ON th.env = dy.env JOIN ss ON ss.env = dy.env),
va AS (SELECT *, (x - xs[k]) / h[k] AS w, CASE WHEN exact THEN 0 WHEN lo BETWEEN 1 AND n - 1 THEN xs[lo + 1] - xs[lo] END AS gap FROM ev)
SELECT env, DATE '2024-01-01' + CAST(x AS INTEGER) AS YYYYMMDD, round(CASE WHEN coalesce(gap <= 8, true) THEN w * ys[k + 1] + (1 - w) * ys[k] + h[k] * h[k] * ((w * w * w - w) * s[k + 1] + ((1 - w) * (1 - w) * (1 - w) - (1 - w)) * s[k]) END, 4) AS ndvi, coalesce(gap > 8, true) AS ndvi_gap FROM va"""

QUERIES |= {f.__name__: f for f in (sites_in_shapes, sites_clipped, zone_within_metres, gap_spline)}
