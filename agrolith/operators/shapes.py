"""Polygons as a table, found by an index of grid cells.

Polygons are rows (shape, ring, seq, lon, lat): the vertices of rings in order, closed by themselves; a ring inside another is a hole, and rings
apart are parts of one shape (even-odd rule). The index has the cells that an edge touches and the cells wholly inside. A point meets shapes by one equi-join on
its cell: in an inner cell it is inside, in a border cell the edges that the cell carries decide. So the work is that of
points times shapes near them, and nothing pairs all points with all shapes. A cell carries the edges that touch it; of those to the east only the
latitudes of their ends, without the ends where one goes on as the next.

The joins ask for a merge: Spark takes exploded rows to be as few as those before, and would send the whole index through the driver as a broadcast.

Defined results: points or vertices without coordinates are left out; a point on an edge is inside on one side only, as with ``models.scan.within_polygon``;
repeated points keep a row each; rings of one or two vertices hold nothing; shapes don't go on across 180 degrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(polygons: DataFrame) -> DataFrame:
    """(shape, x1, y1, x2, y2) of each side, the last vertex of a ring to its first."""
    known = polygons.where("lon IS NOT NULL AND lat IS NOT NULL").select("shape", "ring", "seq", F.col("lon").cast("double").alias("x1"), F.col("lat").cast("double").alias("y1"))
    w = Window.partitionBy("shape", "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(c.replace("1", "2"))
    return known.select("shape", "x1", "y1", after("x1"), after("y1"))


#: Of a cell's size: a border cell too many does no harm, and an edge this near is tested by itself.
_SLACK = 1e-9
_ENDS = ("x1", "y1", "x2", "y2")


def _floor(x: Column) -> Column:
    return F.floor(x).cast("int")


def _at(e, y: Column) -> Column:
    """Where an edge that isn't flat is at a latitude."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]


def strips(sides: DataFrame, size: float) -> DataFrame:
    """(shape, row, sides): the edges by the rows of cells they touch, each with the columns it touches there, first to last."""
    e = {c: F.col(c) for c in _ENDS}
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = sides.select("shape", F.explode(F.sequence(_floor(low / size), _floor(high / size))).alias("row"), *e)
    here = lambda y: F.least(F.greatest(y * size, low), high)
    flat = e["y1"] == e["y2"]
    ends = [F.when(flat, e[x]).otherwise(_at(e, here(y))) for x, y in (("x1", F.col("row") - _SLACK), ("x2", F.col("row") + 1 + _SLACK))]
    side = F.struct(*e, _floor(F.least(*ends) / size - _SLACK).alias("first"), _floor(F.greatest(*ends) / size + _SLACK).alias("last"))
    return rows.groupBy("shape", "row").agg(F.collect_list(side).alias("sides"))


def cells(strip: DataFrame, size: float) -> DataFrame:
    """(row, col, shape, odd, turns, near): cells that an edge touches, and those wholly inside, which have no ``turns`` and nothing ``near``.

    A point of the cell is inside if it is odd how many of these there are: ``odd`` itself, ``turns`` above the point, edges of ``near`` (x1, y1, x2, y2, x1, ...) that
    cross its latitude to its east.
    """
    bottom, top = (F.col("row") - _SLACK) * size, (F.col("row") + 1 + _SLACK) * size
    touched = strip.withColumn("cols", F.array_sort(F.array_distinct(F.flatten(F.transform("sides", lambda e: F.sequence(e["first"], e["last"]))))))
    run = lambda a, b: F.struct(a.alias("col"), b.alias("to"))
    between = F.filter(F.transform("cols", lambda c, i: run(c + 1, F.get("cols", i + 1) - 1)), lambda r: r["col"] <= r["to"])
    runs = touched.select("shape", "row", "sides", F.explode(F.concat(F.transform("cols", lambda c: run(c, c)), between)).alias("r")).select("shape", "row", "sides", "r.col", "r.to")
    near = F.filter("sides", lambda e: (e["first"] <= F.col("col")) & (e["last"] >= F.col("col")))
    split = runs.select("shape", "row", "col", "to", F.flatten(F.transform(near, lambda e: F.array(*[e[c] for c in _ENDS]))).alias("near"), F.filter("sides", lambda e: e["first"] > F.col("col")).alias("east"))
    # An edge is crossed if one end is above the point and the other is not; an end that two edges share counts twice, so not at all.
    free = lambda y, other, step: F.transform("east", lambda e, i: F.when(~e[y].eqNullSafe(F.get("east", i + step)[other]), e[y]))
    ends = split.select("shape", "row", "col", "to", "near", F.concat(free("y1", "y2", -1), free("y2", "y1", 1)).alias("ends"))
    # Spark would test a column that may be null before all this, and work it out twice.
    known = ends.select("shape", "row", "col", "to", "near", F.coalesce(F.size(F.filter("ends", lambda y: y > top)) % 2 == 1, F.lit(False)).alias("odd"), F.filter("ends", lambda y: (y >= bottom) & (y <= top)).alias("turns"))
    some = F.when(F.col("odd") | (F.size("near") > 0) | (F.size("turns") > 0), F.sequence("col", "to"))
    return known.select("row", F.explode(some).alias("col"), "shape", "odd", "turns", "near")


def _inside(x: Column, y: Column) -> Column:
    """Whether a point is inside the shape that the index has at its cell. The first four of an array are tested without a lambda, which takes a fraction of the time."""
    n, turns, near = F.col("_odd").cast("int"), F.size("_turns"), F.size("_near") / 4

    def east(at) -> Column:
        e = {c: F.get("_near", at * 4 + k) for k, c in enumerate(_ENDS)}
        return F.when((e["y1"] > y) != (e["y2"] > y), (x < _at(e, y)).cast("int")).otherwise(0)

    for i in range(4):
        n = n + F.when(turns > i, (F.get("_turns", F.lit(i)) > y).cast("int")).otherwise(0) + F.when(near > i, east(F.lit(i))).otherwise(0)
    more = F.when(turns > 4, F.size(F.filter("_turns", lambda end, i: (i >= 4) & (end > y)))).otherwise(0)
    more += F.when(near > 4, F.aggregate(F.sequence(F.lit(4), near.cast("int") - 1), F.lit(0), lambda n, i: n + east(i))).otherwise(0)
    return (n + more) % 2 == 1


def _met(points: DataFrame, polygons: DataFrame, size: float, lon: str, lat: str, how: str) -> DataFrame:
    """The points joined with the index's rows of their cell that hold them."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    here = points.where(x.isNotNull() & y.isNotNull()).withColumns({"_x": x, "_y": y, "_row": _floor(y / size), "_col": _floor(x / size)})
    index = cells(strips(edges(polygons), size), size).select(F.col("row").alias("_r"), F.col("col").alias("_c"), "shape", *[F.col(c).alias(f"_{c}") for c in ("odd", "turns", "near")])
    at_cell = (F.col("_row") == F.col("_r")) & (F.col("_col") == F.col("_c"))
    return here.join(index.hint("merge"), at_cell & _inside(F.col("_x"), F.col("_y")), how)


def located(points: DataFrame, polygons: DataFrame, size: float = 1.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Columns of the points, and ``shape``: a row for each shape that holds the point. ``size``: of a cell, in degrees."""
    return _met(points, polygons, size, lon, lat, "inner").drop("_x", "_y", "_row", "_col", "_r", "_c", "_odd", "_turns", "_near")


def clipped(points: DataFrame, polygons: DataFrame, size: float = 1.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The points inside any of the shapes: each place is looked up once, up to the first shape that holds it."""
    inside = _met(points.select(lon, lat).distinct(), polygons, size, lon, lat, "left_semi").select(lon, lat)
    return points.join(inside.hint("merge"), [lon, lat], "left_semi").select(*points.columns)
