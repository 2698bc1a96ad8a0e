"""Rasters as tables of cells, sampled by computed cell indexes.

A raster is a table (layer, row, col, value) and its geometry. No raster format is read here: tiles are turned into that
table beforehand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Longitude and latitude of the north-west corner, and the cell size, in degrees."""

    west: float
    north: float
    size: float

    @property
    def around(self) -> int:
        """Columns of a whole turn; a raster that spans the globe goes on at its other edge."""
        return round(360 / self.size)

    def row(self, lat: Column) -> Column:
        return F.floor((self.north - lat) / self.size).cast("int")

    def col(self, lon: Column) -> Column:
        return F.floor((lon - self.west) / self.size).cast("int")


def sample(points: DataFrame, cells: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The points with layer and value of the cell they lie in: an equi-join; points off the raster have nulls."""
    at = points.withColumns({"_row": grid.row(F.col(lat)), "_col": grid.col(F.col(lon))})
    return at.join(cells.withColumnsRenamed({"row": "_row", "col": "_col"}), ["_row", "_col"], "left").drop("_row", "_col")


def sample_layers(points: DataFrame, cells: DataFrame, grid: Grid, layers: list[str], key: str = "env", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One column for each layer, in the given order: bioclimatic variables, elevation and soil features alike."""
    found = sample(points, cells.where(F.col("layer").isin(layers)), grid, lon, lat)
    return found.groupBy(key, lon, lat).pivot("layer", layers).agg(F.first("value"))


def bioclim_layers(wanted) -> list[str]:
    """BIO1 .. BIO19 from numbers or names, by number."""
    numbers = sorted({int(str(x).upper().removeprefix("BIO")) for x in wanted})
    if not numbers or numbers[0] < 1 or numbers[-1] > 19:
        raise ValueError("bioclimatic variables are numbered 1 to 19")
    return [f"BIO{n}" for n in numbers]


def within_radius(points: DataFrame, cells: DataFrame, grid: Grid, cells_around: int, key: str = "env", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(key, layer, value) of all cells of the square around each point; the offsets are exploded, so the join stays an equi-join."""
    around = F.sequence(F.lit(-cells_around), F.lit(cells_around))
    at = points.withColumns({"_r": F.explode(around)}).withColumns({"_c": F.explode(around)})
    at = at.select(key, (grid.row(F.col(lat)) + F.col("_r")).alias("row"), (grid.col(F.col(lon)) + F.col("_c")).alias("col"))
    return at.join(cells, ["row", "col"]).select(key, "layer", "value")


#: Mean radius of the earth in metres.
RADIUS = 6_371_008.8


def metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), F.lit(2))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * RADIUS * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def within_metres(points: DataFrame, cells: DataFrame, grid: Grid, buffer: float, key: str = "env", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(key, layer, value) of the cells whose centre is at most so many metres from a point; where there is none, of the cell it lies in.

    Candidates are rings of cells: the rows a circle reaches, and in each row as many columns as its latitude makes of it, all of
    them where the circle holds a pole. Columns are counted around the globe, so 180 degrees is no edge. Each candidate is then measured.
    """
    angle = buffer / RADIUS
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    reach = int(buffer / (RADIUS * 3.14159 / 180) / grid.size) + 1
    lowest = round((grid.north + 90) / grid.size) - 1
    here = points.where(x.isNotNull() & y.isNotNull()).select(key, x.alias("_x"), y.alias("_y"), grid.row(y).alias("_r"), grid.col(x).alias("_c"))
    rows = here.select("*", F.explode(F.sequence(F.greatest(F.col("_r") - reach, F.lit(0)), F.least(F.col("_r") + reach, F.lit(lowest)))).alias("row"))
    own = F.radians(F.col("_y"))
    centre = F.radians(F.lit(grid.north) - (F.col("row") + 0.5) * grid.size)
    share = (F.cos(F.lit(angle)) - F.sin(own) * F.sin(centre)) / F.nullif(F.cos(own) * F.cos(centre), F.lit(0.0))
    half = F.when(share.isNull() | (share <= -1), 180.0).when(share < 1, F.degrees(F.acos(share)))
    wide = F.least(F.floor(half / grid.size).cast("int") + 1, F.lit(grid.around // 2))
    columns = F.when(wide * 2 + 1 >= grid.around, F.sequence(F.lit(0), F.lit(grid.around - 1))).otherwise(F.sequence(F.col("_c") - wide, F.col("_c") + wide))
    ring = rows.where(half.isNotNull()).select(key, "_x", "_y", "row", F.explode(columns).alias("col")).withColumn("col", F.pmod("col", F.lit(grid.around)))
    far = metres(F.col("_x"), F.col("_y"), F.lit(grid.west) + (F.col("col") + 0.5) * grid.size, F.lit(grid.north) - (F.col("row") + 0.5) * grid.size)
    ring = ring.where(far <= buffer).select(key, "_x", "_y", "row", "col")
    alone = here.join(ring.select("_x", "_y").distinct(), ["_x", "_y"], "left_anti").select(key, F.col("_r").alias("row"), F.pmod("_c", F.lit(grid.around)).alias("col"))
    at = ring.select(key, "row", "col").unionByName(alone)
    placed = cells.withColumn("col", F.pmod("col", F.lit(grid.around)))
    return at.join(placed, ["row", "col"]).select(key, "layer", "value")


def get_spatial(points: DataFrame, cells: DataFrame, grid: Grid, layers: list[str], key: str = "env", lon: str = "lon", lat: str = "lat", merge: bool = False) -> DataFrame:
    """Raster features of points, on their own or joined back to the points."""
    found = sample_layers(points, cells, grid, layers, key, lon, lat)
    return points.join(found.drop(lon, lat), key) if merge else found


def get_elevation(points: DataFrame, cells: DataFrame, grid: Grid, layer: str = "elev", key: str = "env", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(key, lon, lat, ALT); null over water."""
    return sample(points.select(key, lon, lat), cells.where(F.col("layer") == layer).drop("layer"), grid, lon, lat).withColumnRenamed("value", "ALT")


def get_bioclim(points: DataFrame, cells: DataFrame, grid: Grid, wanted=range(1, 20), key: str = "env", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """BIO1 .. BIO19 in columns, by number."""
    return sample_layers(points, cells, grid, bioclim_layers(wanted), key, lon, lat)


def get_zones(points: DataFrame, cells: DataFrame, grid: Grid, legend: DataFrame, buffer: float = 0.0, cells_around: int = 0, key: str = "env", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The zone of each point with its legend: the cell's, or the most frequent of those within ``buffer`` metres, or of a square of cells, and its share."""
    from agrolith.operators.zones import majority, with_legend

    if buffer < 0:
        raise ValueError("a buffer is a number of metres, 0 or more")
    if buffer:
        found = majority(within_metres(points, cells, grid, buffer, key, lon, lat).select(key, F.col("value").cast("int").alias("code")), key)
    elif cells_around:
        found = majority(within_radius(points, cells, grid, cells_around, key, lon, lat).select(key, F.col("value").cast("int").alias("code")), key)
    else:
        found = sample(points.select(key, lon, lat), cells.drop("layer"), grid, lon, lat).select(key, F.col("value").cast("int").alias("code"), F.lit(1.0).alias("share"))
    return with_legend(found, legend)
