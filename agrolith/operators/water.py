"""Daily soil water balance of a root zone (one bucket), and its summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.constants import SOIL_DIVISORS, SOIL_LAYERS
from agrolith.functions import bins
from agrolith.operators.summary import interval
from agrolith.schema import require


def parse_soil(soil: DataFrame, env: str = "env", convert: bool = True) -> DataFrame:
    """(env, property, layer, value, top, bottom) from columns ``property|layer``; units by divisor, bounds by layer (a literal table)."""
    names = [c for c in soil.columns if "|" in c]
    if not names:
        raise ValueError("no column is named property|layer")
    cells = []
    for name in names:
        prop, layer = name.split("|", 1)
        top, bottom = SOIL_LAYERS.get(layer, (None, None))
        value = F.col(f"`{name}`").cast("double") / (SOIL_DIVISORS.get(prop, 1.0) if convert else 1.0)
        bounds = [F.lit(x).cast("double").alias(n) for x, n in ((top, "top"), (bottom, "bottom"))]
        cells.append(F.struct(F.lit(prop).alias("property"), F.lit(layer).alias("layer"), value.alias("value"), *bounds))
    return soil.select(F.col(env).alias("env"), F.inline(F.array(*cells)))


def water_capacity(layers: DataFrame, field: str = "wv0033", wilting: str = "wv1500") -> DataFrame:
    """(env, layer, top, bottom, water): plant-available water of each layer as a share of its volume, not below 0."""
    wide = layers.groupBy("env", "layer", "top", "bottom").pivot("property", [field, wilting]).agg(F.first("value"))
    return wide.where(F.col(field).isNotNull() & F.col(wilting).isNotNull() & F.col("top").isNotNull()).select("env", "layer", "top", "bottom", F.greatest(F.col(field) - F.col(wilting), F.lit(0.0)).alias("water"))


def root_depth(day: Column, deepest: float, first: float, day_of_deepest: float) -> Column:
    grown = first + (deepest - first) * day / day_of_deepest
    return F.least(F.greatest(grown, F.lit(float(first))), F.lit(float(deepest)))


def _kept(layers: Column, depth: Column) -> Column:
    """Water in mm that layers hold down to a depth."""
    part = lambda x: x["water"] * F.greatest(F.least(x["bottom"], depth) - F.least(x["top"], depth), F.lit(0.0))
    return F.aggregate(layers, F.lit(0.0), lambda a, x: a + part(x))


STRESS = ("none", "mild", "moderate", "severe")


def daily_demand(df: DataFrame, capacity: DataFrame, env: str = "env", day: str = "daysFromStart", rain: str = "PRECTOT", demand: str | None = None, irrigation: str | None = None, root: tuple[float, float, float] = (1000.0, 300.0, 60.0), kc_days: Sequence[float] = (1, 20, 45, 90, 120), kc: Sequence[float] = (0.4, 0.75, 1.15, 1.15, 0.6), p: float = 0.55, adjust: bool = True) -> DataFrame:
    """(env, day, rain, irrigation, et0, kc, etc, taw, raw): what a day brings and asks for, before the bucket."""
    if demand is None:
        demand = next((c for c in ("ETP", "EVPTRNS") if c in df.columns), None)
    if demand is None:
        raise ValueError("no column holds the evaporative demand: name one, or process the weather first")
    require(df, [env, day, rain, demand, *([irrigation] if irrigation else [])])
    soil = capacity.groupBy("env").agg(F.collect_list(F.struct("top", "bottom", "water")).alias("_layers"))
    zero = F.lit(0.0)
    et0 = F.greatest(F.coalesce(F.col(demand).cast("double"), zero), zero)
    coefficient = bins.interpolated(F.col(day).cast("double"), list(map(float, kc_days)), list(map(float, kc)))
    rows = df.select(F.col(env).alias("env"), F.col(day).cast("int").alias("day"), F.coalesce(F.col(rain).cast("double"), zero).alias("rain"), (F.coalesce(F.col(irrigation).cast("double"), zero) if irrigation else zero).alias("irrigation"), et0.alias("et0"), coefficient.alias("kc"))
    rows = rows.join(soil, "env").withColumn("etc", F.col("kc") * F.col("et0")).withColumn("taw", _kept(F.col("_layers"), root_depth(F.col("day").cast("double"), *root)))
    share = F.least(F.greatest(p + 0.04 * (5 - F.col("etc")), F.lit(0.1)), F.lit(0.8)) if adjust else F.lit(p)
    return rows.withColumn("raw", share * F.col("taw")).drop("_layers")


def water_balance(df: DataFrame, capacity: DataFrame, env: str = "env", day: str = "daysFromStart", rain: str = "PRECTOT", demand: str | None = None, irrigation: str | None = None, root: tuple[float, float, float] = (1000.0, 300.0, 60.0), kc_days: Sequence[float] = (1, 20, 45, 90, 120), kc: Sequence[float] = (0.4, 0.75, 1.15, 1.15, 0.6), p: float = 0.55, adjust: bool = True, start_depletion: float = 0.0, digits: int | None = 4) -> DataFrame:
    """(env, day, rain, irrigation, et0, kc, etc, taw, raw, ks, eta, drainage, depletion, asw, stress, stress_order) of each day.

    The stress coefficient of a day follows the depletion of the day before against the day's own capacity. An
    environment's days are gathered in order, and a fold carries the depletion through them, without leaving SQL; the array
    is as long as a season. ``root`` is (greatest depth, depth at first, day of the greatest). Environments without
    soil are an error of the caller: see ``without_soil``.
    """
    rows, zero = daily_demand(df, capacity, env, day, rain, demand, irrigation, root, kc_days, kc, p, adjust), F.lit(0.0)
    fields = ("day", "rain", "irrigation", "et0", "kc", "etc", "taw", "raw")
    seasons = rows.groupBy("env").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("days"))
    start = F.struct(F.lit(float(start_depletion)).alias("dr"), F.array().cast("array<struct<ks:double,drainage:double,dr:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        before = acc["dr"]
        ks = F.when(x["taw"] <= 0, 0.0).when(before <= x["raw"], 1.0).otherwise(F.greatest((x["taw"] - before) / (x["taw"] - x["raw"]), zero))
        balance = before - x["rain"] - x["irrigation"] + ks * x["etc"]
        after = F.least(F.greatest(balance, zero), x["taw"])
        return F.struct(after.alias("dr"), F.concat(acc["out"], F.array(F.struct(ks.alias("ks"), F.greatest(-balance, zero).alias("drainage"), after.alias("dr")))).alias("out"))

    done = seasons.select("env", "days", F.aggregate("days", start, step)["out"].alias("out")).select("env", F.inline(F.arrays_zip("days", "out")))
    done = done.select("env", "days.*", F.col("out.ks").alias("ks"), (F.col("out.ks") * F.col("days.etc")).alias("eta"), F.col("out.drainage").alias("drainage"), F.col("out.dr").alias("depletion"))
    done = done.withColumn("asw", F.col("taw") - F.col("depletion"))
    lack = 1 - F.col("ks")
    order = F.when(lack <= 1e-6, 0).when(lack <= 0.2, 1).when(lack <= 0.5, 2).otherwise(3)
    done = done.withColumn("stress_order", order).withColumn("stress", F.get(F.array(*[F.lit(s) for s in STRESS]), F.col("stress_order")))
    return done if digits is None else done.withColumns({c: F.round(c, digits) for c in ("et0", "kc", "etc", "taw", "raw", "ks", "eta", "drainage", "depletion", "asw")})


def without_soil(df: DataFrame, capacity: DataFrame, env: str = "env") -> DataFrame:
    return df.select(F.col(env).alias("env")).distinct().join(capacity, "env", "left_anti")


def longest_run(df: DataFrame, keys: Sequence[str], order: str, holds: Column) -> DataFrame:
    """(keys..., longest_run): the most consecutive rows for which a condition holds; a null breaks a run."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_on", F.coalesce(holds, F.lit(False))).withColumn("_n", F.row_number().over(w))
    island = F.col("_n") - F.row_number().over(Window.partitionBy(*keys, "_on").orderBy(order))
    runs = marked.withColumn("_island", island).groupBy(*keys, "_on", "_island").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_on"), F.col("n"))), F.lit(0)).alias("longest_run"))


def summarize_water_balance(wb: DataFrame, by_interval: bool = False, breaks: Sequence[float] = (), names: Sequence[str] | None = None) -> DataFrame:
    """One row for each environment (and interval, named Interval_1 .. n by default): stress, totals and the longest run of stress."""
    keys = ["env"]
    if by_interval:
        labels = list(names or [f"Interval_{i + 1}" for i in range(len(breaks))])
        wb = wb.withColumn("interval", interval(F.col("day"), list(breaks), labels)).where(F.col("interval").isNotNull())
        keys.append("interval")
    total = [F.round(F.sum(c), 4).alias(f"total_{c}") for c in ("eta", "etc", "rain", "irrigation", "drainage")]
    stats = wb.groupBy(*keys).agg(F.count("*").alias("n_days"), F.round(F.avg("ks"), 4).alias("mean_ks"), F.min("ks").alias("min_ks"), F.sum((F.col("ks") < 1).cast("long")).alias("stress_days"), *total, F.round(F.avg("asw"), 4).alias("mean_asw"), F.round(F.avg("depletion"), 4).alias("mean_depletion"))
    return stats.join(longest_run(wb, keys, "day", F.col("ks") < 1), keys).orderBy(*keys)
