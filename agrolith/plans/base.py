"""Environment tables made of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = ("T2M_MAX", "T2M_MIN", "PRECTOT")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def env_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each of ten environments and date, weather-like columns from the events of the day."""
    value, date = F.col("value"), F.to_date("ts")
    days = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("k"), date.alias("date")).agg((20 + 0.7 * F.sqrt(F.max(value))).alias("T2M_MAX"), (5 + F.sqrt(F.avg(value))).alias("T2M_MIN"), (5 * F.sqrt(F.min(value))).alias("PRECTOT"), (5 + 2 * F.sqrt(F.avg(value))).alias("ALLSKY_SFC_SW_DWN"), (40 + 3 * F.sqrt(F.avg(value))).alias("RH2M"))
    return days.select(
        F.concat(F.lit("E"), F.col("k").cast("string")).alias("env"), "date", F.dayofyear("date").alias("DOY"), F.dayofmonth("date").alias("daysFromStart"), ((F.col("k") - 5) * 6.0).alias("LAT"),
        "T2M_MAX", "T2M_MIN", (F.col("T2M_MIN") - 1).alias("T2MDEW"), ((F.col("T2M_MAX") + F.col("T2M_MIN")) / 2).alias("T2M"), "PRECTOT", "ALLSKY_SFC_SW_DWN", "RH2M",
    )


ENV_DAYS = """
g AS (SELECT user_id % 10 AS k, CAST(ts AS DATE) AS date, 20 + 0.7 * sqrt(max(value)) AS T2M_MAX, 5 + sqrt(avg(value)) AS T2M_MIN, 5 * sqrt(min(value)) AS PRECTOT,
        5 + 2 * sqrt(avg(value)) AS ALLSKY_SFC_SW_DWN, 40 + 3 * sqrt(avg(value)) AS RH2M FROM events GROUP BY 1, 2),
d AS (SELECT 'E' || CAST(k AS VARCHAR) AS env, date, CAST(dayofyear(date) AS INTEGER) AS DOY, CAST(day(date) AS INTEGER) AS daysFromStart, (k - 5) * 6.0::DOUBLE AS LAT, T2M_MAX, T2M_MIN, T2M_MIN - 1 AS T2MDEW,
        (T2M_MAX + T2M_MIN) / 2 AS T2M, PRECTOT, ALLSKY_SFC_SW_DWN, RH2M FROM g)"""


def melted(source: str = "d", variables=VARIABLES, keys: str = "env", name: str = "variable") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{v}' AS {name}, CAST({v} AS DOUBLE) AS value FROM {source}" for v in variables)


def site_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each of ten sites and ship date: a series over years."""
    days = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("k"), F.to_date("l_shipdate").alias("date")).agg((5 * F.sqrt(F.avg("l_quantity"))).alias("q"), (100 * F.sqrt(F.avg("l_discount")) / 3).alias("disc"), F.sqrt(F.avg("l_extendedprice") / 50).alias("price"))
    return days.select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("site"), "date", (F.col("q") + 8).alias("T2M_MAX"), (F.col("q") / 2).alias("T2M_MIN"), F.col("disc").alias("PRECTOT"), "price")


SITE_DAYS = """
sg AS (SELECT l_suppkey % 10 AS k, CAST(l_shipdate AS DATE) AS date, 5 * sqrt(avg(l_quantity)) AS q, 100 * sqrt(avg(l_discount)) / 3 AS disc, sqrt(avg(l_extendedprice) / 50) AS price FROM lineitem GROUP BY 1, 2),
s AS (SELECT 'S' || CAST(k AS VARCHAR) AS site, date, q + 8 AS T2M_MAX, q / 2 AS T2M_MIN, disc AS PRECTOT, price FROM sg)"""


def embedding_w(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """(env, covariable, value): mean of each element of the vectors with a label."""
    long = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("env"), F.posexplode("embedding").alias("at", "x"))
    return long.groupBy("env", F.concat(F.lit("v"), F.lpad((F.col("at") + 1).cast("string"), 2, "0")).alias("covariable")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


EMBEDDING_W = """
w AS (SELECT 'L' || CAST(label AS VARCHAR) AS env, 'v' || lpad(CAST(pos AS VARCHAR), 2, '0') AS covariable, round(avg(CAST(x AS DOUBLE)), 6) AS value
      FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2)"""


def rounded(df: DataFrame, digits: int = 4, but: tuple[str, ...] = ()) -> DataFrame:
    """Floating-point columns rounded: sums come in another order elsewhere."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") and c not in but else F.col(c) for c, t in df.dtypes])
