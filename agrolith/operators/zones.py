"""Agro-ecological zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agrolith.constants import ZONES


def zone_legend(spark: SparkSession) -> DataFrame:
    """code, label, thermal, moisture, arable of the 57 zones."""
    df = spark.createDataFrame(list(enumerate(ZONES, 1)), "code int, label string")
    moisture = F.lit(None).cast("string")
    for m in ("semi-arid", "humid", "sub-humid", "per-humid"):
        moisture = F.when(F.col("label").contains(m), m).otherwise(moisture)
    return df.select("code", "label", F.regexp_replace("label", "[,;].*$", "").alias("thermal"), moisture.alias("moisture"), (~F.col("code").between(50, 57)).alias("arable"))


def majority(cells: DataFrame, key: str = "env", code: str = "code") -> DataFrame:
    """(key, code, share) of the most frequent code of each key; of equals the first by its text."""
    counts = cells.where(F.col(code).isNotNull()).groupBy(key, code).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    ranked = counts.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), F.col(code).cast("string")))).withColumn("share", F.col("n") / F.sum("n").over(w))
    return ranked.where("r = 1").select(key, code, "share")


def with_legend(zones: DataFrame, legend: DataFrame, code: str = "code") -> DataFrame:
    """A left lookup; of rows with equal codes in the legend one counts."""
    return zones.join(F.broadcast(legend.dropDuplicates([code])), code, "left") if code in legend.columns else zones
