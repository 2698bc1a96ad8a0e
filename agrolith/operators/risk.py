"""Risk profiles over many years: how often and how long stress classes occur in each stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.constants import RISK_CLASSES
from agrolith.functions import bins
from agrolith.operators.phenology import env_phenology
from agrolith.schema import require

KEYS = ("site", "var", "stage", "class")
#: Classes that stand for no stress, when printing and when weighting.
BENIGN_PRINT = ("safe", "none", "non_limiting", "optimal", "low", "wet")
BENIGN_WEIGHTS = ("safe", "none", "non_limiting", "optimal", "low", "wet", "moderate")


def season_cut(df: DataFrame, site: str = "site", date: str = "date", years: Sequence[int] | None = None, planting: str | Mapping[str, str] | Sequence[str] | None = None, length: int = 150, min_days: int = 30) -> DataFrame:
    """All columns of the input and season (year of planting), day (from 1): rows within ``length`` days of each planting.

    Planting is the first of January, one "MM-DD", one for each site, or dates (the first of each year counts). Seasons
    with fewer rows than ``min_days`` are left out. A day can belong to the seasons of two plantings when length exceeds a year.
    """
    require(df, [site, date])
    spark = df.sparkSession
    if planting is None or isinstance(planting, str):
        start = F.make_date("season", *[F.lit(int(x)) for x in (planting or "01-01").split("-")])
    elif isinstance(planting, Mapping):
        start = F.lit(None).cast("date")
        for name, md in planting.items():
            start = F.when(F.col(site) == name, F.make_date("season", *[F.lit(int(x)) for x in md.split("-")])).otherwise(start)
    else:
        first = {d[:4]: d for d in sorted(map(str, planting), reverse=True)}
        start = F.lit(None).cast("date")
        for year, d in first.items():
            start = F.when(F.col("season") == int(year), F.lit(d).cast("date")).otherwise(start)
    # A day belongs to plantings of its own and of earlier years, as far back as a season is long: no range join is needed.
    back = -(-length // 365)
    cut = df.withColumn("season", F.explode(F.sequence(F.year(date) - back, F.year(date)))).withColumn("_start", start)
    cut = cut.withColumn("day", F.datediff(date, "_start") + 1).where(F.col("day").between(1, length)).drop("_start")
    if years is not None:
        cut = cut.where(F.col("season").isin(list(years)))
    else:
        # Plantings count in the years that a site has data of.
        seen = df.select(F.col(site), F.year(date).alias("season")).distinct()
        cut = cut.join(seen, [site, "season"], "left_semi")
    return cut.withColumn("_n", F.count("*").over(Window.partitionBy(site, "season"))).where(F.col("_n") >= min_days).drop("_n")


@dataclass
class RiskProfile:
    frequency: DataFrame
    severity: DataFrame
    return_period: DataFrame
    seasons: DataFrame

    def top(self, n: int = 10) -> DataFrame:
        """The most frequent stress classes."""
        return self.frequency.where(~F.col("class").isin(*BENIGN_PRINT)).orderBy(F.desc("freq"), F.desc("mean_days"), *KEYS).limit(n)


def env_risk_profile(df: DataFrame, site: str = "site", date: str = "date", variables: Sequence[str] | None = None, years: Sequence[int] | None = None, planting=None, length: int = 150, cardinals: Mapping | None = None, by_stage: bool = True, crop: str = "maize", stages=None, min_days: int = 30, **phenology) -> RiskProfile:
    """Days of each class by site, stage and season (zeros kept), their frequency over seasons, severity and return period.

    One lazy plan: seasons, phenology, classes, two aggregations. Severity is over the pooled days of a class.
    """
    table = {**RISK_CLASSES, **(cardinals or {})}
    variables = [v for v in (variables or table) if v in df.columns]
    if not variables:
        raise ValueError("no variable has risk classes")
    cut = season_cut(df, site, date, years, planting, length, min_days)
    if by_stage:
        cut = env_phenology(cut, [site, "season"], "day", crop=crop, stages=stages, **phenology).where(F.col("stage").isNotNull())
    else:
        cut = cut.withColumn("stage", F.lit("season"))
    of = F.lit(None).cast("string")
    for v in variables:
        of = F.when(F.col("var") == v, bins.classify(F.col("value"), *table[v])).otherwise(of)
    days = cut.select(F.col(site).alias("site"), "season", "stage", *[F.col(v).cast("double").alias(v) for v in variables]).unpivot(["site", "season", "stage"], variables, "var", "value").withColumn("class", of)
    menu = F.array(*[F.struct(F.lit(v).alias("var"), F.lit(c).alias("class")) for v in variables for c in dict.fromkeys(table[v][1])])
    grid = cut.select(F.col(site).alias("site"), "season").distinct().join(cut.select(F.col(site).alias("site"), "stage").distinct(), "site").select("site", "season", "stage", F.inline(menu))
    counted = days.where(F.col("class").isNotNull()).groupBy("site", "season", "stage", "var", "class").agg(F.count("*").alias("days"))
    seasons = grid.join(counted, ["site", "season", "stage", "var", "class"], "left").withColumn("days", F.coalesce("days", F.lit(0)))
    frequency = seasons.groupBy(*KEYS).agg(F.countDistinct("season").alias("n_years"), F.sum((F.col("days") > 0).cast("long")).alias("n_occur"), F.avg("days").alias("mean_days"), F.max("days").alias("max_days"))
    frequency = frequency.withColumn("freq", F.col("n_occur") / F.col("n_years"))
    severity = days.where(F.col("class").isNotNull()).groupBy(*KEYS).agg(F.count("value").alias("n_days"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", 0.1).alias("p10"), F.percentile("value", 0.9).alias("p90"))
    period = F.try_divide(F.lit(1.0), "freq")
    return_period = frequency.select(*KEYS, "n_years", "freq", period.alias("return_period"), F.coalesce(period <= F.col("n_years") / 3, F.lit(False)).alias("reliable"))
    return RiskProfile(frequency, severity, return_period, seasons)


def tpe_weights(frequency: DataFrame, stage: str | None = None, var: str | None = None, by: str = "class", measure: str = "freq", drop_benign: bool = True) -> DataFrame:
    """(group, weight), heaviest first: shares of classes or sites in the stress that is left. Raises if there is none."""
    kept = frequency
    if stage is not None:
        kept = kept.where(F.col("stage") == stage)
    if var is not None:
        kept = kept.where(F.col("var") == var)
    if drop_benign:
        kept = kept.where(~F.col("class").isin(*BENIGN_WEIGHTS))
    totals = kept.groupBy(F.col(by).alias("group")).agg(F.sum("freq" if measure == "freq" else "mean_days").alias("total"))
    if not (totals.agg(F.sum("total")).first()[0] or 0) > 0:
        raise ValueError("no stress is left to weigh")
    return totals.select("group", (F.col("total") / F.sum("total").over(Window.partitionBy())).alias("weight")).orderBy(F.desc("weight"), "group")


def project_risk(baseline: DataFrame, scenario: DataFrame) -> DataFrame:
    """Frequencies and mean days of two profiles side by side, what one lacks as 0, and their differences, greatest change first."""
    pick = lambda df, end: df.select(*KEYS, F.col("freq").alias(f"freq_{end}"), F.col("mean_days").alias(f"days_{end}"))
    both = pick(baseline, "base").join(pick(scenario, "future"), list(KEYS), "full").fillna(0.0, [f"{a}_{b}" for a in ("freq", "days") for b in ("base", "future")])
    both = both.withColumns({"freq_diff": F.col("freq_future") - F.col("freq_base"), "days_diff": F.col("days_future") - F.col("days_base")})
    return both.orderBy(F.desc(F.abs("freq_diff")), *KEYS)
