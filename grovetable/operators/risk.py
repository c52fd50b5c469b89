"""Composite risk scores per child, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.growth import deficit, excess

#: Points of each part.
POINTS = {"baz": 70.0, "waz": 55.0, "haz": 45.0, "over": 30.0, "run": 15.0}


def underweight_runs(df: DataFrame, child: Column, at: Column, waz: Column, tie: Column) -> DataFrame:
    """Add ``run``: consecutive underweight visits up to this one; a visit above -2 or without a score starts anew."""
    rows = df.withColumn("__c", child).withColumn("__under", F.coalesce(waz < -2, F.lit(False)))
    order = Window.partitionBy("__c").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(F.when(F.col("__under"), 0).otherwise(1)).over(order)
    rows = rows.withColumn("__island", island)
    inside = Window.partitionBy("__c", "__island").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("run", F.sum(F.col("__under").cast("int")).over(inside).cast("int")).drop("__c", "__under", "__island")


def score(waz: Column, haz: Column, baz: Column, run: Column, months: Column) -> Column:
    """0 to 100, rounded half to even."""
    points = POINTS["baz"] * deficit(baz) + POINTS["waz"] * deficit(waz) + POINTS["haz"] * deficit(haz) + POINTS["over"] * excess(baz) + POINTS["run"] * F.least(F.coalesce(run, F.lit(0)) / 3.0, F.lit(1.0))
    times = F.when(months < 24, 1.15).when(months < 60, 1.05).otherwise(1.0)
    return F.least(F.lit(100.0), F.bround(points * times, 0))


def tier(s: Column, waz: Column, haz: Column, baz: Column) -> Column:
    return F.when(waz.isNull() & haz.isNull() & baz.isNull(), "Incomplete").when(s <= 33, "Low").when(s <= 66, "Medium").otherwise("High")


def tier_summary(scored: DataFrame) -> DataFrame:
    """(tier, n, avg_score); Incomplete has no mean."""
    return scored.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("tier") != "Incomplete", F.col("risk_score"))), 2).alias("avg_score"))


def place_summary(scored: DataFrame, place: Column) -> DataFrame:
    """(place, n, avg_score, max_score, high) over complete rows."""
    return scored.filter("tier <> 'Incomplete'").groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("risk_score"), 2).alias("avg_score"), F.max("risk_score").alias("max_score"), F.count_if(F.col("tier") == "High").alias("high"))
