"""Linear trends, forecasts and comparisons over periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import AT_RISK, NATIONAL


def trajectories(snapshots: DataFrame, kpis: list[str], target_year: int | None = None, goals: dict[str, float] = NATIONAL, digits: int = 2) -> DataFrame:
    """(district, kpi, current_rate, slope, forecast, target, status) from (district, period, <kpi>_rate ...).

    Years are the x axis where all of a district's periods are years and two differ, else places in order. Needs two points. A missing rate is left out.
    """
    rows = snapshots.select("district", F.col("period").cast("string").alias("period"), F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(f"{k}_rate").cast("double").alias("y")) for k in kpis])).alias("v")).select("district", "period", "v.*").filter("district IS NOT NULL AND y IS NOT NULL")
    by = Window.partitionBy("district", "kpi")
    rows = rows.withColumn("year", F.when(F.col("period").rlike(r"^\d{4}$"), F.col("period").try_cast("int"))).withColumn("place", F.row_number().over(by.orderBy("period")) - 1)
    last_year = rows.agg(F.max("year")).first()[0]
    last = last_year if last_year is not None else 0
    goal_year = last + 4 if target_year is None else target_year if target_year >= last else last + 1
    dated = (F.count("year").over(by) == F.count(F.lit(1)).over(by)) & (F.min("year").over(by) < F.max("year").over(by))
    rows = rows.withColumn("dated", dated).withColumn("x", F.when(F.col("dated"), F.col("year")).otherwise(F.col("place")).cast("double"))
    fit = rows.groupBy("district", "kpi").agg(
        F.count(F.lit(1)).alias("n"), F.first("dated").alias("dated"), F.max("x").alias("last_x"), F.max_by("y", "x").alias("current"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("base")
    ).filter("n >= 2")
    at = F.when(F.col("dated"), F.lit(float(goal_year))).otherwise(F.col("last_x") + max(1, goal_year - last))
    target = F.element_at(F.create_map(*[F.lit(x) for kv in goals.items() for x in kv]), F.col("kpi"))
    out = fit.withColumn("raw", F.col("base") + F.col("slope") * at).withColumn("target", target)
    status = F.when(F.col("raw") <= F.col("target"), "On Track").when(F.col("raw") <= F.col("target") * (1 + AT_RISK), "At Risk").otherwise("Off Track")
    return out.select("district", "kpi", F.round("current", 2).alias("current_rate"), F.round("slope", 4).alias("slope"), F.round("raw", digits).alias("forecast"), "target", status.alias("status"))


def archive_means(archive: DataFrame, zs: tuple[str, ...] = ("waz", "haz", "baz")) -> DataFrame:
    """(district, period, n, mean of each z) to four digits."""
    return archive.filter("district IS NOT NULL AND period IS NOT NULL").groupBy("district", "period").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(z), 4).alias(z) for z in zs])


def next_period(means: DataFrame, z: str = "waz") -> DataFrame:
    """(district, n, slope, forecast, trend, risk): a line through the periods in order, one step ahead. Needs three."""
    rows = means.filter(F.col(z).isNotNull()).withColumn("x", (F.row_number().over(Window.partitionBy("district").orderBy("period")) - 1).cast("double"))
    fit = rows.groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(z, "x").alias("s"), F.regr_intercept(z, "x").alias("b")).filter("n >= 3")
    f = F.round(F.col("b") + F.col("s") * F.col("n"), 4)
    return fit.select("district", "n", F.round("s", 4).alias("slope"), f.alias("forecast"), F.when(F.col("s") > 0.05, "improving").when(F.col("s") < -0.05, "declining").otherwise("stable").alias("trend"),
                      F.when(f < -2, "High").when(f < -1.5, "Medium").otherwise("Low").alias("risk"))


def compare(series: DataFrame, key: Column, at: Column, value: Column) -> DataFrame:
    """(key, first, last, delta, trend): change from the earliest to the latest, and the direction of a line through all.

    A slope within 0.001 is stable; below it counts as improving, for scores too.
    """
    rows = series.select(key.alias("key"), at.alias("at"), value.cast("double").alias("v"))
    rows = rows.withColumn("x", (F.row_number().over(Window.partitionBy("key").orderBy("at")) - 1).cast("double"))
    out = rows.groupBy("key").agg(F.min_by("v", "x").alias("first"), F.max_by("v", "x").alias("last"), F.regr_slope("v", "x").alias("slope"))
    return out.select("key", "first", "last", F.round(F.col("last") - F.col("first"), 4).alias("delta"), F.when(F.col("slope").isNull() | (F.abs("slope") < 0.001), "stable").when(F.col("slope") < 0, "improving").otherwise("worsening").alias("trend"))
