"""Key figures against targets, prevalence by place and group, snapshots and transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import pct_of

#: Target rates in percent.
NATIONAL = {"stunting": 15.0, "wasting": 5.0, "underweight": 12.0, "overweight": 10.0}
WORLD = {"stunting": 20.0, "wasting": 5.0, "underweight": 10.0, "overweight": 3.0}
AMBER, AT_RISK = 0.20, 0.30
ALIASES = {"stunting": ("stunting", "ind_bantut", "ind_bantut_zscore"), "wasting": ("wasting", "ind_susut", "ind_susut_zscore"), "underweight": ("underweight", "ind_kurang_berat_badan", "ind_kurang_berat", "ind_kurangberat", "ind_kurang_berat_zscore"), "overweight": ("overweight", "ind_berlebihan_bb", "ind_berlebihan", "ind_obes", "ind_obes_zscore")}


def targets(overrides: dict[str, float] | None = None) -> dict[str, float]:
    return NATIONAL | {k: float(v) for k, v in (overrides or {}).items() if k in NATIONAL}


def flag_columns(columns: list[str]) -> dict[str, str | None]:
    """The column of each indicator: the first alias that is there, whatever its case."""
    by = {c.lower(): c for c in columns}
    return {k: next((by[a] for a in names if a in by), None) for k, names in ALIASES.items()}


def rag(actual: Column, target: Column, tolerance: float = AMBER) -> Column:
    return F.when(actual <= target, "Green").when(actual <= target * (1 + tolerance), "Amber").otherwise("Red")


def _stacked(df: DataFrame, dims: dict[str, Column], flags: dict[str, Column]) -> DataFrame:
    return df.select(*[c.alias(k) for k, c in dims.items()], F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), F.coalesce(c.cast("boolean"), F.lit(False)).alias("hit")) for k, c in flags.items()])).alias("v")).select(*dims, "v.*")


def kpi_rates(df: DataFrame, flags: dict[str, Column], dims: list[Column] | None = None, own_targets: dict[str, float] | None = None, tolerance: float = AMBER) -> DataFrame:
    """(dims, kpi, n, cases, rate, target, gap, status, world_status). A missing flag is not a case."""
    named = {f"d{i}": d for i, d in enumerate(dims or [])}
    goal = targets(own_targets)
    table = lambda t: F.element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), F.col("kpi"))
    out = _stacked(df, named, flags).groupBy(*named, "kpi").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("cases"))
    out = out.withColumn("rate", F.round(100.0 * F.col("cases") / F.col("n"), 2)).withColumn("target", table(goal))
    return out.withColumn("gap", F.round(F.col("rate") - F.col("target"), 2)).withColumn("status", rag(F.col("rate"), F.col("target"), tolerance)).withColumn("world_status", rag(F.col("rate"), table(WORLD), tolerance))


def overall_status(rates: DataFrame) -> DataFrame:
    """One row: the worst status; Green without children."""
    worst = F.coalesce(F.max(F.when(F.col("status") == "Red", 3).when(F.col("status") == "Amber", 2).otherwise(1)), F.lit(1))
    return rates.agg(F.element_at(F.array(F.lit("Green"), F.lit("Amber"), F.lit("Red")), worst).alias("overall"))


def breakdown(df: DataFrame, flags: dict[str, Column], dims: dict[str, Column]) -> DataFrame:
    """(dimension, value, kpi, n, cases, rate, status) for every dimension at once; null values are left out.

    One pass: each row is spread over its dimensions and indicators and summed up before the shuffle.
    """
    spread = df.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in dims.items()])).alias("d"), *[c.alias(k) for k, c in flags.items()]
    ).select("d.*", *flags)
    out = _stacked(spread, {"dimension": F.col("dimension"), "value": F.col("value")}, {k: F.col(k) for k in flags}).filter("value IS NOT NULL").groupBy("dimension", "value", "kpi").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("cases"))
    goal = F.element_at(F.create_map(*[F.lit(x) for kv in NATIONAL.items() for x in kv]), F.col("kpi"))
    out = out.withColumn("rate", F.round(100.0 * F.col("cases") / F.col("n"), 2))
    return out.withColumn("status", rag(F.col("rate"), goal))


def age_bucket(months: Column) -> Column:
    """The dashboard's two buckets; a missing age falls into the second."""
    return F.when(months < 24, "0-2 Tahun").otherwise("2-5 Tahun")


def indicator_sets(df: DataFrame, flags: dict[str, Column], dims: dict[str, Column], sets: list[list[str]], months: Column) -> DataFrame:
    """(age_group, indicator, breakdown, dims, n, cases, pct) over grouping sets, in one shuffle.

    Under two and under five overlap, so rows are spread over the age groups that they are in. The overall n counts all rows
    of the age group, a breakdown's n those with a known flag.
    """
    base = df.select(*[c.cast("string").alias(k) for k, c in dims.items()], months.alias("__m"), *[c.cast("boolean").alias(f"f_{k}") for k, c in flags.items()])
    ages = F.array_compact(F.array(F.when(F.col("__m") < 24, "Bawah 2 Tahun"), F.when(F.col("__m") < 60, "Bawah 5 Tahun")))
    rows = base.withColumn("age_group", F.explode(ages)).select("age_group", *dims, F.explode(F.array(*[F.struct(F.lit(k).alias("indicator"), F.col(f"f_{k}").alias("hit")) for k in flags])).alias("v")).select("age_group", *dims, "v.*")
    cols = ["age_group", "indicator", *dims]
    out = rows.groupingSets([["age_group", "indicator", *s] for s in sets], *cols).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("rows"), F.count("hit").alias("known"), F.count_if("hit").alias("cases"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    name = F.concat_ws("+", *[F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dims])
    out = out.withColumn("breakdown", F.when(name == "", "overall").otherwise(name)).withColumn("n", F.when(F.col("breakdown") == "overall", F.col("rows")).otherwise(F.col("known")))
    known = F.lit(True)
    for d in dims:
        known = known & ((F.col(f"g_{d}") == 1) | F.col(d).isNotNull())
    return out.filter(known).withColumn("pct", pct_of(F.col("cases"), F.col("n"))).select("age_group", "indicator", "breakdown", *dims, "n", "cases", "pct")


def tidy(sets: DataFrame, dims: list[str]) -> DataFrame:
    """The aggregated export: one value column for all breakdowns."""
    return sets.select("age_group", "indicator", "breakdown", F.concat_ws(" / ", *dims).alias("value"), "n", "cases", "pct")


def label_flags(berat: Column, tinggi: Column, bmi: Column) -> dict[str, Column]:
    """Flags from source labels, where no z-score is at hand."""
    low = lambda c: F.lower(F.trim(c.cast("string")))
    return {
        "kurang_berat": low(berat).isin("kurang berat badan", "sangat kurang berat badan"), "bantut": low(tinggi).isin("bantut", "bantut teruk"), "susut": low(bmi).isin("susut", "susut teruk"),
        "obes": low(bmi).isin("berlebihan berat badan", "obes", "risiko berlebihan berat badan"),
    }


def snapshots(df: DataFrame, district: Column, period: Column, flags: dict[str, Column]) -> DataFrame:
    """(district, period, n_records, <flag>_rate ...): all rows with a district and a period, analyzable or not."""
    named = df.select(district.alias("district"), period.alias("period"), *[F.coalesce(c.cast("boolean"), F.lit(False)).alias(k) for k, c in flags.items()]).filter("district IS NOT NULL AND period IS NOT NULL")
    return named.groupBy("district", "period").agg(F.count(F.lit(1)).alias("n_records"), *[F.round(100.0 * F.count_if(k) / F.count(F.lit(1)), 2).alias(f"{k}_rate") for k in flags])


def transitions(df: DataFrame, child: Column, year: Column, flag: Column, tie: Column) -> DataFrame:
    """One row: children seen again and steps improved, worsened, stable, from one visit to the next."""
    rows = df.select(child.alias("c"), year.alias("y"), flag.cast("boolean").alias("f"), tie.alias("t")).filter("c IS NOT NULL AND y IS NOT NULL AND f IS NOT NULL")
    steps = rows.withColumn("was", F.lag("f").over(Window.partitionBy("c").orderBy("y", "t"))).filter("was IS NOT NULL")
    return steps.agg(F.count_distinct("c").alias("n_children"), F.count_if(F.col("was") & ~F.col("f")).alias("improved"), F.count_if(~F.col("was") & F.col("f")).alias("worsened"), F.count_if(F.col("was") == F.col("f")).alias("stable"))


def completeness(df: DataFrame, important: list[str], state: Column, zs: list[str]) -> DataFrame:
    """(state, n, complete, complete_pct, z_complete): rows with every important field."""
    every = lambda cs: reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in cs], F.lit(True))
    out = df.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_if(every(important)).alias("complete"), F.count_if(every(zs)).alias("z_complete"))
    return out.withColumn("complete_pct", pct_of(F.col("complete"), F.col("n")))


def class_pivot(df: DataFrame, geo: Column, label: Column, band: Column) -> DataFrame:
    """(geo, class, under2, under5, total, total_pct): counts by class and age band with a grand total, in one rollup.

    ``total`` counts every row of the group, whatever its age band.
    """
    rows = df.select(geo.alias("geo"), label.alias("class"), band.alias("band")).filter("geo IS NOT NULL AND class IS NOT NULL")
    out = rows.groupingSets([["geo", "class"], ["class"]], "geo", "class").agg(F.count_if(F.col("band") == "Bawah 2 Tahun").alias("under2"), F.count_if(F.col("band") == "Bawah 5 Tahun").alias("under5"), F.count(F.lit(1)).alias("total"), F.grouping("geo").alias("g"))
    out = out.withColumn("geo", F.when(F.col("g") == 1, "Grand Total").otherwise(F.col("geo"))).drop("g")
    return out.withColumn("total_pct", pct_of(F.col("total"), F.sum("total").over(Window.partitionBy("geo"))))


#: Classes that the combined report puts together.
COMBINED = {"kurang_berat_badan_teruk": "kurang_berat_badan", "bantut_teruk": "bantut", "susut_teruk": "susut", "obes": "berlebihan_berat_badan"}


def combined_class(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COMBINED.items() for x in kv]), label), label)


def waterfall(counts: DataFrame, order: list[str], total: int) -> DataFrame:
    """(step, rule, dropped, remaining): what each rule takes, in order. A row per rule."""
    place = F.create_map(*[F.lit(x) for i, r in enumerate(order) for x in (r, i)])
    steps = counts.withColumn("step", F.element_at(place, F.col("rule")))
    return steps.select("step", "rule", F.col("n").alias("dropped"), (F.lit(total) - F.sum("n").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))).alias("remaining"))
