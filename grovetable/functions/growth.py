"""Growth z-scores from an LMS table, classes and indicator flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lms import KNOT_MONTHS, KNOTS
from .values import try_num

INDICATORS = ("WAZ", "HAZ", "BAZ")
BOUNDS = {"WAZ": (-6.0, 5.0), "HAZ": (-6.0, 6.0), "BAZ": (-5.0, 5.0)}
CAP = 6.0


def knot_table(spark: SparkSession, step: int = 1) -> DataFrame:
    """(sex, day, waz_l, waz_m, waz_s, ...): the monthly values, interpolated to every ``step`` days up to 120 months.

    A full daily table can be read with ``sources.tables.read_lms`` instead.
    """
    days = [round(m * 30.4375) for m in KNOT_MONTHS]
    knots = [(s, a, b, *[x for i in INDICATORS for k in range(3) for x in (float(KNOTS[s, i][n][k]), float(KNOTS[s, i][n + 1][k]))]) for s in "MF" for n, (a, b) in enumerate(zip(days, days[1:]))]
    names = ["sex", "a", "b"] + [f"{i.lower()}_{k}{e}" for i in INDICATORS for k in "lms" for e in "01"]
    t = spark.createDataFrame(knots, names)
    last = F.lit(days[-1])
    t = t.withColumn("day", F.explode(F.sequence(F.col("a"), F.when(F.col("b") == last, F.col("b")).otherwise(F.col("b") - 1), F.lit(step))))
    at = (F.col("day") - F.col("a")) / (F.col("b") - F.col("a"))
    return t.select("sex", F.col("day").cast("int").alias("day"), *[(F.col(f"{i.lower()}_{k}0") + at * (F.col(f"{i.lower()}_{k}1") - F.col(f"{i.lower()}_{k}0"))).alias(f"{i.lower()}_{k}") for i in INDICATORS for k in "lms"])


def pivot_lms(lms: DataFrame) -> DataFrame:
    """(sex, indicator, day, L, M, S) to one row per sex and day."""
    return lms.groupBy("sex", F.col("day").cast("int").alias("day")).agg(*[F.first(F.when(F.col("indicator") == i, F.col(k.upper())), True).alias(f"{i.lower()}_{k}") for i in INDICATORS for k in "lms"])


def sex_key(c: Column) -> Column:
    """M for the known male labels, F for anything else."""
    return F.when(F.upper(F.trim(c.cast("string"))).isin("M", "MALE", "LELAKI", "1"), "M").otherwise("F")


def z_of(x: Column, l: Column, m: Column, s: Column, cap: float | None = CAP, digits: int = 3) -> Column:  # noqa: E741
    """The z-score, null where it is beyond ``cap`` or cannot be worked out."""
    r = F.try_divide(x, m)
    z = F.when(F.abs(l) < 1e-6, F.try_divide(F.ln(r), s)).otherwise(F.try_divide(F.pow(r, l) - 1, l * s))
    z = F.when((x > 0) & ~F.isnan(z) & (F.abs(z) < float("inf")), z)
    return F.bround(F.when(F.abs(z) <= cap, z) if cap is not None else z, digits)


def add_zscores(df: DataFrame, lms: DataFrame, sex: Column, days: Column, weight: Column, height: Column, bmi: Column, where: Column | None = None, mode: str = "cleaner") -> DataFrame:
    """Add WAZ, HAZ and BAZ in one broadcast join on (sex, day).

    The LMS table has a fixed number of days per sex, so it is broadcast. ``cleaner``: day clamped to the
    table, cap, biologically implausible values null, rounded to 3 then 2 digits. ``profile``: rounded to 3 only. ``daily``:
    out of table null, no cap, 4 digits. ``monthly``: day of the rounded month, clamped to the table.
    """
    last = lms.agg(F.max("day")).scalar()
    day = F.bround(days.cast("double"), 0).cast("int")
    if mode == "monthly":
        day = F.bround(F.bround(days / 30.4375, 0) * 30.4375, 0).cast("int")
    if mode in ("cleaner", "profile", "monthly"):
        day = F.when(day.isNotNull(), F.greatest(F.lit(0), F.least(last, day)))
    keyed = df.withColumn("__sex", sex_key(sex)).withColumn("__day", F.when(where, day) if where is not None else day)
    joined = keyed.join(F.broadcast(lms.withColumnRenamed("sex", "__sex").withColumnRenamed("day", "__day")), ["__sex", "__day"], "left")
    for i, x in zip(INDICATORS, (weight, height, bmi)):
        l, m, s = (F.col(f"{i.lower()}_{k}") for k in "lms")  # noqa: E741
        z = z_of(x, l, m, s, None if mode == "daily" else CAP, 4 if mode == "daily" else 3)
        if mode == "cleaner":
            z = F.bround(F.when(z.between(*BOUNDS[i]), z), 2)
        joined = joined.withColumn(i, z)
    return joined.drop("__sex", "__day", *[f"{i.lower()}_{k}" for i in INDICATORS for k in "lms"])


#: Class names by upper bound.
CLASSES = {
    "WAZ": (("kurang_berat_badan_teruk", "kurang_berat_badan", "risiko_kurang_berat_badan"), ((2, "berat_badan_normal"),), "mungkin_masalah_pertumbuhan"),
    "HAZ": (("bantut_teruk", "bantut", "risiko_bantut"), ((3, "normal"),), "mungkin_masalah_endokrin"),
    "BAZ": (("susut_teruk", "susut", "berisiko_susut"), ((1, "normal"), (2, "risiko_lebih_berat_badan"), (3, "berlebihan_berat_badan")), "obes"),
}


def classify(z: Column, indicator: str) -> Column:
    below, upto, above = CLASSES[indicator]
    out = F.when(z.isNull(), None)
    for limit, label in zip((-3, -2, -1), below):
        out = out.when(z < limit, label)
    for limit, label in upto:
        out = out.when(z <= limit, label)
    return out.otherwise(above)


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def indicator_flags(waz: Column, haz: Column, baz: Column) -> dict[str, Column]:
    """The cleaner's flags; null is not affected."""
    under, stunted, wasted = flag(waz < -2), flag(haz < -2), flag(baz < -2)
    return {"Ind_KurangBerat": under, "Ind_Bantut": stunted, "Ind_Susut": wasted, "Ind_Berlebihan": flag(baz > 1), "Ind_Obes": flag(baz > 2), "Ind_Normal": ~(under | stunted | wasted)}


def implausible(z: Column, indicator: str) -> Column:
    """Outside the biological bounds."""
    return flag(~z.between(*BOUNDS[indicator]))


#: Source labels and the class that they stand for.
LABEL_CLASS = {
    "WAZ": {"normal": "berat_badan_normal", "kurang berat badan": "kurang_berat_badan", "sangat kurang berat badan": "kurang_berat_badan_teruk"},
    "HAZ": {"tinggi normal": "normal", "normal": "normal", "bantut": "bantut", "bantut teruk": "bantut_teruk"},
    "BAZ": {"berat badan normal": "normal", "normal": "normal", "susut": "susut", "susut teruk": "susut_teruk", "risiko berlebihan berat badan": "risiko_lebih_berat_badan", "berlebihan berat badan": "berlebihan_berat_badan", "obes": "obes"},
}


def label_mismatch(label: Column, z_class: Column, indicator: str) -> Column:
    """A known label that says another class than the z-score; an unknown label never does."""
    from .values import lookup

    want = lookup(F.lower(F.trim(label.cast("string"))), LABEL_CLASS[indicator])
    return flag(want.isNotNull() & z_class.isNotNull() & (want != z_class))


def mismatch_report(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(indicator, n, mismatches, pct, severity) for {indicator: (label column, class column)}."""
    rows = [df.select(F.lit(i).alias("indicator"), F.col(c).isNotNull().alias("has"), label_mismatch(F.col(a), F.col(c), i).alias("bad")) for i, (a, c) in pairs.items()]
    out = reduce(DataFrame.unionByName, rows).groupBy("indicator").agg(F.count_if("has").alias("n"), F.count_if("bad").alias("mismatches"))
    pct = F.round(F.coalesce(F.try_divide(100.0 * F.col("mismatches"), F.col("n")), F.lit(0.0)), 2)
    return out.withColumn("pct", pct).withColumn("severity", F.when(F.col("pct") > 10, "high").otherwise("low"))


def bmi_of(weight: Column, height: Column) -> Column:
    return F.bround(F.when(height > 0, F.try_divide(weight, F.pow(height / 100, F.lit(2)))), 2)


def school_bmi_category(bmi: Column) -> Column:
    return F.when(bmi.isNull(), None).when(bmi < 13.5, "Kurus").when(bmi < 16.5, "Normal").when(bmi < 18.5, "Berlebihan Berat Badan").otherwise("Obesiti")


def deficit(z: Column) -> Column:
    """0 above -2, then linear: a half at -3, one at -4 and below."""
    return F.when(z.isNull() | (z > -2), 0.0).when(z > -3, (-2 - z) / 2).otherwise(0.5 + 0.5 * F.least(F.greatest(-3 - z, F.lit(0.0)), F.lit(1.0)))


def excess(z: Column) -> Column:
    return F.when(z.isNull() | (z < 1), 0.0).when(z < 2, (z - 1) / 2).otherwise(0.5 + 0.5 * F.least(F.greatest(z - 2, F.lit(0.0)), F.lit(1.0)))
