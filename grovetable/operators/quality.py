"""Quality score, business rules, BMI consistency and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import text
from ..plans import ranges as R
from .profile import pct_of


def bmi_consistency(df: DataFrame, weight: Column, height: Column, bmi: Column, threshold: float = 0.5) -> DataFrame:
    """One row: checked, mismatches, pct, severity of stored against recomputed BMI."""
    calc = F.try_divide(weight, F.pow(height / 100, F.lit(2)))
    rows = df.select(F.when(height > 0, F.abs(calc - bmi)).alias("d"))
    out = rows.agg(F.count("d").alias("checked"), F.count_if(F.col("d") > threshold).alias("mismatches"))
    pct = pct_of(F.col("mismatches"), F.col("checked"))
    return out.withColumn("pct", pct).withColumn("severity", F.when(pct > 20, "high").when(pct > 5, "medium").otherwise("low"))


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").otherwise("D")


def quality_score(df: DataFrame, *, mapped: int, id_valid: Column | None, critical: list[Column], duplicate_key: list[Column], bmi_off: Column | None, spelling_issues: int, zs: list[Column] | None, core: int = 11) -> DataFrame:
    """One row: the seven parts, score and grade, in one aggregate.

    ``bmi_off``: null where it cannot be checked. A missing part scores as the product does: no id column 0, no critical columns 0,
    unchecked BMI 10, no z-scores 0.
    """
    n = F.count(F.lit(1))
    missing = [100.0 * F.count_if(c.isNull()) / n for c in critical]
    aggs = [n.alias("n")]
    aggs.append((100.0 * F.count_if(F.coalesce(id_valid, F.lit(False))) / n if id_valid is not None else F.lit(0.0)).alias("valid_pct"))
    mean = sum(missing[1:], missing[0]) / len(missing) if missing else F.lit(None).cast("double")
    aggs.append(mean.alias("missing_pct"))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(duplicate_key)])
    aggs.append((100.0 * (n - F.count_distinct(key)) / n if duplicate_key else F.lit(0.0)).alias("dup_pct"))
    aggs.append((F.coalesce(100.0 * F.count_if(bmi_off) / F.nullif(F.count(bmi_off), F.lit(0)), F.lit(0.0)) if bmi_off is not None else F.lit(0.0)).alias("off_pct"))
    if zs:
        all_z = zs[0].isNotNull()
        for z in zs[1:]:
            all_z = all_z & z.isNotNull()
        aggs.append((100.0 * F.count_if(all_z) / n).alias("z_pct"))
    else:
        aggs.append(F.lit(0.0).alias("z_pct"))
    one = df.agg(*aggs)
    floor = lambda c: F.round(F.greatest(F.lit(0.0), c), 1)
    parts = {
        "coverage": F.round(F.lit(20.0 * mapped / core), 1), "ids": F.round(F.col("valid_pct") * 0.15, 1), "missing": F.coalesce(floor(20 - 0.4 * F.col("missing_pct")), F.lit(0.0)), "duplicates": floor(15 - 1.5 * F.col("dup_pct")),
        "bmi": floor(10 - 0.3 * F.col("off_pct")), "spelling": F.round(F.lit(max(0.0, 5 - 0.5 * spelling_issues)), 1), "z_coverage": F.round(F.col("z_pct") * 0.15, 1),
    }
    out = one.select("n", *[c.alias(k) for k, c in parts.items()])
    total = sum((F.col(k) for k in list(parts)[1:]), F.col("coverage"))
    return out.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 1)).withColumn("grade", grade(F.col("score")))


def _rule_tests(measured: Column, weight: Column, height: Column, gender: Column, dob: Column, year_level: Column | None, id_text: Column | None, as_of: str) -> dict[str, tuple[Column, str]]:
    """The condition and severity of every rule that a row's own values decide: all but BR-04."""
    b = lambda k: R.bounds(R.RANGES, k)
    today = F.to_date(F.lit(as_of))
    oldest = F.make_date(F.year(today) - int(R.RANGES["rule_age_years"]["value"]), F.lit(1), F.lit(1))
    latest = F.make_date(F.year(today), F.lit(12), F.lit(31))
    digits = F.regexp_replace(F.coalesce(text(id_text), F.lit("")) if id_text is not None else F.lit(""), "^[A-Za-z]", "")
    coded = F.try_to_date(F.substring(digits, 1, 8), "ddMMyyyy")
    return {
        "BR-01": (measured.isNull(), "WARNING"), "BR-02": (~weight.between(*b("rule_weight")), "ERROR"), "BR-03": (~height.between(*b("rule_height")), "ERROR"),
        "BR-05": (~F.coalesce(F.lower(F.trim(text(gender))).isin("male", "female", "lelaki", "perempuan", "m", "f", "l", "p"), F.lit(False)), "WARNING"),
        "BR-06": (~F.coalesce(year_level.between(*b("rule_year_level")), F.lit(False)) if year_level is not None else F.lit(False), "INFO"), "BR-07": (coded != dob, "INFO"), "BR-08": (weight.isNull() & height.isNull(), "WARNING"),
        "BR-09": ((measured < oldest) | (measured > latest) | (dob < oldest) | (dob > latest), "ERROR"),
    }


def rule_samples(df: DataFrame, order: list[str], *, child: Column, as_of: str, most: int = 100, most_children: int = 1_000, **columns) -> DataFrame:
    """(rule, place, order columns): the first rows that each business rule fires on, in ``order``; BR-04 by child first, and more of them.

    Columns are named as for ``business_rules``. Places are limited in every task before a rule's rows come together; children
    with several rows are found by a count that is joined back, and rows without a child are left out of it.
    """
    tests = _rule_tests(columns["measured"], columns["weight"], columns["height"], columns["gender"], columns["dob"], columns.get("year_level"), columns.get("id_text"), as_of)
    own = df.select(*order, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, (c, _) in tests.items()]))).alias("rule"))
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy(*order))).filter(F.col("place") <= most)
    named = df.select(child.alias("__child"), *order).filter("__child IS NOT NULL")
    several = named.groupBy("__child").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__child")
    shared = named.join(several, "__child").withColumn("rule", F.lit("BR-04")).withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy("__child", *order))).filter(F.col("place") <= most_children)
    return first.select("rule", "place", *order).unionByName(shared.select("rule", "place", *order))


def business_rules(df: DataFrame, *, measured: Column, weight: Column, height: Column, child: Column, gender: Column, dob: Column, year_level: Column | None = None, id_text: Column | None = None, as_of: str) -> DataFrame:
    """(rule, n, pct, severity) for BR-01 to BR-09: one aggregate over rows, and one over counts by child for BR-04."""
    tests = _rule_tests(measured, weight, height, gender, dob, year_level, id_text, as_of)
    names = sorted([*tests, "BR-04"])
    severities = {k: v for k, (_, v) in tests.items()} | {"BR-04": "WARNING"}
    rows = df.select(*[F.coalesce(c, F.lit(False)).alias(k) for k, (c, _) in tests.items()])
    own = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{k}`")).alias(k) for k in tests])
    children = df.select(child.alias("c")).filter("c IS NOT NULL").groupBy("c").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("BR-04"))
    both = own.unionByName(children, allowMissingColumns=True)
    counts = both.agg(F.max("rows").alias("rows"), *[F.max(f"`{k}`").alias(k) for k in names])
    out = counts.select("rows", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("n"), F.lit(severities[k]).alias("severity")) for k in names])).alias("v")).select("rows", "v.*")
    severity = F.when((F.col("rule") == "BR-01") & (F.col("n") == F.col("rows")) & (F.col("rows") > 0), "CRITICAL").otherwise(F.col("severity"))
    return out.select("rule", "n", F.when(F.col("rule") == "BR-07", 0.0).otherwise(pct_of(F.col("n"), F.col("rows"))).alias("pct"), severity.alias("severity"))


def findings(rules: DataFrame, k: int = 6) -> DataFrame:
    """The k most pressing rules that fired: by severity, then count."""
    rank = F.when(F.col("severity").isin("CRITICAL", "ERROR"), 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return rules.filter("n > 0").orderBy(rank, F.desc("n"), "rule").limit(k)


def duplicate_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, repeats over the key columns (nulls are equal), pct."""
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*[F.col(k) for k in key])).alias("u"))
    return out.select("n", (F.col("n") - F.col("u")).alias("duplicates"), pct_of(F.col("n") - F.col("u"), F.col("n")).alias("pct"))


def dashboard(datasets: DataFrame) -> DataFrame:
    """One row over (dataset_id, created_at, n_rows, score, source): totals, mean score, alerts, latest. A null or zero score counts as 100."""
    shown = F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(100.0))
    return datasets.agg(F.count(F.lit(1)).alias("datasets"), F.sum("n_rows").alias("total_rows"), F.round(F.avg("score"), 2).alias("mean_score"), F.count_if(shown < 60).alias("alerts"), F.max_by("dataset_id", F.struct("created_at", "dataset_id")).alias("latest"))


def fill_nulls(df: DataFrame, important: list[str], optional: list[str]) -> DataFrame:
    """Important text becomes UNKNOWN, optional text ``tiada data``; ``<column>_was_null`` remembers."""
    for c, word in [(c, "UNKNOWN") for c in important] + [(c, "tiada data") for c in optional]:
        df = df.withColumn(f"{c}_was_null", F.col(c).isNull()).withColumn(c, F.coalesce(text(F.col(c)), F.lit(word)))
    return df
