"""Rule sets: what can be switched on for which profile, and the composer of flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A row that ``when`` holds for gets ``code``. A null condition does not hold."""

    code: str
    when: Column


LOCKED = ("dropped_no_bmi", "dropped_null_zscore")
#: Rules of each profile, in order of attribution.
DROP_RULES = {
    "wide_multiyear": ("dropped_invalid_gender", "dropped_date_before_dob", "dropped_age_over5", "dropped_measurement_outlier", "dropped_no_measurement", "dropped_bmi_outlier", "dropped_null_zscore"),
    "wide_registry": ("dropped_invalid_gender", "dropped_pendapatan_x", "dropped_null_dob", "dropped_date_before_dob", "dropped_age_invalid", "dropped_measurement_outlier", "dropped_no_measurement", "dropped_bmi_outlier", "dropped_duplicate_mykid", "dropped_null_zscore"),
    "school_age": ("dropped_ragu_gender", "dropped_invalid_gender", "dropped_duplicate_id", "dropped_invalid_date", "dropped_age_invalid", "dropped_measurement_outlier", "dropped_no_bmi"),
    "general": ("dropped_invalid_gender", "dropped_date_before_dob", "dropped_measurement_outlier", "dropped_no_measurement", "dropped_bmi_outlier", "dropped_null_zscore"),
}
#: Rules that any profile may borrow, if asked for by name.
PORTABLE = ("dropped_date_before_dob", "dropped_age_over5", "dropped_pendapatan_x", "dropped_null_dob", "dropped_duplicate_mykid", "dropped_ragu_gender")
REVIEW_SWITCH = "__reviews_managed"
NEVER_ON = ("review_agensi_unknown", "review_ethnicity_unknown", "review_facility_unknown")
NO_BODY = ("review_class_range_mismatch", "review_daerah_not_in_negeri")


def rule_on(code: str, enabled: set[str] | None, source: str) -> bool:
    """Locked rules always; a profile's own unless left out of a given set; portable ones only if in the set."""
    if code in LOCKED:
        return code in DROP_RULES[source]
    if code in DROP_RULES[source]:
        return enabled is None or code in enabled
    return code in PORTABLE and enabled is not None and code in enabled


def review_on(code: str, enabled: set[str] | None) -> bool:
    """Reviews are on unless the set says that it manages them and leaves them out; some never are."""
    if code in NEVER_ON or code in NO_BODY:
        return False
    return enabled is None or REVIEW_SWITCH not in enabled or code in enabled


def effective_rules(source: str, drops: set[str] | None, saved_reviews: dict[str, bool] | None) -> set[str] | None:
    """A request's drop rules with saved review switches, limited to what the profile knows."""
    if drops is None and not saved_reviews:
        return None
    own = set(DROP_RULES[source]) | set(PORTABLE)
    out = {d for d in (drops if drops is not None else DROP_RULES[source]) if d in own}
    if saved_reviews:
        out |= {REVIEW_SWITCH, *(c for c, on in saved_reviews.items() if on)}
    return out


def codes(rules: list[Rule]) -> Column:
    """The codes of all rules that hold, in order."""
    if not rules:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(r.when, F.lit(r.code)) for r in rules]), lambda c: c.isNotNull())


def joined(c: Column) -> Column:
    return F.array_join(c, "; ")


def rule_counts(flagged: DataFrame, column: str = "drop_codes") -> DataFrame:
    """(rule, n): every excluded row counts for its first rule only."""
    return flagged.filter(F.size(column) > 0).groupBy(F.element_at(column, 1).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


#: Labels for reading; an unknown code is shown as it is.
LABELS = {
    "dropped_invalid_gender": "Unknown gender", "dropped_ragu_gender": "Doubtful gender", "dropped_pendapatan_x": "Income marked X", "dropped_null_dob": "No date of birth", "dropped_date_before_dob": "Measured before birth",
    "dropped_invalid_date": "Measurement date out of range", "dropped_age_over5": "Above the age limit", "dropped_age_invalid": "Age out of range", "dropped_measurement_outlier": "Implausible weight or height",
    "dropped_no_measurement": "No weight and no height", "dropped_bmi_outlier": "Implausible BMI", "dropped_duplicate_mykid": "Repeated identity number", "dropped_duplicate_id": "Repeated student number",
    "dropped_no_bmi": "No BMI", "dropped_null_zscore": "No z-score",
}


def humanise(c: Column, labels: dict[str, str] = LABELS) -> Column:
    """A "; " list of codes as labels."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    parts = F.array_remove(F.split(F.coalesce(c, F.lit("")), r";\s*"), "")
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(table, x), x)), "; ")


def registry(spark, counts: DataFrame, source: str, enabled: set[str] | None) -> DataFrame:
    """Every rule of a profile with its label, count, and whether it fired, is locked, is on."""
    rows = [(i, c, LABELS.get(c, c), c in LOCKED, rule_on(c, enabled, source)) for i, c in enumerate(DROP_RULES[source])]
    table = spark.createDataFrame(rows, "place int, rule string, label string, locked boolean, enabled boolean")
    return table.join(counts, "rule", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).withColumn("fired", F.col("n") > 0)
