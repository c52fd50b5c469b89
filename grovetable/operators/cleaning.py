"""Flag-then-filter cleaners. No row is ever deleted: rows get drop codes, review codes and ``analyzable``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import growth
from ..functions.values import age_band, gender_cleaner, months_of_days, parse_date, text, try_num
from ..plans import ranges as R
from ..plans.binder import find_col
from ..plans.rules import DROP_RULES, Rule, codes, joined, review_on, rule_on
from . import review
from .quantiles import percentiles
from .rows import in_file_order

#: Header patterns of each role.
ROLES = {
    "gender": ("jantina", "gender", "sex"),
    "dob": ("tarikh lahir", "dob", "date of birth", "birth"),
    "weight": ("berat kg", "berat", "weight"),
    "height": ("tinggi cm", "tinggi", "panjang", "height", "length"),
    "date": ("tarikh antropometri", "tarikh ukur", "tarikh pengukuran", "pengukuran", "measurement date", "assessment date", "dose date"),
    "income": ("pendapatan", "income"),
    "age": ("age months", "umur bulan", "age", "umur"),
}
ID_ROLES = {"wide_registry": ("mykid", "no. mykid", "ic"), "school_age": ("id murid", "student id", "id"), "wide_multiyear": ("mykid",), "general": ("mykid",)}


@dataclass
class Binding:
    """Columns by role. Roles left out are looked for in the headers."""

    columns: list[str]
    source: str
    given: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.columns = [c for c in self.columns if c != "_row_id"]

    def __getitem__(self, role: str) -> str | None:
        if role in self.given:
            return self.given[role]
        return find_col(self.columns, list(ID_ROLES[self.source] if role == "id" else ROLES[role]))

    def col(self, role: str) -> Column:
        c = self[role]
        return F.col(f"`{c}`") if c else F.lit(None)


def with_row_id(df: DataFrame) -> DataFrame:
    """Add ``_row_id``, once; a frame that has one keeps it. Rows from Parquet are numbered in file order, whatever the splits.

    Other frames take the order of their partitions; ``rows.number_rows``, which writes them once, gives theirs a lasting order.
    """
    if "_row_id" in df.columns:
        return df
    placed = in_file_order(df)
    return placed if placed is not None else df.withColumn("_row_id", F.monotonically_increasing_id())


def _prepared(df: DataFrame, b: Binding) -> DataFrame:
    """Typed columns beside the raw ones; the raw ones are kept in the struct ``raw``."""
    raw = with_row_id(df)
    keep = [c for c in raw.columns if c not in ("_row_id", "raw")]
    kinds = dict(df.dtypes)

    def date(role: str) -> Column:
        """A column that is a date already needs no reading."""
        return F.to_date(b.col(role)) if kinds.get(b[role] or "", "").startswith(("date", "timestamp")) else parse_date(b.col(role))

    typed = raw.select(
        "_row_id",
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("raw"),
        (gender_cleaner(b.col("gender")) if b["gender"] else F.lit(None).cast("string")).alias("Gender"),
        F.upper(F.trim(text(b.col("gender")))).alias("__gender"),
        F.upper(F.trim(text(b.col("income")))).alias("__income"),
        date("dob").alias("Tarikh_Lahir"),
        date("date").alias("Tarikh_Ukur"),
        try_num(b.col("weight")).alias("Berat_kg"),
        try_num(b.col("height")).alias("Tinggi_cm"),
        text(b.col("id")).alias("__id"),
        (try_num(b.col("age")) if b["age"] else F.lit(None).cast("double")).alias("__age"),
    )
    days = F.datediff("Tarikh_Ukur", "Tarikh_Lahir")
    return typed.withColumn("Age_Days", days).withColumn("Age_Months", months_of_days(days)).withColumn("BMI", growth.bmi_of(F.col("Berat_kg"), F.col("Tinggi_cm")))


def outside(c: Column, low: float, high: float) -> Column:
    return c.isNotNull() & ~c.between(low, high)


#: Rules that look at all rows of an identity number.
ID_RULES = ("dropped_duplicate_mykid", "dropped_duplicate_id", "review_mykid_shared_placeholder")
#: Tasks that the rows without a number are spread over.
SPREAD = 64


def with_id_sums(frame: DataFrame) -> DataFrame:
    """Add ``__ids`` of every row's number: how many rows it has, whether their birth dates differ, the latest and the first row.

    Sums are made before the shuffle and joined back. Rows without a number go to SPREAD tasks, each with the sums of all of them,
    and a join that is still uneven can be split.
    """
    latest = F.min(F.struct(F.col("Tarikh_Ukur").isNull().alias("u"), (-F.unix_date("Tarikh_Ukur")).alias("d"), F.col("_row_id").alias("r")))["r"]
    sums = F.struct(F.count(F.lit(1)).alias("n"), (F.min("Tarikh_Lahir") != F.max("Tarikh_Lahir")).alias("dobs"), latest.alias("latest"), F.min("_row_id").alias("first"))
    blank = F.col("__id").isNull() | (F.trim("__id") == "")
    per = frame.groupBy("__id").agg(sums.alias("__ids")).select(F.col("__id").alias("__key"), "__ids", F.explode(F.when(blank, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))).alias("__to"))
    spread = frame.withColumn("__part", F.when(blank, F.pmod(F.xxhash64("_row_id"), F.lit(SPREAD)).cast("int")).otherwise(0))
    return spread.join(per, F.col("__id").eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__to")), "left").drop("__key", "__part", "__to")


def drop_conditions(b: Binding, profile: R.Profile, ranges: dict, as_of: Column) -> dict[str, Column]:
    """The condition of every drop rule on a prepared frame, but for the z-score one."""
    cap = ranges["infant_age_cap"]["value"]
    w, h, months, days = (F.col(c) for c in ("Berat_kg", "Tinggi_cm", "Age_Months", "Age_Days"))
    no_id = F.col("__id").isNull() | (F.trim("__id") == "")
    several, one_dob = F.col("__ids.n") > 1, F.col("__ids.dobs").isNull() | ~F.col("__ids.dobs")
    later_copy = ~no_id & several & one_dob & (F.col("_row_id") != F.col("__ids.latest"))
    years = F.bround(days / F.lit(365.25), 1)
    low, high = R.bounds(ranges, "school_age_years")
    school = b.source == "school_age"
    return {
        "dropped_invalid_gender": F.col("Gender").isNull() if b["gender"] else F.lit(False),
        "dropped_ragu_gender": F.col("__gender") == "RAGU",
        "dropped_pendapatan_x": F.col("__income") == "X",
        "dropped_null_dob": F.col("Tarikh_Lahir").isNull() if b["dob"] else F.lit(False),
        "dropped_date_before_dob": F.col("Tarikh_Ukur") < F.col("Tarikh_Lahir"),
        "dropped_invalid_date": (F.col("Tarikh_Ukur") > as_of) | (F.col("Tarikh_Ukur") < F.col("Tarikh_Lahir")),
        "dropped_age_over5": months >= cap,
        "dropped_age_invalid": (years < low) | (years > high) if school else (days < 0) | (months >= cap),
        "dropped_measurement_outlier": outside(w, *profile.weight) | outside(h, *profile.height),
        "dropped_no_measurement": w.isNull() & h.isNull(),
        "dropped_bmi_outlier": F.col("BMI") > ranges["bmi_max"]["value"],
        "dropped_duplicate_mykid": later_copy if b["id"] else F.lit(False),
        "dropped_duplicate_id": (F.col("_row_id") != F.col("__ids.first")) if b["id"] else F.lit(False),
        "dropped_no_bmi": F.col("BMI").isNull(),
        "review_mykid_shared_placeholder": ~no_id & several & ~one_dob,
    }


def clean(
    df: DataFrame,
    source: str,
    lms: DataFrame | None = None,
    enabled: set[str] | None = None,
    overrides: dict | None = None,
    roles: dict[str, str] | None = None,
    as_of: str | None = None,
    profile: R.Profile | None = None,
    reviews: bool = True,
    zscores: bool = True,
) -> DataFrame:
    """Flag every row of a long table under one profile.

    Adds typed columns, drop_codes (array), analyzable, exclude_reason, review_reason; the input columns are in ``raw``.
    Z-scores are worked out for rows that no earlier rule excludes; a row without all three gets
    dropped_null_zscore. ``as_of`` fixes today's date. Without ``zscores`` no z-score is worked out and that rule is left out.
    """
    ranges = R.merged(overrides)
    b = Binding(df.columns, source, roles or {})
    today = F.to_date(F.lit(as_of)) if as_of else F.current_date()
    profile = profile or R.cohort("school" if source == "school_age" else "infant", overrides)
    frame = _prepared(df, b)
    when = drop_conditions(b, profile, ranges, today)
    order = [c for c in DROP_RULES[source] if c != "dropped_null_zscore"]
    order = [c for c in [*order, *[p for p in when if p not in order and p.startswith("dropped")]] if rule_on(c, enabled, source)]
    if b["id"] and any(c in ID_RULES for c in order):
        frame = with_id_sums(frame)
    first = frame.withColumn("drop_codes", codes([Rule(c, when[c]) for c in order]))
    shared = when["review_mykid_shared_placeholder"] if "dropped_duplicate_mykid" in order and b["id"] else F.lit(False)
    first = first.withColumn("__shared", F.coalesce(shared, F.lit(False)))
    if source == "school_age":
        category = growth.school_bmi_category(F.col("BMI"))
        out = first.withColumn("BMI_Category", category)
        for name, label in (("Ind_Kurus", "Kurus"), ("Ind_Normal", "Normal"), ("Ind_Berlebihan", "Berlebihan Berat Badan"), ("Ind_Obes", "Obesiti")):
            out = out.withColumn(name, growth.flag(F.col("BMI_Category") == label))
    elif not zscores:
        out = first
    else:
        table = lms if lms is not None else growth.knot_table(df.sparkSession)
        out = growth.add_zscores(first, table, F.col("Gender"), F.col("Age_Days"), F.col("Berat_kg"), F.col("Tinggi_cm"), F.col("BMI"), where=(F.size("drop_codes") == 0) & F.col("Gender").isNotNull())
        if rule_on("dropped_null_zscore", enabled, source):
            none = F.col("WAZ").isNull() | F.col("HAZ").isNull() | F.col("BAZ").isNull()
            out = out.withColumn("drop_codes", F.when(none, F.array_append("drop_codes", F.lit("dropped_null_zscore"))).otherwise(F.col("drop_codes")))
        for z in growth.INDICATORS:
            out = out.withColumn(f"{z}_Status", growth.classify(F.col(z), z))
        for name, c in growth.indicator_flags(F.col("WAZ"), F.col("HAZ"), F.col("BAZ")).items():
            out = out.withColumn(name, c)
        out = out.withColumn("Kategori_Umur", age_band(F.col("Age_Days")))
    rules = []
    if reviews and source != "school_age":
        out = review.with_id_check(out, b.columns, source, today)
        rules = [r for r in review.rules(b.columns, source, ranges, today) if review_on(r.code, enabled)]
        rules.append(Rule("review_mykid_shared_placeholder", F.col("__shared")))
    out = out.withColumn("review_codes", codes(rules))
    return out.withColumn("analyzable", F.size("drop_codes") == 0).withColumn("exclude_reason", joined(F.col("drop_codes"))).withColumn("review_reason", joined(F.col("review_codes"))).drop("__gender", "__income", "__id", "__age", "__shared", "__vid", "__born", "__same", "__ids")


def clean_wide_multiyear(df: DataFrame, **options) -> DataFrame:
    return clean(df, "wide_multiyear", **options)


def clean_wide_registry(df: DataFrame, **options) -> DataFrame:
    """Reshape a year-prefixed table, then clean it."""
    from .reshape import registry_to_long

    long = registry_to_long(df)
    return clean(long, "wide_registry", **({"roles": {"weight": "Berat", "height": "Tinggi", "date": "Tarikh"}} | options))


def clean_school_age(df: DataFrame, **options) -> DataFrame:
    return clean(df, "school_age", **options)


def infer_cohort(df: DataFrame, overrides: dict | None = None, roles: dict[str, str] | None = None) -> dict:
    """The cohort by median age: infant below the age cap, school above, none without ages.

    Ages come from dates, else from an age column; an age column with a median of 18 or less is in years.
    """
    ranges = R.merged(overrides)
    b = Binding(df.columns, "general", roles or {})
    ages = _prepared(df, b).select(F.explode(F.array(F.struct(F.lit("dated").alias("column"), F.col("Age_Months").cast("double").alias("x")), F.struct(F.lit("stated").alias("column"), F.col("__age").alias("x")))).alias("v")).select("v.*")
    medians = {c: p[0] for c, (_, p) in percentiles(ages, (0.5,)).items()}
    assumptions, median, stated = [], medians.get("dated"), medians.get("stated")
    if median is None and stated is not None:
        years = stated <= 18
        assumptions.append(f"age column read as {'years' if years else 'months'}")
        median = stated * (12 if years else 1)
    name = None if median is None else "infant" if median < ranges["infant_age_cap"]["value"] else "school"
    return {"cohort": name, "median_age_months": median, "assumptions": assumptions}


def clean_general(df: DataFrame, **options) -> tuple[DataFrame, dict]:
    """Clean a table of unknown origin and say what could be done with it: coverage, assumptions, indicators."""
    roles, overrides = options.get("roles"), options.get("overrides")
    b = Binding(df.columns, "general", roles or {})
    found = infer_cohort(df, overrides, roles)
    none = R.Profile("none", (float("-inf"), float("inf")), (float("-inf"), float("inf")))
    profile = R.cohort(found["cohort"], overrides) if found["cohort"] else none
    enabled = options.get("enabled")
    if not (b["gender"] and b["dob"] and b["date"]) or found["cohort"] == "school":
        cleaned = clean(df, "general", **(options | {"profile": profile, "enabled": enabled}))
        last = F.try_element_at("drop_codes", F.lit(-1)) == "dropped_null_zscore"
        kept = F.when(last, F.slice("drop_codes", 1, F.greatest(F.size("drop_codes") - 1, F.lit(0)))).otherwise(F.col("drop_codes"))
        cleaned = cleaned.withColumn("drop_codes", kept).withColumn("analyzable", F.size("drop_codes") == 0).withColumn("exclude_reason", joined(F.col("drop_codes")))
        indicators = ["bmi"] if b["weight"] and b["height"] else []
    else:
        cleaned, indicators = clean(df, "general", **(options | {"profile": profile})), ["waz", "haz", "baz", "bmi"]
    return cleaned, found | {"coverage": {r: b[r] for r in ("gender", "dob", "weight", "height", "date", "id")}, "indicators_available": indicators}


def clean_data(df: DataFrame, source: str, **options) -> DataFrame:
    """The cleaner of a profile."""
    from ..plans.binder import ALIASES

    source = ALIASES.get(source, source)
    if source == "general":
        return clean_general(df, **options)[0]
    return {"wide_multiyear": clean_wide_multiyear, "wide_registry": clean_wide_registry, "school_age": clean_school_age}[source](df, **options)


def recommend_rules(df: DataFrame, source: str = "general", roles: dict[str, str] | None = None, as_of: str | None = None) -> DataFrame:
    """(rule, n) of portable rules that would fire on the raw table, most first."""
    from ..plans.rules import PORTABLE

    b = Binding(df.columns, source, roles or {})
    today = F.to_date(F.lit(as_of)) if as_of else F.current_date()
    when = drop_conditions(b, R.cohort("infant"), R.merged(), today)
    frame = _prepared(df, b)
    flagged = (with_id_sums(frame) if b["id"] else frame).select(*[F.coalesce(when[c], F.lit(False)).alias(c) for c in PORTABLE])
    counts = flagged.agg(*[F.count_if(c).alias(c) for c in PORTABLE])
    return counts.unpivot([], list(PORTABLE), "rule", "n").filter("n > 0").orderBy(F.desc("n"), "rule")


def preview_impact(df: DataFrame, source: str, **options) -> DataFrame:
    """One row: rows before and after, without keeping anything."""
    return clean(df, source, reviews=False, **options).agg(F.count(F.lit(1)).alias("rows_before"), F.count_if("analyzable").alias("rows_after"))


def preview_rules(df: DataFrame, source: str, **options) -> DataFrame:
    """(rule, n_first, n_any) of rules that would fire: rows that a rule is the first to exclude, and rows that it holds for at all."""
    fired = clean(df, source, reviews=False, **options).select(F.posexplode_outer("drop_codes").alias("place", "rule")).filter("rule IS NOT NULL")  # a plain explode would work out all codes once more for a filter
    return fired.groupBy("rule").agg(F.count_if(F.col("place") == 0).alias("n_first"), F.count(F.lit(1)).alias("n_any"))


def run_stats(cleaned: DataFrame) -> DataFrame:
    """One row of run statistics: totals, genders, indicators, over analyzable rows where they describe children."""
    ok = F.col("analyzable")
    flags = [c for c in cleaned.columns if c.startswith("Ind_")]
    return cleaned.agg(
        F.count(F.lit(1)).alias("original_count"), F.count_if(ok).alias("final_count"), F.count_if(~ok).alias("total_dropped"), F.count_if(F.size("review_codes") > 0).alias("review_count"),
        F.count_if(ok & (F.col("Gender") == "Male")).alias("male"), F.count_if(ok & (F.col("Gender") == "Female")).alias("female"), *[F.count_if(ok & F.col(c)).alias(c.lower()) for c in flags],
    )


def summary(cleaned: DataFrame) -> dict:
    """Score (share of rows that survive) and the five most frequent issues with their severity."""
    from ..plans.rules import rule_counts

    row = cleaned.agg(F.count(F.lit(1)).alias("n"), F.count_if("analyzable").alias("ok")).first()
    top = rule_counts(cleaned).orderBy(F.desc("n"), "rule").limit(5).collect()
    pct = lambda n: round(100.0 * n / row["n"], 2) if row["n"] else 0.0
    issues = [{"rule": r["rule"], "count": r["n"], "pct": pct(r["n"]), "severity": "critical" if pct(r["n"]) >= 10 else "warning" if pct(r["n"]) >= 1 else "info"} for r in top]
    return {"score": pct(row["ok"]), "issues": issues}
