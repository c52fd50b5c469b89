"""Review flags: things to look at that never exclude a row. They read the raw values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import id_birth_date, id_gender, validate_id
from ..functions.values import INCOMES, VACCINES, gender_cleaner, is_blank, parse_date, text, try_num
from ..plans.binder import find_col
from ..plans.rules import Rule

PAIRS = (("length_height_cm", "tinggi_cm"), ("weight_kg", "berat_kg"), ("bmi_kg_m2", "bmi"))
AXES = (("waz", "waz_class"), ("haz", "haz_class"), ("baz", "baz_class"))
CLASS_WORDS = (("ind_bantut_zscore", "haz_class", "stunted"), ("ind_obes_zscore", "baz_class", "obese"), ("ind_kurang_berat_zscore", "waz_class", "underweight"), ("ind_susut_zscore", "baz_class", "wasted"))


def any_of(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def id_column(columns: list[str], source: str) -> Column | None:
    """The identity number that a profile's reviews read."""
    patterns = {"wide_multiyear": ["ic no passport", "no kp", "kad pengenalan", "passport"], "wide_registry": ["mykid"]}.get(source)
    found = find_col(columns, patterns) if patterns else None
    return F.col("raw").getField(found) if found else None


def with_id_check(df: DataFrame, columns: list[str], source: str, today: Column) -> DataFrame:
    """Add ``__vid`` and ``__born``, worked out once for all rules that read them."""
    ic = id_column(columns, source)
    if ic is None:
        return df
    if source == "wide_multiyear":
        # Numbers with several rows, counted before the shuffle and joined back; rows without a number are spread over tasks.
        number = F.when(~is_blank(ic), F.trim(text(ic)))
        several = df.select(number.alias("__number")).filter("__number IS NOT NULL").groupBy("__number").agg((F.count(F.lit(1)) > 1).alias("__same")).filter("__same").withColumn("__part", F.lit(0))
        part = F.when(F.col("__number").isNull(), F.pmod(F.xxhash64("_row_id"), F.lit(64)).cast("int")).otherwise(0)
        df = df.withColumn("__number", number).withColumn("__part", part).join(several, ["__number", "__part"], "left").drop("__number", "__part")
    return df.withColumn("__vid", validate_id(ic)).withColumn("__born", id_birth_date(F.col("__vid.cleaned"), today))


def rules(columns: list[str], source: str, ranges: dict, today: Column) -> list[Rule]:
    """The review rules that the columns at hand allow, in order."""
    by_name = {c.lower().replace("-", "_").replace(" ", "_"): c for c in reversed(columns)}
    raw = lambda *names: next((F.col("raw").getField(by_name[n]) for n in names if n in by_name), None)
    like = lambda *patterns: (lambda c: None if c is None else F.col("raw").getField(c))(find_col(columns, list(patterns)))
    spaced = [(c, c.lower().replace("_", " ").replace("-", " ")) for c in columns]
    out: list[Rule] = []
    add = lambda code, when: out.append(Rule(code, when))
    measured, dob, months = F.col("Tarikh_Ukur"), F.col("Tarikh_Lahir"), F.col("Age_Months")
    cap = ranges["infant_age_cap"]["value"]

    add("review_future_measure_date", measured > today)
    ic = like("ic no passport", "no kp", "kad pengenalan", "passport")
    if source == "wide_multiyear" and ic is not None:
        add("review_duplicate_ic", F.col("__same"))
        add("review_ic_gender_mismatch", id_gender(ic) != F.col("Gender"))
    if (name := like("nama", "name")) is not None:
        n = F.concat(F.lit(" "), F.lower(F.trim(text(name))), F.lit(" "))
        says = F.when(n.rlike(" binti | bt | a/p "), "Female").when(n.rlike(" bin | a/l "), "Male")
        add("review_name_gender_mismatch", says != F.col("Gender"))
    genders = [F.col("raw").getField(c) for c, s in spaced if any(k in s for k in ("jantina", "gender", "sex"))]
    if len(genders) > 1:
        add("review_gender_cols_disagree", gender_cleaner(genders[0]) != gender_cleaner(genders[1]))
    year = raw("year") if source == "wide_registry" else like("tahun ukur", "tahun")
    if year is not None:
        add("review_year_mismatch", try_num(year) != F.year(measured))
    dobs = [F.col("raw").getField(c) for c, s in spaced if "tarikh lahir" in s or "date of birth" in s or " dob" in f" {s}" or s.endswith("birth")]
    if len(dobs) > 1:
        add("review_dob_dual_mismatch", parse_date(dobs[0]) != parse_date(dobs[1]))
    if source == "wide_multiyear" and ic is not None:
        v, born = F.col("__vid"), F.col("__born")
        add("review_ic_malformed", ~v["valid"] & (v["type"] != "missing"))
        add("review_ic_dob_mismatch", born != dob)
        add("review_ic_age_contradiction", (F.datediff(measured, born) / 365.25 >= 18) & (months < cap))
    if source == "wide_registry" and like("mykid") is not None:
        v = F.col("__vid")
        add("review_mykid_invalid", ~v["valid"] & (v["type"] != "missing"))
    if source == "wide_multiyear" and (dose := raw("dose_date")) is not None:
        add("review_dose_date_mismatch", parse_date(dose) != measured)
    stated = raw("age_months_computed", "age_months")
    if stated is not None:
        add("review_age_source_mismatch", F.abs(try_num(stated) - months) > 1.0)
    if (band := raw("kategori_umur", "kumpulan_umur")) is not None:
        m = try_num(stated) if stated is not None else months
        expected = F.when(m < 24, "u2").when(m < cap, "u5").when(m.isNotNull(), "o5")
        t = F.replace(F.lower(text(band)), F.lit("-"), F.lit(" "))
        got = F.when(t.rlike("bawah 2|0 2|bawah dua"), "u2").when(t.rlike("bawah 5|2 5|bawah lima"), "u5").when(t.contains("5") & t.contains("atas"), "o5")
        add("review_age_band_mismatch", expected != got)
    if (vaccinated := raw("age_at_vaccination")) is not None:
        add("review_age_vacc_range", ~try_num(vaccinated).between(0, 5))
    if (district := like("daerah", "district")) is not None:
        add("review_daerah_null", is_blank(district))
    if source == "wide_registry" and (division := like("bahagian", "division")) is not None:
        add("review_bahagian_null", is_blank(division))
    lat, lon = raw("latitude", "lat"), raw("longitude", "lon", "long")
    if lat is not None and lon is not None:
        add("review_geo_out_of_bounds", any_of([~try_num(lat).between(ranges["geo_lat"]["min"], ranges["geo_lat"]["max"]), ~try_num(lon).between(ranges["geo_lon"]["min"], ranges["geo_lon"]["max"])]))
    height = raw("tinggi_cm", "tinggi", "height", "panjang", "length", "length_height_cm")
    if height is not None:
        add("review_height_unit_suspect", try_num(height) > ranges["height_unit_suspect"]["value"])
    bmi, weight, tall = raw("bmi", "bmi_kg_m2"), raw("berat_kg", "berat", "weight", "weight_kg"), raw("tinggi_cm", "tinggi", "height", "length_height_cm")
    if bmi is not None and (weight is not None or tall is not None):
        gone = lambda c: F.lit(True) if c is None else try_num(c).isNull()
        add("review_ghost_bmi", try_num(bmi).isNotNull() & (gone(weight) | gone(tall)))
    dual = [F.abs(try_num(raw(a)) - try_num(raw(b))) > 0.01 for a, b in PAIRS if raw(a) is not None and raw(b) is not None]
    if dual:
        add("review_dual_measure_mismatch", any_of(dual))
    ghosts = [try_num(raw(z)).isNull() & ~is_blank(raw(c)) for z, c in AXES if raw(z) is not None and raw(c) is not None]
    if ghosts:
        add("review_ghost_class", any_of(ghosts))
    extreme = [F.abs(try_num(raw(z))) > 6 for z, _ in AXES if raw(z) is not None]
    if extreme:
        add("review_zscore_biv", any_of(extreme))
    contrary = [raw(f).isNotNull() & (F.coalesce(try_num(raw(f)) == 1, F.lit(False)) != F.coalesce(F.lower(text(raw(c))).contains(word), F.lit(False))) for f, c, word in CLASS_WORDS if raw(f) is not None and raw(c) is not None]
    if contrary:
        add("review_indicator_class_mismatch", any_of(contrary))
    if (income := like("pendapatan", "income")) is not None:
        add("review_pendapatan_null", is_blank(income))
        add("review_pendapatan_invalid", ~is_blank(income) & ~F.replace(F.upper(F.trim(text(income))), F.lit(" "), F.lit("")).isin(*INCOMES, "X"))
    if source == "wide_registry":
        if (vaccine := like("vaccine name", "vaksin", "vaccine")) is not None:
            add("review_vaccine_unknown", ~is_blank(vaccine) & ~F.lower(F.trim(text(vaccine))).isin(*VACCINES))
        agency, centre = like("agensi", "agency"), like("nama taska", "taska")
        if agency is not None and centre is not None:
            add("review_taska_blank", ~is_blank(agency) & is_blank(centre))
    return out
