"""Every review code on a row that it is meant for, beside a row that it is not."""

import pytest
from pyspark.sql import functions as F

from grovetable.functions import growth, values
from grovetable.operators import cleaning, explore, joins, linkage, quality
from grovetable.plans import rules

REGISTRY = {"jantina": "L", "tarikh lahir": "2021-01-01", "tarikh": "2023-01-01", "berat": "12.0", "tinggi": "85.0"}
MULTI = {"jantina": "L", "tarikh lahir": "2021-01-01", "tarikh pengukuran": "2023-01-01", "berat_kg": "12.0", "tinggi_cm": "85.0"}

#: code, profile, what the flagged row holds, what the clean row holds
CASES = [
    ("review_future_measure_date", "wide_registry", {"tarikh": "2025-01-01"}, {}),
    ("review_name_gender_mismatch", "wide_registry", {"nama": "Siti binti Ali"}, {"nama": "Abu bin Ali"}),
    ("review_gender_cols_disagree", "wide_registry", {"gender": "P"}, {"gender": "L"}),
    ("review_year_mismatch", "wide_registry", {"year": "2022"}, {"year": "2023"}),
    ("review_dob_dual_mismatch", "wide_registry", {"date of birth": "2021-01-02"}, {"date of birth": "2021-01-01"}),
    ("review_mykid_invalid", "wide_registry", {"mykid": "123"}, {"mykid": "210101075001"}),
    ("review_ic_malformed", "wide_multiyear", {"no kp": "123"}, {"no kp": "210101075001"}),
    ("review_ic_gender_mismatch", "wide_multiyear", {"no kp": "210101075002"}, {"no kp": "210101075001"}),
    ("review_ic_dob_mismatch", "wide_multiyear", {"no kp": "210102075001"}, {"no kp": "210101075001"}),
    ("review_ic_age_contradiction", "wide_multiyear", {"no kp": "900101075001"}, {"no kp": "210101075001"}),
    ("review_dose_date_mismatch", "wide_multiyear", {"dose_date": "2023-01-02"}, {"dose_date": "2023-01-01"}),
    ("review_age_source_mismatch", "wide_registry", {"age_months": "30"}, {"age_months": "24.5"}),
    ("review_age_band_mismatch", "wide_registry", {"age_months": "24.5", "kategori_umur": "Bawah 2 Tahun"}, {"age_months": "24.5", "kategori_umur": "Bawah 5 Tahun"}),
    ("review_age_vacc_range", "wide_registry", {"age_at_vaccination": "6"}, {"age_at_vaccination": "5"}),
    ("review_daerah_null", "wide_registry", {"daerah": " "}, {"daerah": "Tawau"}),
    ("review_bahagian_null", "wide_registry", {"bahagian": None}, {"bahagian": "Kapit"}),
    ("review_geo_out_of_bounds", "wide_registry", {"latitude": "8.0", "longitude": "101.0"}, {"latitude": "3.0", "longitude": "101.0"}),
    ("review_height_unit_suspect", "wide_registry", {"tinggi": "850"}, {"tinggi": "85"}),
    ("review_ghost_bmi", "wide_registry", {"bmi": "16.0", "berat": None}, {"bmi": "16.0"}),
    ("review_dual_measure_mismatch", "wide_multiyear", {"length_height_cm": "86.0"}, {"length_height_cm": "85.0"}),
    ("review_ghost_class", "wide_registry", {"waz": None, "waz_class": "normal"}, {"waz": "0.1", "waz_class": "normal"}),
    ("review_zscore_biv", "wide_registry", {"haz": "-6.5"}, {"haz": "-6.0"}),
    ("review_indicator_class_mismatch", "wide_registry", {"ind_bantut_zscore": "1", "haz_class": "normal"}, {"ind_bantut_zscore": "1", "haz_class": "severely stunted"}),
    ("review_pendapatan_null", "wide_registry", {"pendapatan": ""}, {"pendapatan": "B40"}),
    ("review_pendapatan_invalid", "wide_registry", {"pendapatan": "3000"}, {"pendapatan": "b 40"}),
    ("review_vaccine_unknown", "wide_registry", {"vaksin": "aspirin"}, {"vaksin": " MMR "}),
    ("review_taska_blank", "wide_registry", {"agensi": "X", "nama taska": None}, {"agensi": "X", "nama taska": "Y"}),
]


@pytest.mark.parametrize("code, source, bad, good", CASES, ids=[c[0] for c in CASES])
def test_review_code(spark, code, source, bad, good):
    base = REGISTRY if source == "wide_registry" else MULTI
    names = [*base, *[c for c in {**bad, **good} if c not in base]]
    rows = [[i, *[{**base, **own}.get(c) for c in names]] for i, own in enumerate((bad, good))]
    df = spark.createDataFrame(rows, "_row_id long, " + ", ".join(f"`{c}` string" for c in names))
    roles = {"date": "tarikh", "height": "tinggi"} if source == "wide_registry" else {}
    out = cleaning.clean(df, source, as_of="2024-01-01", roles={"gender": "jantina", "dob": "tarikh lahir"} | roles)
    assert [code in r["review_codes"] for r in out.orderBy("_row_id").collect()] == [True, False]


def test_review_of_shared_numbers(spark):
    rows = [[i, *MULTI.values(), n] for i, n in enumerate(("210101075001", " 210101075001", "210101075003", None, None))]
    df = spark.createDataFrame(rows, "_row_id long, " + ", ".join(f"`{c}` string" for c in [*MULTI, "no kp"]))
    out = cleaning.clean(df, "wide_multiyear", as_of="2024-01-01").orderBy("_row_id").collect()
    assert ["review_duplicate_ic" in r["review_codes"] for r in out] == [True, True, False, False, False]


def test_rules_that_seldom_fire(spark):
    rows = [(0, "L", "2021-01-01", "2023-01-01", None, None), (1, "L", "2021-01-01", "2023-01-01", 12.0, 85.0)]
    df = spark.createDataFrame(rows, "_row_id long, jantina string, `tarikh lahir` string, tarikh string, berat double, tinggi double")
    out = cleaning.clean(df, "wide_registry", roles={"date": "tarikh"}, as_of="2024-01-01").orderBy("_row_id").collect()
    assert [r["exclude_reason"] for r in out] == ["dropped_no_measurement; dropped_null_zscore", ""]
    preview = cleaning.preview_rules(df, "wide_registry", roles={"date": "tarikh"}, as_of="2024-01-01")
    assert {tuple(r) for r in preview.collect()} == {("dropped_no_measurement", 1, 1), ("dropped_null_zscore", 0, 1)}
    pupil = spark.createDataFrame([(0, "A", "L", "2015-01-01", "2022-06-01", 25.0, None)], "_row_id long, ID_MURID string, jantina string, `tarikh lahir` string, `tarikh pengukuran` string, berat double, tinggi double")
    assert cleaning.clean(pupil, "school_age", as_of="2024-01-01").first()["drop_codes"] == ["dropped_no_bmi"]


def test_registry_of_rules(spark):
    counts = spark.createDataFrame([("dropped_invalid_gender", 3)], "rule string, n long")
    got = {r["rule"]: (r["n"], r["fired"], r["locked"], r["enabled"]) for r in rules.registry(spark, counts, "general", {"dropped_invalid_gender"}).collect()}
    assert got["dropped_invalid_gender"] == (3, True, False, True) and got["dropped_null_zscore"] == (0, False, True, True) and got["dropped_bmi_outlier"] == (0, False, False, False)


def test_vocabularies(spark):
    df = spark.createDataFrame([(" Wanita", "b40", "completed", "OBES", 11, 0.9, "2020-05-01"), ("x", "?", "dalam proses", "?", 60, 2.5, "2020-12-01"), ("1", None, "Belum", "Susut", None, None, None)],
                               "g string, i string, a string, b string, m int, kg double, d string")
    c = F.col
    got = [tuple(r) for r in df.select(values.gender_profile(c("g")), values.income_profile(c("i")), values.assessment_profile(c("a")), values.bmi_group(c("b")), values.age_group(c("m")), values.birth_weight_class(c("kg")), values.quarter_label(c("d").cast("date"))).collect()]
    assert got == [
        ("F", "B40", "Selesai", "obes_berlebihan", "0-11 bulan", "ELBW", "S2"), ("x", "?", "Dalam Proses", "lain-lain", "60+ bulan", "Normal", "S4"), ("M", None, "Belum Selesai", "susut", None, None, None),
    ]
    safe = values.json_safe(spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (0.5, 3)], "x double, n int"))
    assert [tuple(r) for r in safe.collect()] == [(None, 1), (None, 2), (0.5, 3)]


def test_screens(spark):
    df = spark.createDataFrame([(0, " Sabah", "TAWAU", True, "", "a"), (1, "sabah", "Kudat", False, "", ""), (2, "Perak", "Ipoh", False, "", "b")], "_row_id long, negeri string, daerah string, analyzable boolean, exclude_reason string, review_reason string")
    ids = lambda d: [r["_row_id"] for r in d.orderBy("_row_id").collect()]
    assert ids(explore.place_filter(df, " SABAH ")) == [0, 1] and ids(explore.place_filter(df, "sabah", "tawau")) == [0] and ids(explore.place_filter(df)) == [0, 1, 2]
    assert explore.page_info(df, 2) == {"total": 3, "total_pages": 2} and explore.page_info(df.limit(0), 2)["total_pages"] == 1
    assert ids(explore.select_rows(df, flagged=True)) == [0, 2] and ids(explore.select_rows(df, flagged=True, analyzable=True)) == [0] and ids(explore.select_rows(df, query="ipoh")) == [2]
    cells = spark.createDataFrame([(None,), (11.0,), (12.0,), (15.9,), (30.0,), (49.0,), (50.5,)], "w double")
    assert [r[0] for r in cells.select(explore.cell_state(F.col("w"), "flag_weight")).collect()] == ["danger", "danger", "warn", "ok", "ok", "warn", "danger"]
    assert "analyzable" not in explore.explorer_view(df).columns


def test_zscore_modes(spark):
    """Outside the table: clamped, or null in daily mode; beyond the cap: null, or kept in daily mode."""
    table = growth.knot_table(spark)
    df = spark.createDataFrame([("Lelaki", 9999, 30.0, 138.0, 15.8), ("Lelaki", 0, 3.3464, 49.8842, 13.4069), ("Lelaki", 0, 9.0, 49.8842, 13.4069)], "g string, d int, w double, h double, b double")
    run = lambda mode: [tuple(r) for r in growth.add_zscores(df, table, *[F.col(x) for x in "gdwhb"], mode=mode).select("WAZ", "HAZ", "BAZ").collect()]
    clamped, daily, monthly = run("profile"), run("daily"), run("monthly")
    assert None not in clamped[0] and daily[0] == (None, None, None) and monthly[0] == clamped[0]
    assert all(abs(z) < 0.02 for mode in (clamped, daily, monthly) for z in mode[1])
    assert clamped[2][0] is None and daily[2][0] > 6
    odd = spark.createDataFrame([(-6.1,), (0.0,), (5.5,), (None,)], "z double")
    assert [r[0] for r in odd.select(growth.implausible(F.col("z"), "WAZ")).collect()] == [True, False, True, False]


def test_label_mismatches(spark):
    df = spark.createDataFrame([("Normal", "normal"), ("bantut", "normal"), ("something", "normal"), (None, None)], "label string, class string")
    r = growth.mismatch_report(df, {"HAZ": ("label", "class")}).first()
    assert (r["n"], r["mismatches"], r["pct"], r["severity"]) == (3, 1, 33.33, "high")


def test_findings_and_ids(spark):
    fired = spark.createDataFrame([("BR-01", 9, "WARNING"), ("BR-02", 1, "ERROR"), ("BR-03", 0, "ERROR"), ("BR-06", 50, "INFO")], "rule string, n long, severity string")
    assert [r["rule"] for r in quality.findings(fired).collect()] == ["BR-02", "BR-01", "BR-06"]
    ids = spark.createDataFrame([("a", "ic"), ("a", "ic"), ("b", "ic"), (None, "missing"), (None, "missing")], "i string, k string")
    assert joins.id_analysis(ids, F.col("i"), F.col("k")).first().asDict() == {"unique_ids": 2, "multi_record": 1, "missing_rows": 2}


def test_linkage_records_and_export(spark):
    df = spark.createDataFrame([("nan", " Abu ", 2023, 4, "x"), ("1", "none", None, None, "2.5")], "IC string, Nama string, year int, month int, weight_kg string")
    got = [tuple(r) for r in linkage.child_records(df, "d1", "general", {"name": ["full name", "nama"]}).select("ic", "name", "dataset_id", "measure_date", "weight_kg").collect()]
    assert got[0] == (None, "Abu", "d1", "2023-04-01", None) and got[1][:3] == ("1", None, "d1") and got[1][4] == 2.5
    linked = spark.createDataFrame([(0, 0, "a", 1.0), (1, 0, "a", 1.0), (2, 0, "b", 0.7), (3, 3, "b", 0.0)], "row long, group long, dataset_id string, confidence double").withColumn("source_type", F.lit("general"))
    assert [(r["group"], r["dataset_id"], r["group_size"]) for r in linkage.export_rows(linked).collect()] == [(0, "a", 3), (0, "b", 3), (3, "b", 1)]


def test_worklists(spark):
    rows = [(0, 0, "M", "S", "Abu"), (1, 0, "F", "S", "Abu"), (2, 2, "M", "S", "Ali"), (3, 3, "F", "S", "Mei"), (4, 3, "f ", "T", None)]
    linked = spark.createDataFrame(rows, "row long, group long, gender string, state string, name string")
    for c in ("ic", "dob", "district", "dataset_id", "source_type"):
        linked = linked.withColumn(c, F.lit("x"))
    linked = linked.withColumn("confidence", F.lit(1.0))
    assert sorted(r["row"] for r in linkage.duplicate_worklist(linked).collect()) == [0, 1, 3, 4]
    got = sorted((r["row"], r["field"], r["severity"], r["value"]) for r in linkage.conflict_worklist(linked).collect())
    assert got == [(0, "gender", "hard", "M"), (1, "gender", "hard", "F"), (3, "state", "hard", "S"), (4, "state", "hard", "T")]
