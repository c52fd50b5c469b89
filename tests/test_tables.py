"""Small hand-checked cases."""

import random

import pytest
from pyspark.sql import functions as F

from grovetable.functions import growth, identity, values
from grovetable.operators import anomaly, ask, cleaning, explore, indicators, joins, linkage, profile, quality, reshape, risk, trend
from grovetable.plans import binder, ranges, rules
from grovetable.sources import tables, xlsx
from grovetable.streaming import arrivals


def one(df):
    return df.first().asDict()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def by_row(df, *columns):
    return [tuple(r) for r in df.orderBy("_row_id").select(*columns).collect()]


MULTI = "_row_id long, JANTINA string, `TARIKH LAHIR` string, `TARIKH PENGUKURAN` string, `BERAT (KG)` double, `TINGGI (CM)` double"


def multiyear(spark):
    rows = [("LELAKI", "2023-01-01", 12.0, 85.0), ("ZZZ", "2023-01-01", 12.0, 85.0), ("PEREMPUAN", "2022-01-01", 12.5, 86.0), ("LELAKI", "2023-01-01", 13.0, 300.0), ("PEREMPUAN", "2023-01-01", 500.0, 84.0), ("LELAKI", "2023-01-01", 11.5, 83.0)]
    return frame(spark, [(i, g, "2021-01-01", m, w, h) for i, (g, m, w, h) in enumerate(rows)], MULTI)


def test_multiyear(spark):
    out = cleaning.clean_wide_multiyear(multiyear(spark), as_of="2024-01-01").persist()
    assert by_row(out, "analyzable", "exclude_reason", "BMI", "Age_Days") == [
        (True, "", 16.61, 730), (False, "dropped_invalid_gender; dropped_null_zscore", 16.61, 730), (True, "", 16.9, 365),
        (False, "dropped_measurement_outlier; dropped_null_zscore", 1.44, 730), (False, "dropped_measurement_outlier; dropped_bmi_outlier; dropped_null_zscore", 708.62, 730), (True, "", 16.69, 730),
    ]
    # 365 days is next to the 12-month knot, 730 next to the 24-month one: worked out by hand from those constants
    lms = lambda x, l, m, sd: ((x / m) ** l - 1) / (l * sd)  # noqa: E731, E741
    boy = lambda w, h: (lms(w, -0.0130, 12.1239, 0.10160), lms(h, 1, 87.1162, 0.03180), lms(w / (h / 100) ** 2, -0.6064, 16.1435, 0.09166))
    girl = (lms(12.5, 0.0619, 8.8494, 0.09813), lms(86.0, 1, 74.0150, 0.03184), lms(12.5 / 0.86**2, -0.5840, 17.0893, 0.09694))
    for got, want in zip(by_row(out.filter("analyzable"), "WAZ", "HAZ", "BAZ"), [boy(12.0, 85.0), girl, boy(11.5, 83.0)]):
        assert all(abs(a - b) < 0.03 for a, b in zip(got, want))
    stats = one(cleaning.run_stats(out))
    assert (stats["final_count"], stats["total_dropped"], stats["male"], stats["female"], stats["ind_normal"], stats["review_count"]) == (3, 3, 2, 1, 3, 0)
    assert {r["rule"]: r["n"] for r in rules.rule_counts(out).collect()} == {"dropped_invalid_gender": 1, "dropped_measurement_outlier": 2}
    assert cleaning.summary(out)["score"] == 50.0
    assert explore.analysis_view(out).count() == 3 and explore.full_view(out).first()["analyzable"]
    assert "Unknown gender" in {r["exclude_reason"].split("; ")[0] for r in explore.full_view(out).collect()}


def test_registry(spark):
    rows = [("L", 16.0, 105, 18.0, 110), ("P", 16.5, 106, 18.5, 111), ("L", 999.0, 104, 18.0, 109), ("ZZZ", 16.0, 105, 18.0, 110)]
    wide = frame(spark, [(i, g, "2019-01-01", str(a), str(b), "2022-06-01", str(c), str(d), "2023-06-01") for i, (g, a, b, c, d) in enumerate(rows)],
                 "_row_id long, JANTINA string, `TARIKH LAHIR` string, `2022 Berat` string, `2022 Tinggi` string, `2022 Tarikh` string, `2023 Berat` string, `2023 Tinggi` string, `2023 Tarikh` string")
    out = cleaning.clean_wide_registry(wide, as_of="2024-01-01")
    assert by_row(out, "analyzable", "BMI", "Age_Days") == list(zip([True, True, True, True, False, True, False, False], [14.51, 14.88, 14.68, 15.02, 923.63, 15.15, 14.51, 14.88], [1247, 1612] * 4))


def test_school(spark):
    rows = [("A1", "L", "2023-06-01", 30.0, 130.0), ("A1", "L", "2023-06-01", 30.0, 130.0), ("A2", "ZZZ", "2023-06-01", 31.0, 131.0), ("A3", "P", "2023-06-01", 500.0, 132.0), ("A4", "L", "2014-06-01", 29.0, 128.0)]
    df = frame(spark, [(i, a, g, "2015-01-01", m, w, h) for i, (a, g, m, w, h) in enumerate(rows)], "_row_id long, ID_MURID string, JANTINA string, `TARIKH LAHIR` string, `TARIKH PENGUKURAN` string, BERAT double, TINGGI double")
    out = cleaning.clean_data(df, "school_age", as_of="2024-01-01")
    assert by_row(out, "exclude_reason", "BMI", "Age_Days") == [("", 17.75, 3073), ("dropped_duplicate_id", 17.75, 3073), ("dropped_invalid_gender", 18.06, 3073), ("dropped_measurement_outlier", 286.96, 3073), ("dropped_invalid_date; dropped_age_invalid", 17.7, -214)]


def test_general_cohorts(spark):
    schema = "Jantina string, Tarikh_Lahir string, Tarikh_Pengukuran string, Berat_Kg double, Tinggi_Cm double"
    infants = frame(spark, [("L", "2021-01-01", "2023-01-01", w, h) for w, h in ((12.0, 85.0), (11.5, 84.0), (12.5, 86.0))], schema)
    pupils = frame(spark, [("L", "2016-01-01", "2023-01-01", w, h) for w, h in ((30.0, 140.0), (28.0, 135.0), (32.0, 138.0))], schema)
    assert cleaning.clean_general(infants)[1]["cohort"] == "infant" and cleaning.clean_general(infants)[0].filter("analyzable").count() == 3
    out, found = cleaning.clean_general(pupils)
    assert found["cohort"] == "school" and found["indicators_available"] == ["bmi"] and out.filter("analyzable").count() == 3
    years = frame(spark, [("L", "4", 15.0)], "jantina string, umur string, berat double")
    assert cleaning.infer_cohort(years)["median_age_months"] == 48 and cleaning.infer_cohort(years)["assumptions"]


@pytest.mark.parametrize("rule, row", [
    ("dropped_age_over5", ("L", "2014-01-01", "2023-01-01", 12.0, 85.0, "3000")), ("dropped_date_before_dob", ("L", "2021-01-01", "2020-01-01", 12.0, 85.0, "3000")), ("dropped_pendapatan_x", ("L", "2021-01-01", "2023-01-01", 12.0, 85.0, "X")),
    ("dropped_null_dob", ("L", None, "2023-01-01", 12.0, 85.0, "3000")), ("dropped_ragu_gender", ("RAGU", "2021-01-01", "2023-01-01", 12.0, 85.0, "3000")),
])
def test_portable_rules(spark, rule, row):
    good = ("L", "2021-01-01", "2023-01-01", 12.0, 85.0, "3000")
    df = frame(spark, [good, row], "jantina string, tarikh_lahir string, tarikh_pengukuran string, berat double, tinggi double, pendapatan string")
    counts = {r["rule"]: r["n"] for r in cleaning.recommend_rules(df, as_of="2024-01-01").collect()}
    assert counts.get(rule) == 1
    off = rules.rule_counts(cleaning.clean(df, "general", enabled={rule}, as_of="2024-01-01")).collect()
    assert (rule, 1) in {(r["rule"], r["n"]) for r in off}


def test_gating():
    assert rules.rule_on("dropped_null_zscore", set(), "wide_multiyear") and not rules.rule_on("dropped_age_over5", None, "general")
    assert rules.review_on("review_daerah_null", {"x"}) and not rules.review_on("review_daerah_null", {rules.REVIEW_SWITCH}) and not rules.review_on("review_agensi_unknown", None)
    assert rules.effective_rules("general", {"dropped_ragu_gender", "nonsense"}, {"review_daerah_null": True}) == {"dropped_ragu_gender", rules.REVIEW_SWITCH, "review_daerah_null"}
    assert ranges.invalid({"bmi_max": {"value": "x"}, "no": {}, "infant_weight": {"min": 99.0}}) and not ranges.invalid({"bmi_max": {"value": 35}})


def test_duplicate_numbers(spark):
    df = frame(spark, [(0, "a", "2020-01-01", "2021-01-01"), (1, "a", "2020-01-01", "2022-01-01"), (2, "b", "2020-01-01", "2021-01-01"), (3, "b", "2020-02-01", "2021-01-01"), (4, None, "2020-01-01", None)], "_row_id long, mykid string, `tarikh lahir` string, tarikh string")
    out = cleaning.clean(df, "wide_registry", roles={"date": "tarikh"}, as_of="2024-01-01", enabled={"dropped_duplicate_mykid"})
    assert [c for (c,) in by_row(out, F.array_contains("drop_codes", "dropped_duplicate_mykid"))] == [True, False, False, False, False]
    assert [c for (c,) in by_row(out, F.array_contains("review_codes", "review_mykid_shared_placeholder"))] == [False, False, True, True, False]


def test_values(spark):
    df = frame(spark, [("2020-02-30", "x"), ("03/04/2020", "NaN"), ("2020-1-2", "1e3"), (None, " 7 ")], "d string, n string")
    got = [(str(r[0]) if r[0] else None, str(r[1]) if r[1] else None, r[2]) for r in df.select(values.parse_date(F.col("d")), values.parse_date(F.col("d"), "month_first"), values.try_num(F.col("n"))).collect()]
    assert got == [(None, None, None), ("2020-04-03", "2020-03-04", None), ("2020-01-02", "2020-01-02", 1000.0), (None, None, 7.0)]
    blanks = values.null_sentinels(frame(spark, [(" ", "--", "ok"), ("N/A", "\t", "-1")], "a string, b string, c string")).collect()
    assert [tuple(r) for r in blanks] == [(None, None, "ok"), (None, None, "-1")]
    z = frame(spark, [(0.0,), (None,), (9.9,)], "x double").select(growth.z_of(F.col("x"), F.lit(0.0), F.lit(10.0), F.lit(0.1))).collect()
    assert [r[0] for r in z] == [None, None, -0.101]


def test_ids(spark):
    raw = ["900101145678", "9.00101145678E11", "900101145678_1", "K12", "12345A78", "123", "991301145678", "nan", None, "9001011456789"]
    got = [tuple(r[0]) for r in frame(spark, [(x,) for x in raw], "x string").select(identity.validate_id(F.col("x"))).collect()]
    assert [(g[0], g[1], g[3]) for g in got] == [(True, None, "ic"), (True, None, "ic"), (True, None, "ic"), (True, None, "system_id"), (False, "corrupted", "corrupted"), (False, "too_short_3", "ic"), (False, "invalid_date", "ic"), (False, "missing", "missing"), (False, "missing", "missing"), (False, "too_long_13", "ic")]
    r = frame(spark, [("900101145677", "2024-01-01")], "x string, d string").select(identity.id_gender(F.col("x")), identity.id_birth_date(F.col("x"), F.col("d").cast("date"))).first()
    assert r[0] == "Male" and str(r[1]) == "1990-01-01"


def test_binder(spark):
    assert binder.detect_source(["ID_MURID", "Nama"]) == "school_age" and binder.detect_source(["IC_NO_PASSPORT", "DOSE_DATE"]) == "wide_multiyear" and binder.detect_source(["x"]) == "general"
    assert binder.detect_for_cleaning(["2023 Berat"]) == "wide_registry"
    assert binder.better_source(["dose date", "facility name"], "school_age") == "wide_multiyear"
    m = binder.suggest_mapping(["No. MyKid", "Jantina", "2024 Berat (kg)", "2025 Berat (kg)"], "wide_multiyear")
    assert (m["id"], m["jantina"], m["berat_kg"], m["negeri"]) == ("No. MyKid", "Jantina", "2025 Berat (kg)", None)
    assert binder.find_col(["Price", "ic"], ["ic"]) == "Price"
    df = frame(spark, [("a", "1")], "x string, y string")
    assert binder.apply_mapping(df, {"id": "x", "nama": "y"}).columns == ["id", "nama"]
    found = binder.validate_mapping(df, {"berat_kg": "x", "id": "gone"})
    assert {f["level"] for f in found if f["field"] in ("berat_kg", "id")} == {"warning", "error"}


def test_long_tables(spark):
    df = frame(spark, [("a", "1", None, "2"), ("b", None, None, None)], "id string, `2023 Berat` string, `2023 Tinggi` string, `2024 Berat` string")
    assert reshape.registry_to_long(df).count() == 2
    assert sorted(tuple(r) for r in reshape.multiyear_to_long(df).select("id", "tahun_ukur", "Berat").collect()) == [("a", "2023", "1"), ("a", "2024", "2")]


def test_risk_and_trend(spark):
    z = frame(spark, [(-4.0, -4.0, -4.0, 30), (0.0, 0.0, 0.0, 30), (None, None, None, 10), (-2.5, 0.0, 2.5, 10)], "w double, h double, b double, m int")
    c = [F.col(x) for x in "whb"]
    s = risk.score(*c, F.lit(0), F.col("m"))
    assert [tuple(r) for r in z.select(s, risk.tier(s, *c)).collect()] == [(100.0, "High"), (0.0, "Low"), (0.0, "Incomplete"), (42.0, "Medium")]
    snaps = frame(spark, [("P", str(2020 + i), r) for i, r in enumerate((25.0, 22.0, 19.0, 16.0))] + [("Q", "2020", 5.0)], "district string, period string, stunting_rate double")
    t = trend.trajectories(snaps, ["stunting"]).collect()
    assert len(t) == 1 and t[0]["slope"] == -3.0 and t[0]["forecast"] == 4.0 and t[0]["status"] == "On Track"
    kpi = {r["kpi"]: r for r in indicators.kpi_rates(frame(spark, [(i % 2,) for i in range(10)], "stunting int"), {"stunting": F.col("stunting") == 1}).collect()}
    assert kpi["stunting"]["rate"] == 50.0 and kpi["stunting"]["status"] == "Red"
    assert one(indicators.overall_status(indicators.kpi_rates(snaps.limit(0), {"stunting": F.lit(True)})))["overall"] == "Green"
    assert indicators.flag_columns(["Ind_Bantut"])["stunting"] == "Ind_Bantut"


def test_profile_helpers(spark):
    df = frame(spark, [(i, str(i), "a" if i % 2 else "b", "2020-01-01") for i in range(50)], "id int, n string, c string, when_date string")
    assert profile.column_kinds(df) == {"id": "identifier", "n": "numerical", "c": "categorical", "when_date": "date"}
    assert profile.histogram(frame(spark, [(3.0,), (3.0,)], "x double"), "x", 4).agg(F.sum("n")).first()[0] == 2
    assert profile.scatter_sample(df, "n", "id", "id", 7).count() == 7
    assert explore.search(df, "A").count() == 25 and explore.page(df, "n", limit=3, key="id").count() == 3
    with pytest.raises(ValueError):
        ask.ask_sql(df, "DROP TABLE x")
    flagged = anomaly.anomaly_flags(frame(spark, [(float(i % 7),) for i in range(99)] + [(500.0,)], "x double"), ["x"])
    assert flagged.filter("is_anomaly").count() >= 1 and flagged.filter("x = 500 AND is_anomaly").count() == 1
    filled = quality.fill_nulls(frame(spark, [(None, None)], "a string, b string"), ["a"], ["b"]).first()
    assert (filled["a"], filled["b"], filled["a_was_null"]) == ("UNKNOWN", "tiada data", True)


def test_merge(spark):
    a = frame(spark, [("1", "01/02/2020", "x"), ("2", "03/02/2020", " ")], "id string, DOSE_DATE string, v string")
    b = frame(spark, [("1", "05/02/2020", "y")], "id string, DOSE_DATE string, v string")
    out, stats = joins.merge_files([a, b], "id", "DOSE_DATE")
    assert [r["v"] for r in out.collect()] == ["y"]
    assert one(stats) == {"unique_rows": 2, "final_rows": 1, "total_rows": 3, "duplicates_removed": 1, "incomplete_removed": 1}
    with pytest.raises(ValueError):
        joins.merge_files([a, b.drop("v")], "id", "DOSE_DATE")


REC = "row long, ic string, source_type string, dataset_id string, name string, dob string, gender string, state string, district string, measure_date string, weight_kg double, height_cm double"


def rec(row, ic, dataset="one", name=None, dob=None, state="S"):
    return (row, ic, "general", dataset, name, dob, "M", state, "D", "2020-01-01", 1.0, 1.0)


def groups(spark, rows):
    out = {}
    for r in linkage.link_records(spark.createDataFrame(rows, REC)).collect():
        out.setdefault(r["group"], []).append((r["row"], r["confidence"], r["reason"]))
    return out


def test_linkage(spark):
    ids = [("900101010001", "one"), ("900101010001", "two"), ("900101010002", "one"), ("910202020005", "one"), ("010202020005", "two")]
    assert sorted(len(g) for g in groups(spark, [rec(i, x, d) for i, (x, d) in enumerate(ids)]).values()) == [2, 3]
    assert [len(g) for g in groups(spark, [rec(i, x) for i, x in enumerate(("210303075001", "210303075002", "110303075001"))]).values()] == [3]
    # leaders, not components: a-b-c gives {a, b} and {c}
    assert sorted(len(g) for g in groups(spark, [rec(i, x) for i, x in enumerate(("111111111111", "111111111112", "111111111122"))]).values()) == [1, 2]
    named = groups(spark, [rec(0, "900101010001", "one", "Ali bin Ahmad", "1990-01-01"), rec(1, "", "two", "ALI BIN AHMAD", "1990-01-01"), rec(2, "", "two", "Ali Ahmad", "1990-01-02"), rec(3, "", "two", "Someone Else", "1990-01-01")])
    assert sorted(len(g) for g in named.values()) == [1, 3]
    assert {x[2] for g in named.values() for x in g} == {"exact_ic", "name_dob", "fuzzy_name_dob", "unmatched"}


def test_greedy_clusters_as_one_by_one(spark):
    draw = random.Random(5)
    ids = list(dict.fromkeys("9001010" + "".join(draw.choice("01") for _ in range(5)) for _ in range(60)))
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]
    leader = {}
    for i, a in enumerate(ids):
        if a not in leader:
            leader[a] = a
            for b in ids[i + 1 :]:
                if b not in leader and lev(a, b) <= 1:
                    leader[b] = a
    got = {}
    for r in linkage.link_records(spark.createDataFrame([rec(i, x) for i, x in enumerate(ids)], REC)).collect():
        got[ids[r["row"]]] = ids[r["group"]]
    assert got == leader


def test_sources(spark, tmp_path):
    df = frame(spark, [("007", 1.5, None), ("é<&", 2.0, "x")], "ic string, n double, v string")
    path = tmp_path / "t.xlsx"
    path.write_bytes(xlsx.xlsx_bytes(df, tables.text_columns(df)))
    assert [tuple(r) for r in tables.read_table(spark, str(path)).collect()] == [("007", "1.5", None), ("é<&", "2.0", "x")]
    tables.write_csv(df, str(tmp_path / "c.csv"), single=True)
    assert sorted(r["ic"] for r in tables.read_many(spark, [str(tmp_path / "c.csv")] * 2).collect()) == ["007", "007", "é<&", "é<&"]
    assert tables.csv_bytes(df).startswith(b"\xef\xbb\xbfic,n,v\n007,1.5,")
    store = tables.DatasetStore(spark, str(tmp_path / "s"))
    store.save("a", df)
    assert store.load("a").count() == 2
    rows = lambda d, n: frame(spark, [(d, str(i)) for i in range(n)], "dataset_id string, ic string")
    store.replace_records(rows("a", 3).union(rows("b", 2)))
    store.replace_records(rows("a", 1))
    assert store.records(["a", "b"]).count() == 3 and store.records(["b"]).count() == 2
    assert tables.data_dictionary(spark).count() > 30


def test_stream(spark, tmp_path):
    frame(spark, [(12.0, 85.0), (99.0, 85.0)], "w double, h double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("w double, h double").parquet(str(tmp_path / "in"))
    q = arrivals.flag_arrivals(stream, "w", "h").writeStream.format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["analyzable"] for r in spark.table("arrived").collect()) == [False, True]


def test_every_indicator_alias_is_found():
    from grovetable.operators import indicators

    for column, name in (("Ind_Kurang_Berat_Badan", "underweight"), ("Ind_Kurang_Berat", "underweight"), ("Ind_Berlebihan_BB", "overweight"), ("Ind_Berlebihan", "overweight"), ("Ind_Obes", "overweight"), ("Ind_Bantut", "stunting"), ("ind_susut_zscore", "wasting")):
        assert indicators.flag_columns(["id", column])[name] == column


def test_equally_new_results_in_any_order(spark):
    """Rows with the same time and number: the same one stays however rows come, one with a result before one without."""
    at = ["2020-01-02", "2020-01-01"]
    rows = [(1, at[0], 7, None), (1, at[0], 7, "a"), (1, at[0], 7, "b"), (1, at[1], 9, "c"), (2, at[0], 8, "d"), (2, at[0], 8, None), (3, at[0], 5, None), (3, at[0], 4, "e")]
    sessions = frame(spark, [(1, 10), (2, 20), (3, 30)], "session_id long, dataset_id long")
    for given in (rows, rows[::-1]):
        results = frame(spark, given, "session_id long, created_at string, result_id long, result_json string").coalesce(1)
        got = {r["dataset_id"]: (r["result_id"], r["result_json"]) for r in joins.latest_results(sessions, results).collect()}
        assert got == {10: (7, "b"), 20: (8, "d")}
