"""Runs kept in versions, and joins that are previewed, counted and kept."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from grovetable.operators import joins
from grovetable.sources.runs import RunStore, linkage_rows, run_join, save_linkage


def test_versions(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    assert store.publications().count() == 0
    with pytest.raises(KeyError):
        store.load("report", "a")
    first = store.save("report", "a", spark.range(3), {"by": "me"})
    store.save("report", "b", spark.range(9))
    early = store.load("report", "a")
    second = store.save("report", "a", spark.range(5).withColumn("more", F.lit("x")), totals=lambda df: {"largest": df.agg(F.max("id")).first()[0]})
    assert store.load("report", "a").count() == 5 and store.load("report", "b").count() == 9 and early.count() == 3
    assert store.load("report", "a", first).columns == ["id"] and store.details("report", "a") == {"largest": 4}
    assert sorted((r["key"], r["number"], r["rows"]) for r in store.publications().collect()) == [("a", 0, 3), ("a", 1, 5), ("b", 0, 9)]
    assert {r["version"] for r in store.current().collect()} >= {second} and first not in {r["version"] for r in store.current().collect()}

    broken = spark.range(4).select(F.raise_error(F.lit("lost on the way")).alias("id"))
    with pytest.raises(PySparkException):
        store.save("report", "a", broken)
    with pytest.raises(ZeroDivisionError):  # written whole, but not published
        store.save("report", "a", spark.range(100), totals=lambda df: 1 / 0)
    assert store.load("report", "a").count() == 5

    assert store.sweep("report") == 0  # too young
    assert store.sweep("report", older_than=0) == 3 and store.sweep("none", older_than=0) == 0
    assert store.load("report", "a").count() == 5 and store.load("report", "b").count() == 9


def test_linkage_run(spark, tmp_path):
    rows = [(0, 0, "d1"), (1, 0, "d2"), (2, 2, "d1"), (3, 2, "d1"), (4, 4, "d2")]
    store = RunStore(spark, str(tmp_path))
    for least in (0.5, 0.7):
        save_linkage(store, "all", spark.createDataFrame(rows, "row long, `group` long, dataset_id string").withColumn("confidence", F.lit(least)), {"min_confidence": least})
    assert store.details("linkage", "all") == {"params": {"min_confidence": 0.7}, "total_groups": 3, "linked_groups": 2, "multi_source_groups": 1}
    assert sorted(tuple(r) for r in linkage_rows(store, "all").select("row", "group", "confidence").collect()) == [(r, g, 0.7) for r, g, _ in rows]


def sides(spark):
    a = spark.createDataFrame([("1", "x", 1), ("1", "x", 2), (None, "x", 3), ("2", "y", 4)], "k string, j string, v int")
    return a, spark.createDataFrame([("1", "x", 5), ("1", "z", 6), (None, "x", 7), ("3", "y", 8)], "k string, j string, v int")


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("keys", [["k"], ["k", "j"]])
def test_counts_are_those_of_the_join(spark, how, keys):
    a, b = sides(spark)
    stats = joins.join_stats(a, b, how, keys)
    assert stats["result_rows"] == joins.join_tables(a, b, how, keys).count()
    assert (stats["matched_keys"], stats["left_only_keys"], stats["right_only_keys"], stats["left_rows"], stats["right_rows"]) == (1, 1, 1, 4, 4)
    assert joins.join_stats(a.limit(0), b, how, keys)["result_rows"] == joins.join_tables(a.limit(0), b, how, keys).count()


def test_preview_and_run(spark, tmp_path):
    a, b = sides(spark)
    seen = joins.join_preview(a, b, "inner", ["k"], rows=2)
    assert len(seen["preview"]) == 2 and seen["columns"] == ["k", "j_x", "v_x", "j_y", "v_y"] and seen["stats"]["result_rows"] == 5
    assert joins.join_preview(a, a, "union", distinct=True)["stats"] == {"left_rows": 4, "right_rows": 4, "result_rows": 4, "duplicates_removed": 4}
    for bad in (("inner", None), ("left", ["q"]), ("cross", ["k"])):
        with pytest.raises(ValueError):
            joins.join_preview(a, b, *bad)
    store = RunStore(spark, str(tmp_path))
    for types, want in ((("general", "general"), "general"), (("general", "school_age"), "joined"), ((None, None), "joined")):
        run_join(store, "ab", a, b, "outer", ["k"], left_name="A", right_name="B", left_type=types[0], right_type=types[1])
        told = store.details("join", "ab")
        assert (told["source_type"], told["name"], told["stats"]["result_rows"]) == (want, "A ⨝ B (outer)", 7)
    assert store.load("join", "ab").count() == 7
