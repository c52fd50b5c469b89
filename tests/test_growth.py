from pyspark.sql import functions as F

from grovetable.functions import growth
from grovetable.sources import tables

CHILD = "sex string, days int, weight double, height double"


def scored(spark, rows, mode, table=None):
    df = spark.createDataFrame(rows, CHILD)
    table = table if table is not None else growth.knot_table(spark)
    bmi = F.col("weight") / F.pow(F.col("height") / 100, F.lit(2))
    out = growth.add_zscores(df, table, F.col("sex"), F.col("days"), F.col("weight"), F.col("height"), bmi, mode=mode)
    return [(r["WAZ"], r["HAZ"]) for r in out.orderBy("days", "height").collect()]


def test_every_month_has_its_own_values(spark):
    # medians of boys' weight and height at 1, 18 and 100 months
    rows = [("M", 30, 4.4709, 54.7244), ("M", 548, 10.9399, 82.3427), ("M", 3044, 27.23, 130.6)]
    assert scored(spark, rows, "cleaner") == [(0.0, 0.0)] * 3
    assert scored(spark, rows, "monthly") == [(0.0, 0.0)] * 3


def test_ages_beyond_120_months_take_the_last(spark):
    assert scored(spark, [("F", 5000, 33.83, 142.1), ("F", 3652, 33.83, 142.1)], "monthly") == [(0.0, 0.0)] * 2


def test_last_day_comes_from_the_table(spark):
    table = growth.knot_table(spark).filter("day <= 1856").withColumn("haz_m", F.when(F.col("day") == 1856, 111.0).otherwise(F.col("haz_m")))
    assert [z[1] for z in scored(spark, [("M", 1900, 18.0, 111.0)], "cleaner", table)] == [0.0]


def test_growth_table_from_csv(spark, tmp_path):
    """A file of one row per sex, indicator and day gives the table that z-scores are joined with, one row per sex and day."""
    rows = [(s, i, day, 1.0, 10.0 + day + n, 0.1) for s in "MF" for n, i in enumerate(growth.INDICATORS) for day in (0, 1)]
    (tmp_path / "lms.csv").write_text("sex,indicator,day,L,M,S\n" + "\n".join(",".join(map(str, r)) for r in rows) + "\n")
    got = tables.read_lms(spark, str(tmp_path / "lms.csv"))
    assert sorted((r["sex"], r["day"]) for r in got.collect()) == [("F", 0), ("F", 1), ("M", 0), ("M", 1)]
    assert set(got.columns) == set(growth.knot_table(spark).columns)
    weight, height = growth.INDICATORS.index("WAZ"), growth.INDICATORS.index("HAZ")
    # with L = 1 and S = 0.1 a value a tenth above the median scores 1
    assert scored(spark, [("M", 0, (10.0 + weight) * 1.1, 10.0 + height), ("M", 1, 11.0 + weight, (11.0 + height) * 1.1)], "daily", got) == [(1.0, 0.0), (0.0, 1.0)]
