import random

import pytest
from pyspark.sql import functions as F

from grovetable.operators import profile, quantiles

SHARES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def table(spark):
    draw = random.Random(4)
    rows = [("even", float(i)) for i in range(3001)] + [("ties", draw.choice([1.0, 2.0, 2.5])) for _ in range(2000)] + [("far", draw.choice([-1, 1]) * 10.0 ** draw.randint(-300, 300)) for _ in range(1500)]
    rows += [("bell", draw.gauss(0, 1)) for _ in range(4000)] + [("one", 7.25), ("two", 1.0), ("two", 2.0), ("even", None), ("same", 3.0), ("same", 3.0), ("same", 3.0)]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "column string, x double").repartition(6)


@pytest.mark.parametrize(("left", "accuracy"), [(100_000, 10_000), (20, 10_000), (1, 50)])
def test_percentiles_are_those_of_all_values(spark, monkeypatch, left, accuracy):
    """With few values left at a time, and with a coarse sketch, ranges are narrowed again and again."""
    monkeypatch.setattr(quantiles, "LEFT", left)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    x = table(spark)
    want = {r["column"]: (r["n"], r["p"]) for r in x.filter("x IS NOT NULL").groupBy("column").agg(F.count("x").alias("n"), F.percentile("x", F.array(*[F.lit(p) for p in SHARES])).alias("p")).collect()}
    got = quantiles.percentiles(x, SHARES)
    assert set(got) == set(want)
    for c, (n, p) in want.items():
        assert got[c][0] == n and got[c][1] == pytest.approx(p, rel=1e-12)


def test_a_sketch_that_is_off_is_mended(spark):
    x = table(spark).filter("column = 'even' AND x IS NOT NULL")
    for low, high in ((0.0, 10.0), (2500.0, 3000.0), (1499.0, 1501.0)):
        assert quantiles.order_statistics(x, [quantiles.Range("even", 1500, low, high)], left=5) == {("even", 1500): 1500.0}


def test_no_rows(spark):
    assert quantiles.percentiles(table(spark).limit(0), SHARES) == {}
    assert profile.fences(spark.createDataFrame([], "a double"), ["a"], 1.5) == {}
