import random

import pytest

from grovetable.operators import forest


def frame(spark, n=600, planted=12):
    draw = random.Random(1)
    rows = [(i, draw.gauss(0, 1), draw.gauss(10, 2), f"r{i}") for i in range(n)]
    rows += [(n + i, draw.choice([-1, 1]) * draw.uniform(7, 9), draw.choice([-5.0, 27.0]), "odd") for i in range(planted)]
    return spark.createDataFrame(rows, "id long, a double, b double, note string")


def walked(nodes, x):
    at = nodes[0]
    while at["feature"] >= 0:
        at = nodes[at["low"] if x[at["feature"]] < at["cut"] else at["high"]]
    return at["length"]


def test_scores_are_those_of_walked_paths(spark):
    df = frame(spark)
    grown = forest.grow_forest(df, ["a", "b"], "id", trees=20, sample=64).collect()
    trees = {}
    for r in grown:
        trees.setdefault(r["tree"], {})[r["node"]] = r
    assert len(trees) == 20 and all(sum(n["feature"] < 0 for n in t.values()) <= 64 for t in trees.values())
    got = forest.with_scores(df, ["a", "b"], spark.createDataFrame(grown, forest.NODES), 64).collect()
    for r in got:
        mean = sum(walked(t, (r["a"], r["b"])) for t in trees.values()) / 20
        assert r["anomaly_score"] == pytest.approx(2 ** (-mean / forest.average_path(64)))


def test_planted_rows_stand_out_and_splits_do_not_matter(spark):
    df = frame(spark)
    one, two = (forest.isolation_flags(df.repartition(n), ["a", "b"], "id") for n in (2, 7))
    scores = [{r["id"]: (round(r["anomaly_score"], 9), r["is_anomaly"]) for r in f.collect()} for f in (one, two)]
    assert scores[0] == scores[1] and len(scores[0]) == 612
    assert all(scores[0][600 + i][1] for i in range(12))
    assert sum(flag for _, flag in scores[0].values()) <= 0.05 * 612 + 1
    assert min(scores[0][600 + i][0] for i in range(12)) > 0.55
    other = forest.isolation_flags(df, ["a", "b"], "id", seed=7)
    assert {r["id"] for r in other.filter("is_anomaly").collect()} >= set(range(600, 612)) and other.filter("anomaly_score > 0.55").count() != 0


def test_gaps_ties_and_few_rows(spark):
    same = spark.createDataFrame([(i, 3.0, None) for i in range(40)], "id long, a double, b double")
    got = forest.isolation_flags(same, ["a", "b"], "id").collect()
    assert {round(r["anomaly_score"], 9) for r in got} == {0.5} and not any(r["is_anomaly"] for r in got)
    text = spark.createDataFrame([(i, "x" if i % 3 else str(i), None) for i in range(40)], "id long, a string, anomaly string")
    assert forest.isolation_flags(text, ["a"], "id").count() == 40
    assert not forest.isolation_flags(same.limit(5), ["a"], "id").filter("is_anomaly").count()
    assert forest.isolation_flags(same.limit(0), ["a"], "id").count() == 0


def test_rows_are_scored_once(spark, monkeypatch):
    """The cut and the result are taken from the scores of one pass; a gap counts as the median."""
    seen, made = spark.sparkContext.accumulator(0), forest.with_scores

    def counted(df, *rest):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        out = made(df, *rest)
        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(forest, "with_scores", counted)
    df = frame(spark)
    holed = df.selectExpr("id", "a", "CASE WHEN id % 50 > 0 THEN b END AS b")
    median = holed.selectExpr("median(b) AS m").first()["m"]
    got = {r["id"]: (r["anomaly_score"], r["is_anomaly"]) for r in forest.isolation_flags(holed, ["a", "b"], "id").collect()}
    assert seen.value == len(got) == 612
    full = forest.isolation_flags(holed.fillna({"b": median}), ["a", "b"], "id").collect()
    assert got == {r["id"]: (r["anomaly_score"], r["is_anomaly"]) for r in full}
