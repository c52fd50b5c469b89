import random

import pytest
from compare import differences

from grovetable.operators import linkage
from grovetable.plans import catalog

REC = "row long, ic string, source_type string, dataset_id string, name string, dob string, gender string, state string, district string, measure_date string, weight_kg double, height_cm double"


def greedy(n, near):
    """Leaders of nodes 0 to n - 1, one by one."""
    leader = {}
    for i in range(n):
        leader[i] = next((j for j in sorted(near.get(i, ())) if j < i and leader[j] == j), i)
    return leader


def solved(spark, n, edges, settle):
    nodes = spark.createDataFrame([(i, i) for i in range(n)], "node long, first long")
    links = spark.createDataFrame([(min(e), max(e), min(e), max(e)) for e in edges], "a long, b long, a_first long, b_first long")
    return {r["node"]: r["leader"] for r in linkage.lead_clusters(nodes, links, settle).collect()}


def graphs():
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(47)]
    tangle = {tuple(sorted(draw.sample(range(50, 120), 2))) for _ in range(90)}
    star = [(130, 131 + i) for i in range(20)] + [(131 + i, 160 + i) for i in range(20)]
    return 190, [*chain, *tangle, *star]


@pytest.mark.parametrize("one_task", [200_000, 40, 3])
def test_leaders_as_one_by_one(spark, monkeypatch, one_task):
    """One task for a small rest, tasks of whole components, and rounds for components that are too large."""
    monkeypatch.setattr(linkage, "ONE_TASK", one_task)
    n, edges = graphs()
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert solved(spark, n, edges, linkage.shared_scratch) == greedy(n, near)


def test_a_chain_takes_few_steps(spark):
    steps = []
    got = solved(spark, 48, [(i, i + 1) for i in range(47)], lambda df: steps.append(1) or linkage.shared_scratch(df))
    assert got == {i: i - i % 2 for i in range(48)}
    assert len(steps) <= 8


def test_components(spark):
    n, edges = graphs()
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for e in edges for x in e}
    got = {r["node"]: r["root"] for r in linkage.components(spark.createDataFrame(edges, "a long, b long"), linkage.shared_scratch).collect()}
    assert got == {i: root[i] for i in linked}


@pytest.mark.parametrize("days", [0, 1, 3])
def test_birth_dates_across_month_ends(spark, days):
    """Records without numbers meet on days of birth within reach, over ends of months and years."""
    dobs = ["2020-01-31", "2020-02-01", "2019-12-31", "2020-01-01", "2020-02-28", "2020-03-02", "2020-06-15", "2020-06-18"]
    rows = [(i, "", "general", "one", f"Child {'xyzw'[i // 2]} Longname", d, "M", "S", "D", "2020-01-01", 1.0, 1.0) for i, d in enumerate(dobs)]
    got = {r["row"]: r["group"] for r in linkage.link_records(spark.createDataFrame(rows, REC), dob_days=days, name_cut=0.99).collect()}
    gaps = (1, 1, 3, 3)
    assert got == {i: i - i % 2 if gaps[i // 2] <= days else i for i in range(8)}


@pytest.fixture
def crowded(tmp_path):
    """Customers whose changed numbers are those of others, and whose second records share a row with others: numbers go round at 1,000,000."""
    import duckdb

    back = pow(37, -1, 1_000_000)
    changed = [k * 37 - k * 37 % 10 + (k * 37 + 1) % 10 for k in (6, 12, 24, 30, 150, 300)]
    keys = [3, 6, 9, 12, 24, 25, 30, 75, 150, 300, 1_000_003, 1_000_006, 1_000_009, 1_000_150, *[n * back % 1_000_000 for n in changed]]
    con = duckdb.connect()
    con.execute("CREATE TABLE nation AS SELECT i::INTEGER AS n_nationkey, 'NATION_' || i AS n_name FROM range(4) t(i)")
    con.execute("CREATE TABLE customer AS SELECT k AS c_custkey, 'Customer#' || k AS c_name, (k % 4)::INTEGER AS c_nationkey, 1.5 AS c_acctbal, 'S' || k % 3 AS c_mktsegment FROM (SELECT unnest(?::BIGINT[]) AS k)", [keys])
    for t in ("nation", "customer"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    return str(tmp_path), con


def test_conflicts_as_sql_where_numbers_are_shared(spark, crowded):
    folder, con = crowded
    assert not differences(catalog.QUERIES["link_conflicts"](spark, folder), con, catalog.ORACLES["link_conflicts"])
    fields = catalog.QUERIES["link_conflict_fields"](spark, folder)
    assert {r["field"] for r in fields.collect()} == {"gender", "state", "dob", "district", "name"}


def test_conflict_rows_as_sql_where_numbers_are_shared(spark, crowded):
    folder, con = crowded
    assert not differences(catalog.QUERIES["link_conflict_rows"](spark, folder), con, catalog.ORACLES["link_conflict_rows"])
    fields = catalog.QUERIES["link_conflict_field_rows"](spark, folder)
    assert {r["field"] for r in fields.collect()} == {"gender", "state", "dob", "district", "name"}
