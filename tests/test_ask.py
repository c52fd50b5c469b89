import pytest
from pyspark.sql import functions as F

from grovetable.operators.ask import ask_rows, ask_sql


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(40)], "id long, kind string, x double")


ALLOWED = [
    ("SELECT kind, count(*) AS n, round(avg(x), 2) AS m FROM df GROUP BY kind ORDER BY kind", [("a", 20, 19.0), ("b", 20, 20.0)]),
    ("with t as (select * from df where id < 4), u as (select kind, sum(x) s from t group by kind) select * from u order by kind", [("a", 2.0), ("b", 4.0)]),
    ("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY kind ORDER BY x DESC) k FROM df) WHERE k = 1 ORDER BY id", [(38,), (39,)]),
    ("SELECT id FROM df WHERE x = (SELECT max(x) FROM df) OR id IN (SELECT min(id) FROM df) ORDER BY id", [(0,), (39,)]),
    ("SELECT a.id FROM df a JOIN df b ON a.id = b.id + 39 WHERE CAST(a.x AS int) BETWEEN 1 AND 99 AND a.kind LIKE 'b%'", [(39,)]),
    ("SELECT CASE WHEN count(*) > 3 THEN 'many; drop table x' ELSE 'few' END AS s FROM df HAVING count(*) > 1", [("many; drop table x",)]),
    ("SELECT id FROM df WHERE id < 2 UNION SELECT id FROM df WHERE id < 1 ORDER BY id LIMIT 5", [(0,), (1,)]),
]


@pytest.mark.parametrize(("sql", "want"), ALLOWED)
def test_questions(table, sql, want):
    assert [tuple(r) for r in ask_sql(table, sql).collect()] == want


REFUSED = [
    "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM parquet.`/tmp`", "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM df",
    "SELECT java_method('java.util.UUID', 'randomUUID') FROM df", "SELECT * FROM other", "SELECT * FROM default.df", "WITH t AS (SELECT * FROM other) SELECT * FROM t", "WITH df2 AS (WITH z AS (SELECT * FROM text.`/etc/passwd`) SELECT * FROM z) SELECT * FROM df2",
    "SELECT * FROM df WHERE id IN (SELECT id FROM other)", "SELECT (SELECT max(value) FROM text.`/etc/hostname`) FROM df", "SELECT * FROM range(10)", "SELECT explode(array(1, 2)) FROM df", "SELECT * FROM df LATERAL VIEW explode(array(1)) t AS y",
    "SELECT current_user() FROM df", "SELECT input_file_name() FROM df", "SELECT version()", "SELECT 1; SELECT 2", "DROP TABLE x", "INSERT INTO t SELECT * FROM df", "CREATE TABLE t AS SELECT * FROM df", "SET spark.x = 1", "SHOW TABLES", "EXPLAIN SELECT 1", "DESCRIBE df",
    "SELECT * FROM IDENTIFIER('other')", "SELECT session_user FROM df", "WITH RECURSIVE t AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t) SELECT * FROM t", "SELECT TRANSFORM(id) USING 'cat' FROM df", "nonsense", "FROM df INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT *",
    "SELECT repeat(kind, 1000000000) FROM df", "SELECT sequence(1, 1000000000) FROM df", "WITH t AS (SELECT * FROM u), u AS (SELECT 1) SELECT * FROM t",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_what_is_refused(table, sql):
    with pytest.raises(ValueError):
        ask_sql(table, sql)


def test_the_session_is_left_alone(spark, table):
    spark.createDataFrame([(1,)], "mine int").createOrReplaceTempView("df")
    before = sorted(t.name for t in spark.catalog.listTables())
    one, two = ask_sql(table, "SELECT count(*) AS n FROM df"), ask_sql(table.filter("id < 3"), "SELECT count(*) AS n FROM df")
    assert (one.first()["n"], two.first()["n"]) == (40, 3)
    assert sorted(t.name for t in spark.catalog.listTables()) == before and spark.table("df").columns == ["mine"]
    spark.catalog.dropTempView("df")


def test_rows_and_time_are_limited(spark, table):
    assert len(ask_rows(table, "SELECT * FROM df", rows=7, seconds=60)) == 7
    slow = spark.range(0, 4_000_000_000, 1, 4).select(F.sqrt(F.col("id") * F.col("id") + 1).alias("x"))
    with pytest.raises(TimeoutError):
        ask_rows(slow, "SELECT sum(sin(cos(tan(x)))) AS s FROM df", seconds=2)
    assert ask_rows(table, "SELECT max(id) AS m FROM df", seconds=60)[0]["m"] == 39
