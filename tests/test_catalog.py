import re

import duckdb
import pytest
from compare import differences, duck

import __spark_entry__ as entry_module
from grovetable.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_answers_as_sql_does(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLES:
        assert not differences(df, con, catalog.ORACLES[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name, column", [("review_registry", "review_reason"), ("review_numbers", "review_reason"), ("clean_school_all_rules", "exclude_reason")])
def test_every_code_fires_and_spares(con, name, column):
    """The rows that SQL expects of these queries hold every code for some rows and spare others, so that a match proves each rule."""
    rows = con.execute(f"SELECT count(*) FROM ({catalog.ORACLES[name]})").fetchone()[0]
    fired = dict(con.execute(f"SELECT code, count(*) FROM (SELECT unnest(string_split({column}, '; ')) AS code FROM ({catalog.ORACLES[name]})) WHERE code <> '' GROUP BY 1").fetchall())
    assert set(fired) == set(re.findall(r"'((?:review|dropped)_[a-z_]+)'", catalog.ORACLES[name]))
    assert all(0 < n < rows for n in fired.values())


def test_a_question_on_repeated_and_missing_numbers(spark, tmp_path):
    """ask_sql answers as its SQL does where numbers repeat, or number or language are missing."""
    rows = [(i, "en") for i in range(25)] + [(1, "en"), (2, None), (3, "fr"), (3, "fr"), (None, "en"), (None, None)]
    spark.createDataFrame([r for r in rows if r != (3, "en")], "doc_id long, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    for limit in (31, 3):
        here = tmp_path / str(limit)
        spark.read.parquet(str(tmp_path / "documents.parquet")).filter(f"doc_id < {limit} OR doc_id IS NULL").write.parquet(str(here / "documents.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{here}/documents.parquet/*.parquet')")
        assert not differences(catalog.QUERIES["ask_sql"](spark, str(here)), con, catalog.ORACLES["ask_sql"])


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
