"""The input is split otherwise between two jobs, as when executors come or go."""

from collections import Counter

import pytest
import reference as R

from grovetable.llm import exact, mixing


@pytest.fixture
def split_later(spark, tmp_path):
    """Documents in eight files, and a way to have them read file by file from now on."""
    rows = [(i, f"one of {i % 5} texts " * (1 + i % 5), "en", "abc"[i % 3]) for i in range(400)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(8).write.parquet(path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def split(size, parts):
        for n, v in zip(names, (size, size, parts)):
            spark.conf.set(n, v)

    split("128m", "1")
    yield spark.read.parquet(path), rows, lambda: split("1k", "8")
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_exact_copies_keep_one_of_each_text(split_later):
    docs, rows, split = split_later
    out = exact.drop_exact_copies(docs)
    split()
    last = {r[1]: r[0] for r in rows}
    assert sorted((r["text"], r["doc_id"]) for r in out.collect()) == sorted(last.items())


def test_mix_takes_the_planned_documents(split_later):
    docs, rows, split = split_later
    want = {p["doc_id"]: p["taken"] for p in mixing.mix_plan(docs).collect()}
    mixed = mixing.mix_sources(docs)
    split()
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(R.words(r["text"]))
    assert got == +Counter(want)
