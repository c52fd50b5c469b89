"""Row numbers are the same however Spark splits the files."""

import pytest
from pyspark.sql import functions as F

from grovetable.operators import cleaning, joins, rows
from grovetable.operators.linkage import shared_scratch
from grovetable.sources import tables

SPLITS = ("128m", "20k", "3k")


@pytest.fixture
def splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    yield lambda size: [spark.conf.set("spark.sql.files.maxPartitionBytes", size), spark.conf.set("spark.sql.files.openCostInBytes", "1")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def lines(folder, suffix=""):
    """Three files, the smallest first by name; the largest is read first by Spark."""
    folder.mkdir()
    n = 0
    for name, size in (("a", 5), ("b", 4_000), ("c", 300)):
        body = "".join(f"{i % 7},{i},{'x' * (i % 50)}\n" for i in range(n, n + size))
        (folder / f"{name}.csv").write_text("id,seq,pad\n" + body)
        n += size
    return str(folder), n


def numbers(df, out="_row_id"):
    return [(r[out], int(r["seq"])) for r in df.select(out, "seq").collect()]


def test_csv_in_blocks(spark, tmp_path, splits):
    path, n = lines(tmp_path / "csv")
    for size in SPLITS:
        splits(size)
        df = spark.read.option("header", True).csv(path)
        got = numbers(rows.number_rows(df, shared_scratch))
        assert sorted(got) == [(i, i) for i in range(n)]
    whole = tables.read_csv(spark, path)  # quoted line breaks: a file is one block
    assert sorted(numbers(rows.number_rows(whole, shared_scratch))) == [(i, i) for i in range(n)]


def test_parquet_needs_no_writing(spark, tmp_path, splits):
    path, n = lines(tmp_path / "csv")
    for part in "abc":
        spark.read.option("header", True).csv(f"{path}/{part}.csv").coalesce(1).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "pq" / f"p={part}"))
    for size in SPLITS:
        splits(size)
        df = spark.read.parquet(str(tmp_path / "pq"))
        assert sorted(numbers(cleaning.with_row_id(df))) == [(i, i) for i in range(n)]
        some = cleaning.with_row_id(df.filter("seq % 3 = 1"))
        assert sorted(s for _, s in numbers(some)) == sorted(i for i in range(n) if i % 3 == 1)
        assert [s for _, s in sorted(numbers(some))] == sorted(i for i in range(n) if i % 3 == 1)
    assert cleaning.with_row_id(df).columns == [*df.columns, "_row_id"]
    kept = df.withColumn("_row_id", F.lit(3))
    assert cleaning.with_row_id(kept) is kept


def test_frames_without_files(spark, tmp_path):
    df = spark.range(0, 1_000, numPartitions=7).withColumn("seq", F.col("id"))
    got = numbers(rows.number_rows(df, shared_scratch))
    assert sorted(r for r, _ in got) == list(range(1_000)) and all(r == s for r, s in got)
    assert rows.in_file_order(df) is None and rows.in_file_order(df.groupBy("id").count()) is None
    spark.range(10).withColumn("seq", F.col("id")).write.parquet(str(tmp_path / "pq"))
    scan = spark.read.parquet(str(tmp_path / "pq"))
    twice = scan.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    met = scan.join(spark.range(10).union(spark.range(10)), "id")
    for made in (twice, met, scan.union(scan), scan.distinct().union(scan)):  # rows repeat, so their places in the file do
        assert rows.in_file_order(made) is None
        assert sorted(r for r, _ in numbers(rows.number_rows(made, shared_scratch))) == list(range(20))
        assert cleaning.with_row_id(made).select("_row_id").distinct().count() == 20
    assert rows.number_rows(df.limit(0), shared_scratch).count() == 0


def test_merge_keeps_the_same_rows_under_any_split(spark, tmp_path, splits):
    path, _ = lines(tmp_path / "csv")
    kept = set()
    for size in SPLITS:
        splits(size)
        a = spark.read.option("header", True).csv(path).withColumn("DOSE_DATE", F.lit("01/02/2020")).withColumn("pad", F.lit("p"))
        b = a.withColumn("seq", F.concat(F.lit("9"), "seq"))
        out, stats = joins.merge_files([a, b], "id", "DOSE_DATE")
        kept.add(tuple((r["id"], r["seq"]) for r in out.collect()))
        assert stats.first()["total_rows"] == 2 * 4_305
    assert kept == {tuple((str(i), str(i)) for i in range(7))}
