"""Reading and writing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column a string, sentinels as null."""
    from ..functions.values import null_sentinels

    return null_sentinels(spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path))


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """By extension: csv, parquet, xlsx."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".xlsx"):
        from .xlsx import read_xlsx

        return read_xlsx(spark, path, sheet)
    return read_csv(spark, path)


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files with the same header under each other."""
    tables = [read_table(spark, p) for p in paths]
    for p, t in zip(paths, tables):
        if t.columns != tables[0].columns:
            raise ValueError(f"{p} has another header than {paths[0]}")
    return reduce(DataFrame.unionByName, tables)


def read_lms(spark: SparkSession, path: str) -> DataFrame:
    """A growth reference (sex, indicator, day, L, M, S) from CSV or Parquet, one row per sex and day."""
    from ..functions.growth import pivot_lms

    raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path, schema="sex string, indicator string, day int, L double, M double, S double")
    return pivot_lms(raw)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def csv_bytes(df: DataFrame) -> bytes:
    """A small table as CSV with a byte order mark, row by row."""
    import csv
    import io

    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    w.writerows(df.toLocalIterator())
    return b"\xef\xbb\xbf" + out.getvalue().encode()


class DatasetStore:
    """Datasets as Parquet folders, and the record store partitioned by dataset."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, dataset_id: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/datasets/{dataset_id}")

    def load(self, dataset_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/datasets/{dataset_id}")

    def replace_records(self, records: DataFrame) -> None:
        """Replace the records of the datasets at hand, and no others."""
        records.repartition("dataset_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(f"{self.root}/child_record")

    def records(self, dataset_ids: list[str], datasets: DataFrame | None = None) -> DataFrame:
        out = self.spark.read.parquet(f"{self.root}/child_record").filter(F.col("dataset_id").isin(dataset_ids))
        return out.join(datasets.select("dataset_id", "created_at"), "dataset_id", "left") if datasets is not None else out


def data_dictionary(spark: SparkSession) -> DataFrame:
    """(field, kind, origin) of source and derived fields."""
    from ..plans.binder import SCHEMA

    derived = {"Age_Days": "numerical", "Age_Months": "numerical", "BMI": "numerical", "WAZ": "numerical", "HAZ": "numerical", "BAZ": "numerical", "Kategori_Umur": "categorical", "analyzable": "flag", "exclude_reason": "text", "review_reason": "text"}
    rows = [(k, v, "source") for k, v in SCHEMA.items()] + [(k, v, "derived") for k, v in derived.items()]
    return spark.createDataFrame(rows, "field string, kind string, origin string")


def text_columns(df: DataFrame) -> list[str]:
    """Columns that a spreadsheet must keep as text: strings and identity numbers."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) or any(w in f.name.lower() for w in ("ic", "mykid", "passport"))]
