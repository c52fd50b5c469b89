"""Results kept by run: versions that are written first and published by one row.

A run is a kind (``linkage``, ``join``, ...) and a key. Every save writes a new version in a folder of its own, then adds one row
to the table of publications; readers follow the newest row of a run. So a save that fails on the way leaves the last version
readable, a repeated one replaces it, and readers that began before go on with the version they took.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins

PUBLISHED = "kind string, key string, version string, number long, published_at timestamp, rows long, details string"


class RunStore:
    """Runs under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _data(self, kind: str, version: str) -> str:
        return f"{self.root}/runs/{kind}/{version}"

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def publications(self) -> DataFrame:
        """All rows of the table of publications: a row a save."""
        path = f"{self.root}/published"
        return self.spark.read.schema(PUBLISHED).json(path) if self._exists(path) else self.spark.createDataFrame([], PUBLISHED)

    def current(self) -> DataFrame:
        """The newest publication of every run; of two with the same number, which saves at the same time can make, the later one."""
        return self.publications().groupBy("kind", "key").agg(F.max_by(F.struct("version", "number", "published_at", "rows", "details"), F.struct("number", "published_at", "version")).alias("p")).select("kind", "key", "p.*")

    def _newest(self, kind: str, key: str):
        return self.current().filter((F.col("kind") == kind) & (F.col("key") == key)).first()

    def save(self, kind: str, key: str, df: DataFrame, details: dict | None = None, totals: Callable[[DataFrame], dict] | None = None) -> str:
        """Write ``df`` as a new version of a run, publish it, and return the version.

        The row count and ``totals``, which go with ``details``, are taken from what was written, so all are of one reading.
        """
        version = uuid.uuid4().hex
        path = self._data(kind, version)
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        rows, told = written.count(), {**(details or {}), **(totals(written) if totals else {})}
        newest = self._newest(kind, key)
        number = newest["number"] + 1 if newest else 0
        row = self.spark.createDataFrame([(kind, key, version, number, rows, json.dumps(told, sort_keys=True))], "kind string, key string, version string, number long, rows long, details string")
        at = F.timestamp_micros(F.lit(time.time_ns() // 1_000))
        row.withColumn("published_at", at).coalesce(1).write.mode("append").json(f"{self.root}/published")  # one file, shown when it is complete
        return version

    def load(self, kind: str, key: str, version: str | None = None) -> DataFrame:
        """The newest version of a run, or one that is named."""
        if version is None:
            newest = self._newest(kind, key)
            if newest is None:
                raise KeyError(f"no {kind} run {key!r}")
            version = newest["version"]
        return self.spark.read.parquet(self._data(kind, version))

    def details(self, kind: str, key: str) -> dict:
        newest = self._newest(kind, key)
        if newest is None:
            raise KeyError(f"no {kind} run {key!r}")
        return json.loads(newest["details"])

    def sweep(self, kind: str, older_than: float = 86_400.0) -> int:
        """Delete what no run's newest publication names and was last written ``older_than`` seconds ago, failed saves included; how many versions went.

        Looks at the folders of one kind: one entry a version, not a file.
        """
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/runs/{kind}")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return 0
        due = {s.getPath().getName(): s.getPath() for s in system.listStatus(path) if s.getModificationTime() / 1_000 <= time.time() - older_than}
        named = self.current().filter(F.col("kind") == kind).select("version")
        old = self.spark.createDataFrame([(v,) for v in due], "version string").join(named, "version", "left_anti").collect() if due else []
        for r in old:
            system.delete(due[r["version"]], True)
        return len(old)


def group_totals(members: DataFrame) -> dict:
    """Groups, those of several records, and those over several datasets."""
    per = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dataset_id").alias("s"))
    return per.agg(F.count(F.lit(1)).alias("total_groups"), F.count_if(F.col("n") > 1).alias("linked_groups"), F.count_if(F.col("s") > 1).alias("multi_source_groups")).first().asDict()


def save_linkage(store: RunStore, key: str, linked: DataFrame, params: dict) -> str:
    """Keep the members of a linkage (row, group, dataset_id, confidence, reason, ...) with its parameters and the totals of its groups."""
    return store.save("linkage", key, linked, {"params": params}, group_totals)


def linkage_rows(store: RunStore, key: str) -> DataFrame:
    """The members of the newest linkage of a key."""
    return store.load("linkage", key)


def run_join(store: RunStore, key: str, left: DataFrame, right: DataFrame, how: str, keys: list[str] | None = None, distinct: bool = False, left_name: str = "left", right_name: str = "right", left_type: str | None = None, right_type: str | None = None) -> str:
    """Join or unite two tables, keep the result as a run of kind ``join``, and say with it what was joined, how, and its source type."""
    out = joins.join_tables(left, right, how, keys, distinct)
    told = {"name": f"{left_name} {'∪' if how == 'union' else '⨝'} {right_name} ({how})", "source_type": joins.joined_source(left_type, right_type), "join_type": how, "stats": joins.join_stats(left, right, how, keys, distinct)}
    return store.save("join", key, out, told)
