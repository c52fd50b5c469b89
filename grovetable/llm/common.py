"""Shared pieces of the corpus operators: shared scratch storage, word rules, prefix sums."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the space and the five ASCII control blanks.
BLANKS = r"[ \t-\r]+"
WORD = r"[^ \t-\r]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor shares, from ``spark.checkpoint.dir``. A local one is made only in local mode where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-grovetable-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders that ``settle`` writes in a block of ``owning``, of this thread's block alone.
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owning() -> Iterator[list[str]]:
    """The list of folders that ``settle`` writes in the block and nobody discards there. What they hold can be deleted by the block's owner."""
    paths: list[str] = []
    token = _owner.set(paths)
    try:
        yield paths
    finally:
        _owner.reset(token)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage is cut at files that outlive any executor. Shuffle files of the steps before
    become garbage, so the driver is asked to let them go.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (own := _owner.get()) is not None:
        own.append(path)
    release(spark)
    settled = spark.read.schema(df.schema).parquet(path)
    settled.settled_path = path
    return settled


def release(spark: SparkSession) -> None:
    """Ask the driver to let go of frames out of use, so that Spark deletes their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete what ``settle`` wrote for ``df``, once all that was built on it is settled itself."""
    remove_path(df.sparkSession, df.settled_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    if (own := _owner.get()) is not None and path in own:
        own.remove(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def group_key(column: Column) -> Column:
    """A never-null key for a nullable string, in code point order, null last."""
    return F.when(column.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), column.cast("string")))


def prefix_sums(rows: DataFrame, group: str, spread: str, ties: list[str], size: str, out: str, bits: int = 8) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows of the same group that come before.

    Rows are ordered by the unsigned bits of ``spread`` (a 64-bit hash), then ``ties``. The top
    ``bits`` bits split every group into ranges; range totals are summed first, so that no task
    ever holds a whole group, however large it is.
    """
    ranged = rows.withColumn("__range", F.shiftrightunsigned(F.col(spread), 64 - bits).cast("int"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy(group, "__range")
        .agg(F.sum(size).alias("__total"))
        .withColumn("__base", F.coalesce(F.sum("__total").over(before), F.lit(0)))
        .drop("__total")
    )
    inside = Window.partitionBy(group, "__range").orderBy(spread, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(bases, [group, "__range"])
        .withColumn(out, (F.col("__base") + F.coalesce(F.sum(size).over(inside), F.lit(0))).cast("long"))
        .drop("__range", "__base")
    )


def by_bytes(batch, column: int, most: int = 4 << 20):
    """Slices of an Arrow batch with about ``most`` bytes of text in one column each, so that long texts never pile up."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
