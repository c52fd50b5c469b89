"""Row numbers that follow files and places in them, whatever splits Spark reads them in."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Plan nodes above a file scan that neither repeat nor move rows.
PLAIN = ("Project", "Filter", "SubqueryAlias", "View")


def has(df: DataFrame, column: str) -> bool:
    """Whether every row of the frame is a row of its files, and a field of their metadata can be told."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in PLAIN:
        node = node.children().head()
    if node.children().size():
        return False
    try:
        df.select(column)
    except AnalysisException:
        return False
    return True


def _after_earlier(sizes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``__base``: the rows of all earlier parts. One small row a part; the running sum is over parts, never over rows."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))


def in_file_order(df: DataFrame, out: str = "_row_id") -> DataFrame | None:
    """Add ``out``, numbers from 0 in order of file path and row, to rows read from Parquet; None for any other frame.

    A row's place in its file is told by the reader, so nothing is written and no row is shuffled: a second scan
    without columns finds the files' sizes. Rows that a filter has left out keep their numbers, so those of the others
    do not depend on it, except that a file's last rows may be gone before the next file's numbers begin.
    """
    if not has(df, "_metadata.row_index"):
        return None
    placed = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"))
    sizes = placed.groupBy("__path").agg((F.max("__at") + 1).alias("__n"))
    bases = _after_earlier(sizes, ["__path"]).select("__path", "__base")
    return placed.join(bases, "__path").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__base") + F.col("__at")).alias(out))


def number_rows(df: DataFrame, settle, out: str = "_row_id") -> DataFrame:
    """Add ``out``: contiguous numbers from 0, in order of files and rows.

    From Parquet as ``in_file_order``. Rows of other files are ``settle``d (written once and read back) with their file,
    block and place in it: a block is read by one task, in order, and blocks are counted and numbered by where they start.
    A frame that does not come straight from files has no order but that of its partitions; it is settled with that.
    Settled numbers are the same whenever they are read again, executors lost or not.
    """
    if (lazy := in_file_order(df, out)) is not None:
        return lazy
    files = has(df, "_metadata.file_block_start")
    keys = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")] if files else [F.lit(""), F.spark_partition_id().cast("long")]
    placed = settle(df.select("*", keys[0].alias("__path"), keys[1].alias("__start"), F.monotonically_increasing_id().alias("__at")))
    sizes = placed.groupBy("__path", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    bases = _after_earlier(sizes, ["__path", "__start"]).drop("__n")
    return placed.join(bases, ["__path", "__start"]).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__base") + F.col("__at") - F.col("__first")).alias(out))
