"""Exact quantiles of long columns without a buffer of their values.

A sketch of bounded size tells between which two values each quantile lies. One pass counts what is below and
inside; as long as too many different values are inside, equal buckets of the range are counted and the one that
holds the quantile is the next range. The few values left inside are put in order and the exact one is read off.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Counters of the sketch: a quantile is known to this fraction of the rows.
ACCURACY = 10_000
#: Buckets that a range is cut into, and values that may be left in one.
BUCKETS = 4_096
LEFT = 100_000


@dataclass
class Range:
    """Where the value with ``rank`` (from 0) lies: between ``low`` and ``high``."""

    column: str
    rank: int
    low: float
    high: float


def _ranges_table(x: DataFrame, ranges: list[Range]) -> DataFrame:
    """One row a range; their number is that of columns times quantiles."""
    return F.broadcast(x.sparkSession.createDataFrame([(r.column, i, r.low, r.high) for i, r in enumerate(ranges)], "column string, i int, low double, high double"))


def _narrowed(x: DataFrame, ranges: list[Range]) -> None:
    """Cut each range to the bucket that holds its rank."""
    met = x.join(_ranges_table(x, ranges), "column").filter("x <= high")
    step = (F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))
    bucket = F.when(F.col("x") < F.col("low"), -1).when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(BUCKETS - 1), F.floor(step * BUCKETS)))
    rows = met.groupBy("i", bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = x.sparkSession.createDataFrame([(i, r.rank) for i, r in enumerate(ranges)], "i int, rank long")
    held = rows.withColumn("before", before).join(F.broadcast(wanted), "i").filter("before <= rank AND rank < before + n").collect()  # one row a range
    for r in held:
        ranges[r["i"]].low, ranges[r["i"]].high = r["a"], r["b"]
    for i in set(range(len(ranges))) - {r["i"] for r in held}:
        ranges[i].high = float("inf")  # nothing up to there has the rank


def _inside(x: DataFrame, ranges: list[Range]) -> DataFrame:
    """(i, x, n): how often each value inside a range occurs, and under a null x how many rows lie below."""
    met = x.join(_ranges_table(x, ranges), "column").filter("x <= high")
    return met.groupBy("i", F.when(F.col("x") >= F.col("low"), F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("n"))


def order_statistics(x: DataFrame, ranges: list[Range], left: int | None = None) -> dict[tuple[str, int], float]:
    """The values at the ranks of ``ranges`` in ``x`` (column, x), exact."""
    left = LEFT if left is None else left
    found: dict[tuple[str, int], float] = {}
    open_ = list(ranges)
    while open_:
        inside = _inside(x, open_)
        sizes = {r["i"]: (r["d"], r["below"] or 0, r["n"] or 0) for r in inside.groupBy("i").agg(F.count("x").alias("d"), F.sum(F.when(F.col("x").isNull(), F.col("n"))).alias("below"), F.sum(F.when(F.col("x").isNotNull(), F.col("n"))).alias("n")).collect()}
        ready, again = [], []
        for i, r in enumerate(open_):
            d, below, n = sizes.get(i, (0, 0, 0))
            hit = below <= r.rank < below + n
            if not hit:
                r.low, r.high = (float("-inf"), r.low) if r.rank < below else (r.high, float("inf"))
            (ready if hit and (d <= left or r.low == r.high) else again).append((i, r, below))
        if ready:
            ends = x.sparkSession.createDataFrame([(i, r.rank - below) for i, r, below in ready], "i int, rank long")
            values = inside.filter("x IS NOT NULL").join(F.broadcast(ends), "i")  # at most ``left`` values a range
            upto = F.sum("n").over(Window.partitionBy("i").orderBy("x"))
            for row in values.withColumn("upto", upto).filter("upto - n <= rank AND rank < upto").select("i", "x").collect():
                r = open_[row["i"]]
                found[r.column, r.rank] = row["x"]
        open_ = [r for _, r, _ in again]
        if open_:
            finite = [r for r in open_ if abs(r.low) == float("inf") or abs(r.high) == float("inf")]
            if finite:
                ends = {r["column"]: r for r in x.groupBy("column").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect()}
                for r in finite:
                    r.low, r.high = max(r.low, ends[r.column]["a"]), min(r.high, ends[r.column]["b"])
            _narrowed(x, open_)
    return found


def percentiles(x: DataFrame, shares: tuple[float, ...]) -> dict[str, tuple[int, list[float]]]:
    """{column: (count, values at ``shares``)} of ``x`` (column, x), with linear interpolation between neighbours. Nulls do not count."""
    x = x.filter("x IS NOT NULL")
    slack = 2.0 / ACCURACY
    around = [min(1.0, max(0.0, p + e)) for p in shares for e in (-slack, slack)]
    first = x.groupBy("column").agg(F.count("x").alias("n"), F.percentile_approx("x", F.array(*[F.lit(p) for p in around]), F.lit(ACCURACY)).alias("q"), F.min("x").alias("a"), F.max("x").alias("b")).collect()  # one row a column
    ranges, counts = {}, {}
    for row in first:
        counts[row["column"]] = n = row["n"]
        for k, p in enumerate(shares):
            at = (n - 1) * p
            low = row["a"] if around[2 * k] <= 0 else row["q"][2 * k]
            high = row["b"] if around[2 * k + 1] >= 1 else row["q"][2 * k + 1]
            for rank in {int(at), min(n - 1, int(at) + 1)}:
                ranges.setdefault((row["column"], rank), Range(row["column"], rank, low, high))
    found = order_statistics(x, list(ranges.values()))
    out = {}
    for c, n in counts.items():
        at = [(n - 1) * p for p in shares]
        ends = [(a, found[c, int(a)], found[c, min(n - 1, int(a) + 1)]) for a in at]
        out[c] = n, [low if low == high else (int(a) + 1 - a) * low + (a - int(a)) * high for a, low, high in ends]
    return out
