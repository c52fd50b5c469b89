"""Joins, unions and merges of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import null_sentinels, parse_date
from .rows import number_rows


def equi_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", null_safe: bool = True) -> DataFrame:
    """Join on named keys; other columns in both get ``_x`` and ``_y``. With ``null_safe``, null keys meet each other.

    Keys are compared null-safely through a pair (is null, value), so a large join is still an equality join.
    """
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    pairs = [F.struct(F.col(k).isNull().alias("n"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("v")) if null_safe else F.col(k) for k in keys]
    a = left.select(*[p.alias(f"__k{i}") for i, p in enumerate(pairs)], *[F.col(c).alias(f"{c}_x" if c in shared else f"__l_{c}" if c in keys else c) for c in left.columns])
    b = right.select(*[p.alias(f"__k{i}") for i, p in enumerate(pairs)], *[F.col(c).alias(f"{c}_y" if c in shared else f"__r_{c}" if c in keys else c) for c in right.columns])
    out = a.join(b, [f"__k{i}" for i in range(len(keys))], how)
    merged = [F.coalesce(F.col(f"__l_{k}"), F.col(f"__r_{k}")).alias(k) for k in keys]
    rest = [c for c in out.columns if not c.startswith(("__k", "__l_", "__r_"))]
    return out.select(*merged, *rest)


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct non-null keys in both, left only, right only."""
    side = lambda d, n: d.select(F.col(key).cast("string").alias("k"), F.lit(n).alias("s")).filter("k IS NOT NULL").distinct()
    both = side(left, 1).union(side(right, 2)).groupBy("k").agg(F.sum("s").alias("s"))
    return both.agg(F.count_if(F.col("s") == 3).alias("matched"), F.count_if(F.col("s") == 1).alias("left_only"), F.count_if(F.col("s") == 2).alias("right_only"))


def union_tables(tables: list[DataFrame], distinct: bool = False) -> DataFrame:
    """Rows of all tables by column name; missing columns are null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return out.dropDuplicates() if distinct else out


def joined_source(left: str | None, right: str | None) -> str:
    """The source type of a join: that of both sides if they agree on one."""
    return left if left and left == right else "joined"


#: Ways to put two tables together.
WAYS = ("inner", "left", "right", "outer", "union")


def join_tables(left: DataFrame, right: DataFrame, how: str, keys: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """Two tables side by side on ``keys``, or one under the other for ``union``; keys that a side lacks are refused."""
    if how not in WAYS:
        raise ValueError(f"{how!r} is none of {WAYS}")
    if how == "union":
        return union_tables([left, right], distinct)
    if not keys:
        raise ValueError("a join needs key columns")
    for side, df in (("left", left), ("right", right)):
        if missing := [k for k in keys if k not in df.columns]:
            raise ValueError(f"the {side} table has no {missing}")
    return equi_join(left, right, keys, how)


def join_counts(left: DataFrame, right: DataFrame, how: str, keys: list[str]) -> DataFrame:
    """One row: left_rows, right_rows, result_rows of a join, and how many values of the first key meet.

    Rows are counted by key before they meet, and products of counts are summed, so a frequent key costs no more than a rare one.
    """
    def per(df: DataFrame, n: str) -> DataFrame:
        k = F.struct(*[x for c in keys for x in (F.col(c).isNull().alias(f"n_{c}"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"v_{c}"))])
        return df.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias(n))

    both = per(left, "l").join(per(right, "r"), "k", "outer")
    alone = {"inner": F.lit(0), "left": F.col("l"), "right": F.col("r"), "outer": F.coalesce("l", "r")}[how]
    made = F.coalesce(F.col("l") * F.col("r"), alone, F.lit(0))
    rows = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("left_rows", F.col("l")), ("right_rows", F.col("r")), ("result_rows", made))])
    return rows.crossJoin(key_overlap(left, right, keys[0]))  # one row each


def join_stats(left: DataFrame, right: DataFrame, how: str, keys: list[str] | None = None, distinct: bool = False) -> dict:
    """What a join or union does to the rows, without making it: keys that meet and rows for a join, rows and repeats taken out for a union."""
    if how != "union":
        r = join_counts(left, right, how, keys).first()
        return {"matched_keys": r["matched"], "left_only_keys": r["left_only"], "right_only_keys": r["right_only"], "result_rows": r["result_rows"], "left_rows": r["left_rows"], "right_rows": r["right_rows"]}
    n = [left.count(), right.count()]
    kept = union_tables([left, right], True).count() if distinct else sum(n)
    return {"left_rows": n[0], "right_rows": n[1], "result_rows": kept, "duplicates_removed": sum(n) - kept}


def join_preview(left: DataFrame, right: DataFrame, how: str, keys: list[str] | None = None, distinct: bool = False, rows: int = 50) -> dict:
    """The first rows of a join or union, its columns and those of both sides, and ``join_stats``."""
    out = join_tables(left, right, how, keys, distinct)
    return {"preview": [r.asDict() for r in out.limit(rows).collect()], "columns": out.columns, "left_columns": left.columns, "right_columns": right.columns, "stats": join_stats(left, right, how, keys, distinct)}


def latest_results(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """The newest row of ``results`` (session_id, created_at, result_id, ...) of each dataset_id in ``sessions`` (session_id, dataset_id).

    Of equal times the largest result_id, of equal ones too the greatest result_json, none last, so that the order of rows does not
    matter; datasets whose newest row holds no result_json are left out, as are those without any.
    One aggregation with partial maxima, so no dataset is sorted in one task.
    """
    row = F.struct("created_at", "result_id", *[c for c in results.columns if c not in ("created_at", "result_id", "session_id")])
    newest = results.join(sessions.select("session_id", "dataset_id"), "session_id").groupBy("dataset_id").agg(F.max_by(row, F.struct("created_at", "result_id", "result_json")).alias("r"))
    return newest.select("dataset_id", "r.*").filter("result_json IS NOT NULL AND result_json <> ''")


def audit_entries(log: DataFrame, users: DataFrame, dataset_id=None, limit: int = 100) -> DataFrame:
    """The newest ``limit`` entries of ``log`` (log_id, user_id, dataset_id, created_at, ...) with ``username``, null for unknown users; of one dataset if asked."""
    some = log if dataset_id is None else log.filter(F.col("dataset_id") == F.lit(dataset_id))
    newest = some.orderBy(F.col("created_at").desc_nulls_last(), F.col("log_id").desc()).limit(limit)
    return newest.join(users.select("user_id", "username"), "user_id", "left")


def keep_latest(df: DataFrame, key: Column, at: Column, tie: Column) -> DataFrame:
    """The latest row of each key, a dateless one last; rows without a key all stay."""
    apart = F.when(F.col("__k").isNull(), F.xxhash64(tie))  # rows without a key are not gathered in one task
    rows = df.withColumn("__k", key).withColumn("__n", F.row_number().over(Window.partitionBy("__k", apart).orderBy(at.desc_nulls_last(), tie)))
    return rows.filter(F.col("__k").isNull() | (F.col("__n") == 1)).drop("__k", "__n")


def merge_files(tables: list[DataFrame], key: str, date: str) -> tuple[DataFrame, DataFrame]:
    """Put files with the same headers together: latest date per id, blanks to null, rows with any null out.

    Returns the rows, in file and row order by ``_order``, and one row of statistics. Of one id's rows with the same date the first
    in that order stays, however Spark splits the files.
    """
    from .linkage import shared_scratch

    first = tables[0].columns
    for t in tables[1:]:
        if t.columns != first:
            raise ValueError(f"headers differ: {sorted(set(t.columns) ^ set(first)) or 'their order'}")
    numbered = reduce(DataFrame.unionByName, [number_rows(t, shared_scratch, "_order").withColumn("_order", F.lit(i).cast("long") * (1 << 50) + F.col("_order")) for i, t in enumerate(tables)])
    latest = keep_latest(numbered, F.col(key), parse_date(F.col(date), "day_first"), F.col("_order"))
    clean = null_sentinels(latest)
    whole = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in first])
    stats = clean.agg(F.count(F.lit(1)).alias("unique_rows"), F.count_if(whole).alias("final_rows")).crossJoin(numbered.agg(F.count(F.lit(1)).alias("total_rows")))  # one row each
    return clean.filter(whole).orderBy("_order"), stats.withColumn("duplicates_removed", F.col("total_rows") - F.col("unique_rows")).withColumn("incomplete_removed", F.col("unique_rows") - F.col("final_rows"))


def id_analysis(df: DataFrame, cleaned_id: Column, kind: Column) -> DataFrame:
    """One row: distinct ids, ids with several rows, rows by kind of id."""
    per = df.select(cleaned_id.alias("i"), kind.alias("k")).groupBy("i", "k").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count_if(F.col("i").isNotNull()).alias("unique_ids"), F.count_if(F.col("i").isNotNull() & (F.col("n") > 1)).alias("multi_record"), F.coalesce(F.sum(F.when(F.col("k") == "missing", F.col("n"))), F.lit(0)).alias("missing_rows"))
