"""Exact duplicates with frequent texts split off.

A Misra-Gries style frequent-items sketch over the texts' digests names every digest that is
frequent enough to load one task. Their exact counts and winners are looked up, which makes a
table bounded by the sketch's size, and rows of these digests are settled where they are read
against that broadcast table. All other digests are counted before an ordinary shuffle and joined
back, so a text that just missed the table is a join key of many rows, which Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: The broadcast table has at most this many rows.
FREQUENT = 500
#: Counters of the sketch; a digest in more than one row of TRACKED / 2 or so cannot be missed.
TRACKED = 8_192


def frequent_winners(digests: DataFrame, frequent: int = FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """text_sha256, __w (the largest ``w``) and __n (the number of rows) of frequent digests in ``digests`` (text_sha256, w): at most ``frequent`` rows."""
    found = digests.agg(F.expr(f"approx_top_k(text_sha256, {frequent}, {tracked})").alias("top")).select(F.explode("top").alias("t"))
    candidates = found.select(F.col("t.item").alias("text_sha256"))
    return settle(
        digests.join(F.broadcast(candidates), "text_sha256")  # at most `frequent` rows
        .groupBy("text_sha256").agg(F.max("w").alias("__w"), F.count(F.lit(1)).alias("__n")).filter("__n > 1"),
        "exact-winners",
    )


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", frequent: int = FREQUENT, tracked: int = TRACKED, carry: bool = True) -> DataFrame:
    """Add keep_id, group_size, kept and text_sha256 to every row of ``docs``.

    Texts are equal when identical after no change; null counts as empty. Of equal texts the
    row with the largest id stays (a null id is the least); if rows repeat that id too, one of them
    stays. Input columns with the added names are replaced, others carried along, or left out but for the id
    without ``carry``, so that no text is written; an empty table stays empty.
    """
    numbered = (
        docs.drop("keep_id", "group_size", "kept", "text_sha256")
        .withColumn("text_sha256", F.sha2(F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary"), 256))
        .withColumn("__row", F.monotonically_increasing_id())
    )
    if not carry:
        numbered = numbered.select(id_column, "text_sha256", "__row")
    # Row numbers depend on how the input is split, so they are written with their rows and never worked out again.
    rows = settle(numbered, "exact-rows")
    winners = frequent_winners(rows.select("text_sha256", F.struct(F.col(id_column).alias("id"), F.col("__row").alias("r")).alias("w")), frequent, tracked)
    split = rows.join(F.broadcast(winners), "text_sha256", "left")  # at most `frequent` rows
    hot = split.filter(F.col("__n").isNotNull())
    own = F.struct(F.col(id_column).alias("id"), F.col("__row").alias("r"))
    rest = split.filter(F.col("__n").isNull()).drop("__n", "__w")
    cold = rest.join(rest.groupBy("text_sha256").agg(F.max(own).alias("__w"), F.count(F.lit(1)).alias("__n")), "text_sha256")
    both = hot.unionByName(cold)
    return (
        both.withColumn("keep_id", F.col("__w.id")).withColumn("group_size", F.col("__n").cast("long")).withColumn("kept", F.col("__w.r") == F.col("__row"))
        .drop("__w", "__n", "__row")
    )


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", frequent: int = FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """One row of every text in ``docs``, with all its columns: the one with the largest id, any one of those that repeat it.

    Other cases are as in ``exact_groups``. Rows of frequent digests are settled where they are read, by the largest id
    of their digest; only rows that share text and that id meet, and of these one per task is sent on. Other rows
    are shuffled by digest. No row number is needed, so texts are written nowhere but in that shuffle.
    """
    digest = F.sha2(F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary"), 256)
    digests = settle(docs.select(digest.alias("text_sha256"), F.col(id_column).alias("w")), "exact-digests")
    winners = frequent_winners(digests, frequent, tracked)
    whole = docs.select(digest.alias("__digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all"))
    split = whole.join(F.broadcast(winners.withColumnRenamed("text_sha256", "__digest")), "__digest", "left")  # at most `frequent` rows
    own = F.col("__all").getField(id_column)
    hot = split.filter(F.col("__n").isNotNull() & own.eqNullSafe(F.col("__w"))).groupBy("__digest").agg(F.first("__all").alias("__all"))
    best = Window.partitionBy("__digest").orderBy(own.desc_nulls_last())
    cold = split.filter(F.col("__n").isNull()).withColumn("__nth", F.row_number().over(best)).filter("__nth = 1")
    return hot.select("__all.*").unionByName(cold.select("__all.*"))
