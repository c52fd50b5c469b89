"""Mixing sources to target weights.

Documents get hash-random keys; within each source they lie in the order of these keys, and a
distributed prefix sum of their sizes says where each one starts. A source's budget is that
many whole epochs and a rest, and the rest is cut at exactly its last word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, group_key, prefix_sums, settle, words_of

#: Weights by a source's place in code point order, null last, over and over.
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its size.
MAX_EPOCHS = 3


def mix_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to a table of sources (source_key, source_size).

    Targets share the sum of all sizes by weight; a target stops at ``max_epochs`` times its source's size and
    the excess is shared again by weight until none is above. In closed form: with sources in order of
    capacity per weight, the first ones are capped, and the others share what is left.
    """
    everything = Window.partitionBy()  # one row per source
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(Window.orderBy("source_key")) - 1, F.lit(len(weights))).cast("int") + 1))
    by = Window.orderBy("ratio", "source_key")
    filled = (
        ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("before")) / F.col("weight_left"))
        .withColumn("free", F.col("level") <= F.col("ratio"))
        .withColumn("lambda", F.min(F.when(F.col("free"), F.struct("ratio", "source_key", "level"))).over(everything)["level"])
    )
    return filled.select("source_key", "source_size", F.coalesce(F.least("cap", F.col("lambda") * F.col("w")), F.col("cap")).alias("target"))


def _placed(rows: DataFrame, seed: int, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """rows (doc_id, source_key, size, row) with start, source_size and target."""
    sizes = settle(mix_targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, max_epochs), "mix-targets")
    keyed = rows.withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    return prefix_sums(keyed, "source_key", "key", ["doc_id", "size", "row"], "size", "start").join(sizes, "source_key")


def taken(size: Column, start: Column, source_size: Column, target: Column) -> Column:
    """Words that the mix takes of a document, repeats counted."""
    budget = F.round(target).cast("long")
    epochs = F.expr("0L") + F.floor(budget / F.greatest(source_size, F.lit(1))).cast("long")
    rest = budget - epochs * source_size
    return (epochs * size + F.greatest(F.lit(0), F.least(size, rest - start))).cast("long")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) for every row of ``docs`` (doc_id, text, source).

    Size is the text's number of words, 0 for null. A null source is a source of its own, last in order;
    empty texts take part with nothing to take; repeated rows count each for itself; an empty table gives no rows;
    other columns are ignored. Reruns agree.
    """
    rows = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            group_key(F.col("source")).alias("source_key"),
            F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-sizes",
    )
    placed = _placed(rows, seed, weights, max_epochs)
    return placed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken(F.col("size"), F.col("start"), F.col("source_size"), F.col("target")).alias("taken"), "source_key")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 11) -> DataFrame:
    """The mix itself: rows of ``docs`` once per epoch, all columns kept; the last row of a budget has its text cut to the words taken.

    A document without words that no epoch repeats is left in once, since it costs nothing. A cut
    text has its words joined by one blank.
    """
    # Row numbers depend on how the input is split, so they are written with their rows and never worked out again.
    numbered = settle(
        docs.withColumn("__key", group_key(F.col("source")))
        .withColumn("__size", F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long"))
        .withColumn("__row", F.monotonically_increasing_id()),
        "mix-rows",
    )
    rows = numbered.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__key").alias("source_key"), F.col("__size").alias("size"), F.col("__row").alias("row"))
    placed = _placed(rows, seed, weights, max_epochs)
    plan = placed.select(F.col("row").alias("__row"), "size", taken(F.col("size"), F.col("start"), F.col("source_size"), F.col("target")).alias("__taken"))
    plan = settle(plan.filter("__taken > 0 OR size = 0").drop("size"), "mix-plan")
    joined = numbered.hint("merge").join(plan, "__row")  # as at scale, where the plan is too large to send to every task
    turns = F.when(F.col("__size") == 0, F.lit(1)).otherwise(F.ceil(F.col("__taken") / F.greatest(F.col("__size"), F.lit(1)))).cast("int")
    times = joined.withColumn("__turn", F.explode(F.sequence(F.lit(1), turns)))
    left = F.col("__taken") - (F.col("__turn") - 1) * F.col("__size")
    text = F.when(left < F.col("__size"), F.array_join(F.slice(words_of(F.col("text").cast("string")), F.lit(1), F.greatest(left, F.lit(1)).cast("int")), " ")).otherwise(F.col("text"))
    return times.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
