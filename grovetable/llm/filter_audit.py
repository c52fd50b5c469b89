"""How quality filters act together: survivors of every subset of filters from one count per part and mask.

Every document gets a mask with a bit for each filter that it fails, and documents are counted by part and
mask. The subset-zeta transform turns these counts into the survivors of all 32 subsets of filters: the
documents whose mask lies within the filters left out. A step of an order is then the difference
between two neighbouring subsets, for documents and for labelled ones alike, so that no document is
read again for any of the 120 orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, settle

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
COUNTED = ("n", "good", "toxic")


def _failing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, text as bytes) to (doc_id, part, mask of filters A to D, digest of the text)."""
    from hashlib import sha256

    follow, capitals = bytes(range(0x80, 0xC0)), bytes(range(65, 91))

    def read(text: bytes | None) -> tuple[int, bytes]:
        text = text or b""
        words = text.split()
        mask = len(words) < 200
        mask |= (100 * len(set(words)) < 50 * len(words)) << 1
        mask |= (100 * (len(text) - len(text.translate(None, capitals))) > 2 * len(text.translate(None, follow))) << 2
        mask |= (len(text.translate(None, b"#$%&*|")) < len(text)) << 3
        return mask, sha256(text).digest()

    for batch in batches:
        for part in by_bytes(batch, 2):
            made = [read(t) for t in part.column(2).to_pylist()]
            columns = [part.column(0), part.column(1), pa.array([m for m, _ in made], pa.int32()), pa.array([d for _, d in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "mask", "digest"])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by source and by the set of filters that they fail.

    A null text is empty and a null source is the empty part. A document fails E if its text is that of a document with a smaller
    doc_id; one without a doc_id neither fails E nor makes another fail, and has no labels. Rows that repeat a
    doc_id count each. A document is good (toxic) if any of its label rows says 1.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").cast("binary").alias("text")]
    read = settle(docs.select(*columns).mapInArrow(_failing, "doc_id long, part string, mask int, digest binary"), "audit-rows")
    # Rows alike are counted before they are shuffled; rows without a doc_id meet nothing and go past the joins.
    own = read.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")).filter("doc_id IS NOT NULL")
    unnamed = read.filter("doc_id IS NULL").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    # The first row of each text, joined by both keys: a text with very many copies is spread over its documents.
    firsts = read.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(k) for c, k in (("quality", "is_good"), ("toxic", "is_toxic"))])
    marked = own.join(firsts, ["digest", "doc_id"], "left").join(told, "doc_id", "left").withColumn("mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + 16))
    named = marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(f"is_{k}") == 1, F.col("n")).otherwise(0)).alias(k) for k in COUNTED[1:]])
    return named.unionByName(unnamed).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTED])


def zeta(counts: DataFrame, columns: tuple[str, ...], bits: int) -> DataFrame:
    """Arrays ``columns`` of 2 ** bits counts by mask become sums over all masks within each mask, a bit at a time."""
    for b in range(bits):
        bit = 1 << b
        step = lambda c: F.transform(F.col(c), lambda x, m: x + F.when(F.floor(m / bit) % 2 == 1, F.get(F.col(c), m - bit)).otherwise(F.lit(0)))
        counts = counts.select(*[k for k in counts.columns if k not in columns], *[step(c).alias(c) for c in columns])
    return counts


def survivors(counts: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays of the documents that survive each subset of filters, by the subset's mask."""
    wide = counts.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(ALL + 1)]).alias(c) for c in COUNTED])
    # Those who survive the filters of S fail only others: masks within the complement of S, which is the reversed place.
    return zeta(wide, COUNTED, len(FILTERS)).select("part", *[F.reverse(c).alias(c) for c in COUNTED])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for every part, order of the five filters and step, zeros included; columns and edge cases as in ``mask_counts``.

    ``kept`` and ``removed`` are documents after and at the step, ``redundant`` those who fail its filter and went
    earlier, ``unique_fails`` those who fail its filter only, ``good_lost`` and ``toxic_lost`` labelled documents removed
    at the step, ``shapley`` the filter's ``removed`` summed over all orders. An empty table has no part and gives no rows.
    """
    alive = survivors(mask_counts(docs, labels))
    at = lambda c, s: F.get(F.col(c), s if isinstance(s, Column) else F.lit(s))
    n = len(FILTERS)

    def over_orders(f: int) -> Column:
        """A subset stands before the filter in |subset|! * (n - 1 - |subset|)! orders."""
        rest = [s for s in range(ALL + 1) if not s >> f & 1]
        parts = [(at("n", s) - at("n", s | 1 << f)) * F.lit(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in rest]
        return sum(parts[1:], parts[0])

    sums = alive.withColumn("orders", F.array(*[over_orders(f) for f in range(n)])).withColumn("alone", F.array(*[at("n", ALL ^ 1 << f) - at("n", ALL) for f in range(n)])).withColumn("failing", F.array(*[at("n", 0) - at("n", 1 << f) for f in range(n)]))
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    own_bit = lambda c: F.pow(F.lit(2), F.instr(F.lit(FILTERS), c) - 1).cast("int")
    steps = sums.withColumn("filter_order", F.explode(orders)).withColumn("letters", F.split("filter_order", "")).select("*", F.posexplode("letters").alias("place", "letter"))
    each = steps.withColumn("before", F.aggregate(F.slice("letters", F.lit(1), F.col("place")), F.lit(0), lambda a, c: a + own_bit(c))).withColumn("after", F.col("before") + own_bit(F.col("letter"))).withColumn("f", F.instr(F.lit(FILTERS), F.col("letter")) - 1).withColumn("step", F.col("place") + 1)
    lost = lambda c: at(c, F.col("before")) - at(c, F.col("after"))
    return each.select(
        "part", "filter_order", "step", at("n", F.col("after")).alias("kept"), lost("n").alias("removed"), (at("failing", F.col("f")) - lost("n")).alias("redundant"), at("alone", F.col("f")).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), at("orders", F.col("f")).cast("long").alias("shapley"),
    )
