"""Exact joins of documents by the Jaccard similarity of their word shingles, as a join in a metric space.

The sets' sizes of symmetric differences are a metric, and so is one minus the Jaccard similarity. Two linked sets
of n and m shingles differ in at most (n + m) * (1 - s) / (1 + s) shingles: their reach.

First the empty set is the pivot: a set's distance to it is its size, rings of sizes are the regions, and a set within reach
of a larger ring goes there too. Distances between unrelated documents are all close to one, so that no
document can be a pivot for all of a ring: windows around it would hold the whole ring. A ring is therefore looked at in more parts
of the shingle space than its reach has shingles. By the triangle inequality, summed over parts, two linked sets have
distance zero in some of them; the content of a part is the region there.

Regions with many members take some of their own documents as pivots: every member goes to the region of its nearest one, and to those
of all others not further than that by twice the radius. So linked members share a region, and regions that are still
large are split again. Members within the radius of a pivot are linked to it, and regions whose members are all in one component need no pairs.
Regions with few members are joined pair by pair, without pairs that are in one component by then; the counts of a set's shingles
in 64 cells are its coordinates, and by the same inequality pairs whose coordinates differ by more than their reach are left out before whole sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near
from .common import discard, settle
from .components import connect

#: Rings of sizes grow by this factor.
RING = 1.25
#: Cells of the coordinates.
CELLS = 64
#: Larger regions are split around pivots.
DENSE = 16
PIVOTS = 8


def rings(percent: int) -> list[tuple[int, int, int]]:
    """(least size, reach, parts) of every ring. There are more parts than the reach by a quarter, and one at least."""
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RING)))
    out = []
    for low, above in zip(edges, edges[1:]):
        reach = 2 * (above - 1) * (100 - percent) // (100 + percent)
        out.append((low, reach, reach + 1 + max(1, reach // 4)))
    return out


def regions_of(own, percent: int, table: list[tuple[int, int, int]]):
    """Regions of a sorted set of hashes: for its ring and those within reach, the contents of all but its lightest parts.

    Linked sets have parts - reach equal parts at least; each leaves out parts - reach - 1 of its lightest (by shingles,
    then number), so the heaviest of the equal ones is left out by neither.
    """
    import bisect

    import numpy as np

    n, made = len(own), []
    at = bisect.bisect_right(table, n, key=lambda r: r[0]) - 1
    k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
    mixed = own * k1
    mixed ^= mixed >> np.uint64(29)
    mixed *= k3
    while at < len(table) and 100 * n >= percent * table[at][0]:
        low, reach, parts = table[at]
        if reach:  # sets in a ring without reach are linked only if equal
            part = ((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            counts = np.bincount(part.astype(np.int64), minlength=parts)
            order = np.argsort(part, kind="stable")
            held = np.nonzero(counts)[0]
            sums = np.zeros(parts, dtype=np.uint64)
            sums[held] = np.add.reduceat(mixed[order], np.concatenate(([0], np.cumsum(counts[held])[:-1])))
            x = sums + np.arange(parts, dtype=np.uint64) * k2 + np.uint64(at * int(k3) & (1 << 64) - 1)
            x ^= x >> np.uint64(33)
            x *= k1
            x ^= x >> np.uint64(29)
            made.append(x[np.argsort(counts, kind="stable")[parts - reach - 1 :]])
        at += 1
    return np.concatenate(made) if made else np.zeros(0, np.uint64)


def _reading(shingle: int, percent: int):
    """Batches of (doc_id, row, text) to the set's key, size, coordinates and regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest

        table = rings(percent)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, sizes, coordinates, held = [], [], [], []
                for text in part.column(2).to_pylist():
                    own = near.shingle_hashes(text, shingle)
                    blank = len(own) == 1 and not (text or "").encode("utf-8", "surrogatepass").split()
                    keys.append(xxh64_intdigest(own.tobytes()))
                    sizes.append(0 if blank else len(own))
                    coordinates.append(np.minimum(np.bincount((own & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), 255).astype("u1").tobytes())
                    held.append(np.zeros(0, np.uint64) if blank else regions_of(own, percent, table))
                offsets = np.concatenate(([0], np.cumsum([len(h) for h in held]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(coordinates, pa.binary()), lists], names=["doc_id", "row", "key", "n", "cells", "regions"])

    return run


def _within(percent: int):
    """Pairs (a, b, n, m, cells of both) whose coordinates leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                cells = [np.frombuffer(b"".join(batch.column(i).to_pylist()), "u1").reshape(-1, CELLS).astype(np.int16) for i in (4, 5)]
                n, m = (batch.column(i).to_numpy() for i in (2, 3))
                least = np.abs(cells[0] - cells[1]).sum(1, dtype=np.int64)
                keep = (least * (100 + percent) <= (n + m) * (100 - percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


class _Corpus:
    """Distinct sets ``heads`` (key, row, n, cells) and their rows' texts ``numbered`` (row, text)."""

    def __init__(self, heads: DataFrame, numbered: DataFrame, percent: int, shingle: int):
        self.heads, self.numbered, self.percent, self.shingle = heads, numbered, percent, shingle
        self.radius = 1 - percent / 100

    def likely(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) that their coordinates leave, each once."""
        own = self.heads.select("key", "n", "cells")
        x, y = own.toDF("a", "n", "c"), own.toDF("b", "m", "d")
        return settle(pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "n", "m", "c", "d").mapInArrow(_within(self.percent), "a long, b long"), "jaccard-likely")

    def similarities(self, pairs: DataFrame) -> DataFrame:
        return near._similarities(pairs, self.heads, self.numbered, self.shingle)

    def linked(self, known: DataFrame) -> DataFrame:
        # Quotients of whole numbers are rounded alike, so one of exactly the limit is not below it.
        return known.filter(F.col("sim") >= self.percent / 100).select("a", "b")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _around_pivots(members: DataFrame, level: int, corpus: _Corpus) -> tuple[DataFrame, DataFrame]:
    """Links of ``members`` (region, key, n) to their pivots, and the regions (region, pivot, key, n, parent) around these."""
    shared = members.groupBy("key").agg(F.floor(F.log2(F.count(F.lit(1)))).alias("groups"))
    # Members of many regions come first, so that regions of the same documents have the same pivots.
    order = lambda i: F.struct(-F.col("groups"), F.xxhash64("key", F.lit(level * PIVOTS + i)), F.col("key").alias("x"))
    chosen = members.join(shared, "key").groupBy("region").agg(*[F.min(order(i))["x"].alias(f"m{i}") for i in range(PIVOTS)], F.count(F.lit(1)).alias("parent"))
    chosen = settle(chosen.select("region", "parent", F.posexplode(F.array_distinct(F.array(*[f"m{i}" for i in range(PIVOTS)]))).alias("i", "pivot")), "jaccard-pivots")
    met = members.join(chosen, "region")
    known = corpus.similarities(settle(met.filter("key <> pivot").select(*_pair("key", "pivot")).distinct(), "jaccard-asked"))
    far = met.select("*", *_pair("key", "pivot")).join(known, ["a", "b"], "left").select("region", "parent", "i", "pivot", "key", "n", F.when(F.expr("key = pivot"), 0.0).otherwise(1 - F.col("sim")).alias("d"))
    far = settle(far, "jaccard-distances")
    # A pivot within twice the radius of an earlier one would get much the same members again.
    twin = chosen.select("region", F.col("i").alias("j"), F.col("pivot").alias("key")).join(far, ["region", "key"]).filter("i < j").groupBy("region", "j").agg(F.min("d").alias("gap")).filter(F.col("gap") <= 2 * corpus.radius)
    used = far.join(twin.select("region", F.col("j").alias("i")), ["region", "i"], "left_anti")
    home = used.groupBy("region", "key").agg(F.min("d").alias("home"))
    around = used.join(home, ["region", "key"]).filter(F.col("d") <= F.col("home") + 2 * corpus.radius + 1e-9)
    split = settle(around.select(F.xxhash64("region", "pivot").alias("region"), "pivot", "key", "n", "parent"), "jaccard-regions")
    discard(far)
    return corpus.linked(known), split


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of regions that hold more than one component, with ``root``, ``most`` (a root of the region) and ``size``."""
    placed = members.join(labels.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sums = placed.groupBy("region", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("region").agg(F.max(F.struct("c", "root"))["root"].alias("most"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("roots"))
    return settle(placed.join(settle(sums.filter("roots > 1"), "jaccard-open"), "region"), "jaccard-apart")


def _between(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``members`` (region, key, root) of one region and different components."""
    met = members.alias("l").join(members.alias("r"), F.expr("l.region = r.region AND l.key < r.key AND l.root <> r.root"))
    return met.select(F.col("l.key").alias("a"), F.col("r.key").alias("b"))


def _links(grouped: DataFrame, corpus: _Corpus) -> DataFrame:
    """(node, root) of all sets linked to another, from ``grouped`` (region, key, members). Large regions come first: what they link needs no pairs in small ones."""
    regions = settle(grouped.filter(F.col("members") > DENSE).select("region", "key").join(corpus.heads.select("key", "n"), "key"), "jaccard-large")
    links, asked, level, labels = [], [], 0, None
    while not regions.isEmpty():
        found, split = _around_pivots(regions, level, corpus)
        links.append(found)
        labels = connect(reduce(DataFrame.union, links), "jaccard")
        apart = _apart(split, labels)
        asked.append(corpus.likely(_between(apart.filter(F.col("size") <= DENSE))))
        # Regions that a split has not halved hold members too alike for another: their differences to the pivot are joined.
        tight = apart.filter((F.col("size") > DENSE) & (2 * F.col("size") > F.col("parent")))
        members = tight.groupBy("pivot", "key", "n", "root").agg(F.max(F.col("root") != F.col("most")).alias("lone"))
        if not members.isEmpty():
            asked.append(corpus.likely(near._close(members, corpus.heads, corpus.numbered, corpus.percent / 100, corpus.shingle)))
        regions = settle(apart.filter((F.col("size") > DENSE) & (2 * F.col("size") <= F.col("parent"))).select("region", "key", "n"), "jaccard-large")
        level += 1
    few = grouped.filter(F.col("members") <= DENSE).select("region", "key")
    few = few.withColumn("root", F.col("key")) if labels is None else few.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    asked.append(corpus.likely(_between(few)))
    more = settle(reduce(DataFrame.union, asked).distinct(), "jaccard-more") if len(asked) > 1 else asked[0]
    if not more.isEmpty():
        links.append(corpus.linked(corpus.similarities(more)))
        labels = connect(reduce(DataFrame.union, links), "jaccard")
    return corpus.heads.select(F.col("key").alias("node"), F.col("key").alias("root")).limit(0) if labels is None else labels


def jaccard_components(docs: DataFrame, percent: int = 90, shingle: int = 3) -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id (smallest doc_id reachable, itself included) for every row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * intersection >= ``percent`` * union of their sets of distinct word shingles, at 50 to 99 percent. A-Z are
    lower-cased; fewer words than a shingle are one, a text without words (or null) has none and is linked with nothing. Equal sets are
    one set, however many rows share it. A component without any doc_id has null; an empty table gives no rows; other columns are ignored.
    Shingles and sets are told apart by 64-bit hashes.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    rows = near._numbered(docs, *columns)
    texts = rows.select(F.col("__row").alias("row"), "text")
    prints = settle(rows.select("doc_id", F.col("__row").alias("row"), "text").mapInArrow(_reading(shingle, percent), "doc_id long, row long, key long, n long, cells binary, regions array<long>"), "jaccard-prints")
    heads = prints.filter("n > 0").groupBy("key").agg(F.min("row").alias("row"), F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "cells", "regions")])
    heads = settle(heads, "jaccard-sets")
    placed = heads.select("key", F.explode("regions").alias("region"))
    sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    grouped = settle(placed.join(sizes, "region"), "jaccard-groups")
    labels = _links(grouped, _Corpus(heads.drop("first", "regions"), texts, percent, shingle))
    named = settle(heads.select("key", "first").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "jaccard-roots")
    least = settle(named.groupBy("root").agg(F.min("first").alias("component_id")), "jaccard-least")
    lookup = settle(named.join(least, "root").select("key", "component_id"), "jaccard-lookup")
    out = prints.select("doc_id", "key", F.col("n").alias("n_shingles"))
    alone = out.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.filter("n_shingles > 0").join(lookup, "key").select("doc_id", "n_shingles", "component_id").unionByName(alone)
