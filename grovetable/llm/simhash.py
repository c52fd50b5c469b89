"""SimHash near-duplicates through pivot distance tables.

A fingerprint's row in the pivot table is its Hamming distances to many reference fingerprints.
By the triangle inequality two fingerprints at most ``k`` bits apart differ by at most ``k`` in
every coordinate. The references come in families, each varying in one block of bits only, so
the coordinates of a family, taken against the all-zero reference's, depend on that block alone. Two
differing bits touch two blocks at most: the coordinates of all other families are equal, and
pairs meet by an equality join on them. Of these pairs the table discards those that differ by more
than ``k`` in some coordinate, and survivors are verified bit by bit. Groups of equal coordinates
that are too large go through a second table, whose families vary in blocks of four bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle
from .components import connect

#: Bits of a block in the first and in the second pivot table.
COARSE, FINE = 16, 4
#: Larger groups go through the second table, whose groups hold 256 at most: what two blocks of four bits can be.
DENSE = 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references(block: int) -> list[list[int]]:
    """Reference fingerprints, a family for every block of ``block`` bits: rows of a Hadamard matrix in it, read as bits."""
    row = lambda r: sum((bin(r & c).count("1") & 1) << c for c in range(block))
    rows = (1, 2, 4, 8, 3, 5, 9, 6, 10, 12, 7, 15) if block == COARSE else range(1, block)
    return [[row(r) << at for r in rows] for at in range(0, 64, block)]


def _fingerprinting(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import numpy as np
        from xxhash import xxh64_intdigest

        lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        word = re.compile(rb"[^ \t-\r]+").finditer

        def fingerprint(text: str | None) -> int:
            words = (text or "").encode("utf-8", "surrogatepass").translate(lower).split()
            if not words:
                return 0
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            if len(words) < shingle:
                starts, ends = starts[:1], ends[-1:]
            else:
                starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
            hashes = np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())), dtype="<u8", count=len(starts))
            votes = np.zeros(64, dtype=np.int64)
            for at in range(0, len(hashes), 4096):
                bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                votes += bits.sum(axis=0, dtype=np.int64)
            return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])

        for batch in batches:
            prints = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and 64-bit fingerprint (as a signed long) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprinting(shingle), "doc_id long, fp long")


def pivot_table(prints: DataFrame, block: int = COARSE) -> DataFrame:
    """``prints`` with ``pivots``: distances of ``fp`` to every reference fingerprint, the all-zero one last, eight to a long."""
    flat = [r for family in references(block) for r in family] + [0]
    near = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(r)))).cast("long") for r in flat]
    longs = []
    for at in range(0, len(near), 8):
        packed = F.lit(0).cast("long")
        for k, d in enumerate(near[at : at + 8]):
            packed = packed.bitwiseOR(F.shiftleft(d, 8 * k))
        longs.append(packed.alias(f"l{at // 8}"))
    return prints.select("*", F.struct(*longs).alias("pivots"))


def coordinate(pivots: str, k: int) -> Column:
    """The k-th distance in a column of packed pivots."""
    return F.shiftrightunsigned(F.col(f"{pivots}.l{k // 8}"), 8 * (k % 8)).bitwiseAND(F.lit(255).cast("long"))


def largest_difference(a: str, b: str, block: int) -> Column:
    """The largest coordinate difference of two rows of a pivot table."""
    n = sum(map(len, references(block))) + 1
    return F.greatest(*[F.abs(coordinate(a, k) - coordinate(b, k)) for k in range(n)])


def meetings(table: DataFrame, block: int, differing: int, *carried: str) -> DataFrame:
    """(``carried``, sig): one signature for every choice of all families but ``differing``, from their coordinates in ``table``. Rows that share one agree in these families."""
    families = references(block)
    n = sum(map(len, families))
    zero = coordinate("pivots", n)
    hashed, at = [], 0
    for i, family in enumerate(families):
        hashed.append(F.xxhash64(F.lit(i), *[coordinate("pivots", k) - zero for k in range(at, at + len(family))]).alias(f"h{i}"))
        at += len(family)
    step = table.select(*carried, *hashed)
    # Wrapping sums of the families' hashes, less those that may differ.
    total = F.lit(0).cast("long")
    for i in range(len(families)):
        total = total.bitwiseXOR(F.col(f"h{i}"))
    step = step.withColumn("all", total)
    left_out = list(combinations(range(len(families)), differing))
    sigs = []
    for c in left_out:
        rest = F.col("all")
        for i in c:
            rest = rest.bitwiseXOR(F.col(f"h{i}"))
        sigs.append(F.xxhash64(rest, F.lit(str(c))))
    return step.select(*carried, F.explode(F.array(*sigs)).alias("sig"))


def _verified(groups: DataFrame, table: DataFrame, block: int, max_bits: int) -> DataFrame:
    """Links (a, b) among the members of ``groups`` (sig, fp): discarded by the table, then verified bit by bit."""
    own = groups.select("sig", "fp").join(table, "fp")
    pairs = own.alias("l").join(own.alias("r"), F.expr("l.sig = r.sig AND l.fp < r.fp"))
    near = pairs.filter(largest_difference("l.pivots", "r.pivots", block) <= max_bits)
    return near.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def near_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """All links (a, b), a < b, between distinct fingerprints ``fp`` at most ``max_bits`` (0 to 2) apart.

    Groups of up to DENSE members are joined with themselves. Members of larger ones take the second table,
    where 14 of 16 families must agree: such a group has 256 members at most, so none grows with the input.
    """
    table = settle(pivot_table(prints), "simhash-pivots")

    def grouped(t: DataFrame, block: int) -> DataFrame:
        met = settle(meetings(t, block, max(1, max_bits), "fp"), "simhash-signatures")
        sizes = met.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        out = settle(met.join(sizes, "sig"), "simhash-groups")
        discard(met)
        return out

    coarse = grouped(table, COARSE)
    links = _verified(coarse.filter(F.col("n") <= DENSE), table, COARSE, max_bits)
    crowded = settle(pivot_table(coarse.filter(F.col("n") > DENSE).select("fp").distinct(), FINE), "simhash-crowded")
    fine = grouped(crowded, FINE)
    return links.union(_verified(fine, crowded, FINE, max_bits)).distinct()


def simhash_components(docs: DataFrame, max_bits: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row of ``docs`` (doc_id, text).

    Null and wordless texts have fingerprint zero and are linked like any other; texts shorter than
    a shingle are one shingle; rows that repeat keep their number; an empty table gives no rows;
    other columns are ignored.
    """
    rows = settle(fingerprints(docs, shingle), "simhash-prints")
    firsts = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    links = near_links(firsts.select("fp"), max_bits)
    labels = connect(links, "simhash")  # node, root
    named = (
        firsts.join(labels, firsts.fp == labels.node, "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    lookup = settle(named.join(smallest, "root").select("fp", "component_id"), "simhash-lookup")
    return rows.join(lookup, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
