"""Near copies by the Jaccard similarity of their word shingles, met through the pivot tables of ``simhash.py``.

Texts of similarity 0.8 differ by about 10 bits of their SimHashes, more than any block of bits is spared. So every text
also gets PRINTS independent min-wise fingerprints of its shingle set: 64 bits in four blocks, each a hash of BLOCK_ROWS
minima, which two sets of similarity s have in common with chance q = s ** BLOCK_ROWS. Their rows in the pivot table have equal coordinates
in the families of the blocks that agree. Texts that agree in two of four families of some fingerprint are candidates: a
chance of 0.9993 at s = 0.8 and more above. Those go by set size (exact), and bit by bit by their SimHashes with a radius four
standard deviations beyond what similarity 0.8 makes; the survivors are decided by their whole shingle sets.

Large groups have reference members: every member is compared with them, and members linked to one are in
one component. A member of another component meets the others by their differences to a reference
that groups of the same copies share, under a bound (``_close``) that leaves out only pairs that cannot be linked. So no link of a group is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import discard, settle
from .components import connect

#: Min-wise fingerprints of a text, minima to a block, and families of the pivot table that may differ.
PRINTS = 6
BLOCK_ROWS = 3
DIFFERING = 2
#: Sets of similarity 0.8 differ in 9.7 of 64 SimHash bits on average, with a standard deviation of 2.9.
RADIUS = 22
#: Larger groups have reference members, so that no group of copies costs its square.
DENSE = 64
#: Reference members of a large group.
PIVOTS = 4
#: Tasks that the set of a group's reference is sent to.
SPREAD = 64
#: Members of a large group that those meet first who are linked to no reference.
DRAWN = 8


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str | None, shingle: int):
    """Sorted distinct hashes of a text's word shingles; a text up to a shingle long is one."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(line, 42)], dtype="<u8")
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())), dtype="<u8", count=len(starts)))


def _reading(shingle: int, whole: bool):
    """Batches of (row, text) to fingerprints, or to the whole shingle sets."""
    depth, bits = BLOCK_ROWS, simhash.COARSE
    blocks = 64 // bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest

        factors, masks = (np.array([xxh64_intdigest(b"%d" % i, s) for i in range(PRINTS * blocks * depth)], dtype=np.uint64) for s in (1, 2))
        factors |= np.uint64(1)

        def prints(own: np.ndarray) -> tuple[int, list[int]]:
            votes = np.zeros(64, dtype=np.int64)
            least = np.full(PRINTS * blocks * depth, np.iinfo(np.uint64).max, dtype=np.uint64)
            for at in range(0, len(own), 1024):
                part = own[at : at + 1024]
                votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                np.minimum(least, ((part[:, None] ^ masks) * factors).min(axis=0), out=least)
            fp = int(np.packbits(2 * votes > len(own), bitorder="little").view("<i8")[0])
            hashed = [xxh64_intdigest(least[b * depth : (b + 1) * depth].tobytes(), b) % (1 << bits) for b in range(PRINTS * blocks)]
            return fp, [sum(h << bits * j for j, h in enumerate(hashed[i : i + blocks])) for i in range(0, len(hashed), blocks)]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_hashes(t, shingle) for t in part.column(1).to_pylist()]
                keys = pa.array(np.array([xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64))
                if whole:
                    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], names=["key", "shingles"])
                    continue
                made = [prints(s) for s in sets]
                minwise = np.array([m[1] for m in made], dtype=np.uint64).view(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * PRINTS), pa.array(minwise))
                yield pa.RecordBatch.from_arrays([part.column(0), keys, pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in made], pa.int64()), lists], names=["row", "key", "n", "fp", "bands"])

    return run


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    return texts.select(F.lit(0).cast("long").alias("row"), "text").mapInArrow(_reading(shingle, True), "key long, shingles array<long>")


def _similarities(pairs: DataFrame, heads: DataFrame, numbered: DataFrame, shingle: int) -> DataFrame:
    """``pairs`` (a, b) of keys with ``sim``, the Jaccard similarity of their whole shingle sets."""
    asked = heads.join(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "key").select("row")
    sets = settle(_sets(numbered.select("row", "text").join(asked, "row", "left_semi"), shingle), "near-sets")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    out = settle(both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("sim")), "near-similar")
    discard(sets)
    return out


def _fits(x: str, y: str, similarity: float) -> Column:
    """Whether sizes and SimHashes leave room for the similarity."""
    return (F.least(f"{x}.n", f"{y}.n") >= similarity * F.greatest(f"{x}.n", f"{y}.n")) & (F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) <= RADIUS)


def _pairs(frame: DataFrame) -> DataFrame:
    return frame.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def _close(members: DataFrame, heads: DataFrame, numbered: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Pairs (a, b) of a lone member and another of the same ``pivot`` that can be linked; ``members`` has (pivot, key, n, root, lone).

    A member is held as its difference to the pivot: the shingles that one has and the other has not. Two sets of n
    and m shingles are linked if they differ in at most (n + m) * (1 - s) / (1 + s); they differ in what lies in one of
    their two differences alone, so the differences must have ``least`` shingles in common. With all differences sorted in the same
    order, rare shingles first, two that do have one in common before their last ``least`` - 1. Where ``least`` is not
    positive the pair is linked for sure; then both are also linked to the member with most room, which stands for all these pairs.
    """
    part = (1 - similarity) / (1 + similarity)
    asked = heads.join(members.select("key").union(members.select("pivot")).distinct(), "key", "left_semi").select("row")
    sets = settle(_sets(numbered.select("row", "text").join(asked, "row", "left_semi"), shingle), "near-sets")
    # A reference's set goes to SPREAD tasks, so that a large group's members do not all meet it in one.
    salted = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SPREAD)).cast("int"))
    references = members.select("pivot").distinct().withColumnRenamed("pivot", "key").join(sets, "key").select(F.col("key").alias("pivot"), F.col("shingles").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    both = salted.join(references, ["pivot", "salt"]).drop("salt").join(sets.select("key", F.col("shingles").alias("x")), "key")
    held = settle(both.select("pivot", "key", "n", "root", "lone", F.concat(F.array_except("x", "p"), F.array_except("p", "x")).alias("differs")), "near-differences")
    discard(sets)
    sized = held.withColumn("d", F.size("differs"))
    spread = sized.select("pivot", "key", "n", "root", "lone", "d", F.explode("differs").alias("shingle"))
    common = spread.groupBy("pivot", "shingle").agg(F.count(F.lit(1)).alias("having"))
    place = F.row_number().over(Window.partitionBy("pivot", "key").orderBy("having", "shingle"))
    fewest = F.greatest(F.lit(1.0), F.ceil((F.col("d") - part * F.col("n") * (1 + 1 / similarity)) / 2 - 1e-9))
    front = settle(spread.join(common, ["pivot", "shingle"]).withColumn("at", place).filter((F.col("having") > 1) & (F.col("at") <= F.col("d") - fewest + 1)).drop("having"), "near-front")
    least = F.greatest(F.lit(1.0), F.ceil((F.col("l.d") + F.col("r.d") - part * (F.col("l.n") + F.col("r.n"))) / 2 - 1e-9))
    fits = (F.col("l.at") <= F.col("l.d") - least + 1) & (F.col("r.at") <= F.col("r.d") - least + 1) & (F.least("l.n", "r.n") >= similarity * F.greatest("l.n", "r.n"))
    met = front.filter("lone").alias("l").join(front.alias("r"), F.expr("l.pivot = r.pivot AND l.shingle = r.shingle AND l.root <> r.root") & fits).select(F.col("l.key").alias("x"), F.col("r.key").alias("y"))
    room = sized.select("pivot", "key", (part * F.col("n") - F.col("d")).alias("room"))
    widest = room.groupBy("pivot").agg(F.max(F.struct("room", "key")).alias("w"))
    sure = room.join(widest, "pivot").filter(F.expr("key <> w.key AND room + w.room >= -1e-9")).select(F.col("key").alias("x"), F.col("w.key").alias("y"))
    out = settle(met.union(sure).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-close")
    discard(held)
    discard(front)
    return out


def _apart(many: DataFrame, labels: DataFrame, first: DataFrame) -> DataFrame:
    """Members of large groups that are in more than one component, with ``root``, ``most``, the root of most of the group, and what ``first`` has of the group."""
    placed = many.select("sig", "key", "n", "fp").join(labels.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sums = placed.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("sig").agg(F.max(F.struct("c", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("parts"))
    return settle(placed.join(sums.filter("parts > 1").drop("parts").join(first, "sig"), "sig"), "near-apart")


def _signatures(heads: DataFrame) -> DataFrame:
    """(key, sig) of every key of ``heads`` (key, bands): keys that share one agree in two families of the pivot table of a min-wise fingerprint."""
    table = settle(simhash.pivot_table(heads.select("key", F.posexplode("bands").alias("i", "fp"))).drop("fp"), "near-pivots")
    out = settle(simhash.meetings(table, simhash.COARSE, DIFFERING, "key", "i").select("key", F.xxhash64("i", "sig").alias("sig")), "near-signatures")
    discard(table)
    return out


def _shared_pivots(apart: DataFrame) -> DataFrame:
    """(sig, pivot) for the groups of ``apart`` (sig, key, first, support), from their first references.

    Of the references of all its groups a member votes for the one with most support, and a group takes what most members
    vote for, member or not. So groups of the same copies have one reference, and a member's differences to it are held once.
    """
    best = apart.groupBy("key").agg(F.max(F.struct("support", "first")).alias("best"))
    votes = apart.select("sig", "key").join(best, "key").groupBy("sig", "best").agg(F.count(F.lit(1)).alias("c"))
    return votes.groupBy("sig").agg(F.max(F.struct("c", "best"))["best"]["first"].alias("pivot"))


def _roots(heads: DataFrame, numbered: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(key, root): the smallest key that each key of ``heads`` is linked to, itself if there is none."""
    signed = _signatures(heads)
    sizes = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    grouped = settle(signed.join(sizes, "sig").join(heads.select("key", "n", "fp"), "key"), "near-groups")
    discard(signed)
    member = F.struct("key", "n", "fp")
    few = grouped.filter(F.col("members") <= DENSE)
    pairs = few.alias("x").join(few.alias("y"), F.expr("x.sig = y.sig AND x.key < y.key"))

    # Large groups: similarities to reference members. One is the member that shares most with most others;
    # the rest are drawn from those that lie in most large groups, so that groups of the same copies have the same ones.
    many = grouped.filter(F.col("members") > DENSE)
    central = many.groupBy("key").agg(F.sum("members").alias("support"), F.count(F.lit(1)).alias("groups"))
    order = lambda i: F.struct(-F.col("groups" if i else "support"), F.xxhash64("key", F.lit(i)), F.struct("key", "n", "fp", "support").alias("x"))
    chosen = many.join(central, "key").groupBy("sig").agg(*[F.min(order(i))["x"].alias(f"m{i}") for i in range(PIVOTS)])
    chosen = settle(chosen.select("sig", F.posexplode(F.array(*[f"m{i}" for i in range(PIVOTS)])).alias("i", "y")).select("sig", "i", "y.*"), "near-chosen")
    met = settle(_pairs(many.alias("x").join(chosen.alias("y"), F.expr("x.sig = y.sig AND x.key <> y.key")).filter(_fits("x", "y", similarity))), "near-met")
    asked = settle(_pairs(pairs.filter(_fits("x", "y", similarity))).union(met).distinct(), "near-pairs")
    known = _similarities(asked, heads, numbered, shingle)
    links = known.filter(F.col("sim") >= similarity).select("a", "b")
    labels = connect(links, "near")  # node, root

    # Members that are still apart from most of a large group meet more of it: first a few drawn from each group ...
    first = chosen.filter("i = 0").select("sig", F.col("key").alias("first"), "support")
    apart = _apart(many, labels, first)
    drawn = many.groupBy("sig").agg(*[F.min(F.struct(F.xxhash64("key", "sig", F.lit(i)), member.alias("x")))["x"].alias(f"m{i}") for i in range(DRAWN)])
    drawn = drawn.select("sig", F.explode(F.array(*[f"m{i}" for i in range(DRAWN)])).alias("y")).select("sig", "y.*")
    lone = apart.filter("root <> most")
    some = settle(_pairs(lone.alias("x").join(drawn.alias("y"), F.expr("x.sig = y.sig AND x.key <> y.key")).filter(_fits("x", "y", similarity))).join(asked, ["a", "b"], "left_anti"), "near-some")
    if not some.isEmpty():
        links = links.union(_similarities(some, heads, numbered, shingle).filter(F.col("sim") >= similarity).select("a", "b"))
        labels = connect(links, "near")
        still = _apart(apart, labels, first)  # components only grow together, so no other group is apart now
        discard(apart)
        apart = still
    # ... then all that the differences to a reference leave.
    # A member lies in many groups, so the join by group is made once and its few distinct rows are kept.
    members = settle(apart.join(_shared_pivots(apart), "sig").groupBy("pivot", "key", "n", "root").agg(F.max(F.col("root") != F.col("most")).alias("lone")), "near-members")
    more = settle(_close(members, heads, numbered, similarity, shingle).join(asked.union(some), ["a", "b"], "left_anti"), "near-more")
    if more.isEmpty():
        roots = labels
    else:
        further = _similarities(more, heads, numbered, shingle).filter(F.col("sim") >= similarity).select("a", "b")
        roots = connect(links.union(further), "near")
    found = settle(heads.select("key").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("key", F.coalesce("root", "key").alias("root")), "near-roots")
    for done in (grouped, chosen, met, asked, known, apart, some, members, more):
        discard(done)
    return found


def _numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """Rows with numbers that are written with them: worked out anew, they would change when the input is split otherwise."""
    return settle(docs.select(*columns, F.monotonically_increasing_id().alias("__row")), "near-rows")


def _components(numbered: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(row, root) for every row of ``numbered`` (row, text)."""
    prints = settle(numbered.select("row", "text").mapInArrow(_reading(shingle, False), "row long, key long, n long, fp long, bands array<long>"), "near-prints")
    heads = settle(prints.groupBy("key").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "fp", "bands")]), "near-distinct")
    out = settle(prints.select("row", "key").join(_roots(heads, numbered, similarity, shingle), "key").select("row", "root"), "near-named")
    discard(prints)
    discard(heads)
    return out


def near_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable, null if none has one) for every row of ``docs`` (doc_id, text).

    Texts are linked when their shingle sets have a Jaccard similarity of ``similarity`` or more (at least 0.8: the
    fingerprints are laid out for that). Case of ASCII letters and blanks do not count; texts up to a shingle
    long are one shingle, null and wordless ones are alike; an empty table gives no rows; other columns are ignored.
    """
    rows = _numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = rows.select("doc_id", F.col("__row").alias("row")).join(_components(rows.select(F.col("__row").alias("row"), "text"), similarity, shingle), "row")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "root").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of every component, all columns kept: the one with the smallest doc_id.

    Rows without a doc_id come after all others, so one of them stays where none of its component has one; of
    rows that repeat the doc_id one stays. Other cases are as in ``near_components``.
    """
    rows = _numbered(docs, *[F.col(f"`{c}`") for c in docs.columns])
    ids = rows.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("__row").alias("row"))
    named = ids.select("id", "row").join(_components(ids.select("row", "text"), similarity, shingle), "row")
    stay = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row")))["row"].alias("__row"))
    return rows.join(stay.select("__row"), "__row", "left_semi").drop("__row")
