import random

import pytest
import reference as R
from pyspark.sql import functions as F

from grovetable.llm import jaccard, near


def shingles(text, k=3):
    ws = R.words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)) or frozenset([" ".join(ws)] if ws else [])


def plain(rows, percent=90):
    sets = [(d, shingles(t)) for d, t, *_ in rows]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        ids = [x for x in (d, least.get(top(i))) if x is not None]
        least[top(i)] = min(ids, default=None)
    return sorted(((d, len(s), least[top(i)]) for i, (d, s) in enumerate(sets)), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def edited(text, draw, share):
    ws = text.split()
    for _ in range(max(1, round(share * len(ws)))):
        at = draw.randrange(len(ws))
        kind = draw.random()
        ws[at : at + 1] = [f"e{draw.randrange(10**6)}"] if kind < 0.6 else [] if kind < 0.8 else [ws[at], f"i{draw.randrange(10**6)}"]
    return " ".join(ws)


def corpus(seed, n=60, copies=6):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        size = draw.choice([3, 8, 9, 10, 11, 12, 19, 20, 21, 40, 75, 130, 300, 900])
        base = " ".join(f"v{draw.randrange(3000)}" for _ in range(size))
        rows.append((len(rows), base))
        for _ in range(draw.randrange(copies)):
            rows.append((len(rows), edited(draw.choice(rows[-3:])[1], draw, draw.choice([0.005, 0.01, 0.015, 0.02, 0.03]))))
    return rows


def test_jaccard_awkward(spark, docs, rows, nothing, clashing):
    extra = [(None, rows[0][1], "en", "a", 0), (None, None, None, None, 0), (None, "only these words here", "en", "a", 0)]
    given = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    assert got(jaccard.jaccard_components(given)) == plain([*rows, *extra])
    assert jaccard.jaccard_components(nothing).count() == 0
    for c in ("n", "cells", "regions", "region", "root", "first"):
        clashing = clashing.withColumn(c, F.lit("mine"))
    assert got(jaccard.jaccard_components(clashing)) == plain(rows)


@pytest.mark.parametrize("dense", [64, 3])
def test_jaccard_copies(spark, monkeypatch, dense):
    """Copies with few changes, sizes at the edges of rings; with small regions every level of splitting is used."""
    monkeypatch.setattr(jaccard, "DENSE", dense)
    rows = corpus(7)
    want = plain(rows)
    assert len({r[2] for r in want}) < len(rows) - 20
    assert got(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == want


def test_jaccard_large_groups(spark, monkeypatch):
    """A chain of copies of copies, many copies of one text at every distance, and texts that share a long passage."""
    monkeypatch.setattr(jaccard, "DENSE", 8)
    draw = random.Random(2)
    base = " ".join(f"b{draw.randrange(500)}" for _ in range(150))
    rows = [(1000 - i, edited(base, draw, draw.choice([0.004, 0.01, 0.02, 0.04, 0.06]))) for i in range(250)]
    chain = base
    for i in range(60):
        chain = edited(chain, draw, 0.01)
        rows.append((2000 + i, chain))
    rows += [(3000 + i, base + " " + " ".join(f"o{draw.randrange(10**6)}" for _ in range(draw.choice([4, 8, 15, 40])))) for i in range(150)]
    assert got(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == plain(rows)


@pytest.mark.parametrize("percent", [60, 80, 90, 99])
def test_linked_sets_share_a_region(percent):
    """Whatever the sizes and where the shingles differ, linked sets have a region in common; and coordinates never part them."""
    import numpy as np

    rng, table, met = np.random.default_rng(percent), jaccard.rings(percent), 0
    for _ in range(1500):
        n = int(rng.choice([5, 9, 10, 11, 19, 20, 21, 40, 75, 130, 400]))
        whole = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        gone = int(rng.integers(0, 1 + n * (100 - percent) // 100))
        new = int(rng.integers(0, 1 + n * (100 - percent) // 100))
        other = np.unique(np.concatenate([rng.permutation(whole)[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
        common = len(np.intersect1d(whole, other))
        if 100 * common >= percent * (len(whole) + len(other) - common) and len(other) and common < max(len(whole), len(other)):
            met += 1
            a, b = (set(jaccard.regions_of(x, percent, table).tolist()) for x in (whole, other))
            assert a & b
    assert met > 100


def test_regions_are_few():
    """The regions of a set grow with its size, as a fixed share of it."""
    import numpy as np

    for n in (50, 300, 5000):
        held = jaccard.regions_of(np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)), 90, jaccard.rings(90))
        assert 0.05 * n < len(held) < 0.3 * n


def test_hashes_are_those_of_near_copies():
    assert len(near.shingle_hashes("A b c d", 3)) == 2 and (near.shingle_hashes("a  B\tc D", 3) == near.shingle_hashes("A b c d", 3)).all()
