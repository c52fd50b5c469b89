"""An isolation forest: rows that few random cuts set apart are odd.

Trees grow side by side, a group each, on subsamples of fixed size, so that no task holds more than one
subsample; the grown forest has a fixed number of nodes and goes to every task that scores rows. Samples and cuts
come from hashes of a row key and a seed: the same table gives the same forest, however it is split.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import try_num
from .linkage import shared_files
from .profile import long_numbers
from .quantiles import percentiles

TREES, SAMPLE, SEED = 100, 256, 42
NODES = "tree int, node int, feature int, cut double, low int, high int, length double"


def average_path(n: int) -> float:
    """The mean depth of an unsuccessful search in a binary tree of ``n`` keys."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow(rows: list[tuple[float, ...]], draws, deepest: int) -> list[tuple[int, int, float, int, int, float]]:
    """Nodes (node, feature, cut, low, high, length) of one tree; a leaf has feature -1 and the length of a path that ends there.

    A cut lies at a random place between the least and the greatest value of a random feature that has two; a value below it goes low.
    """
    nodes: list = []

    def add(part: list, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        open_ = [f for f in range(len(part[0])) if min(r[f] for r in part) < max(r[f] for r in part)] if len(part) > 1 and depth < deepest else []
        if not open_:
            nodes[at] = (at, -1, 0.0, -1, -1, depth + average_path(len(part)))
            return at
        f = open_[int(next(draws) * len(open_))]
        a, b = min(r[f] for r in part), max(r[f] for r in part)
        cut = a + next(draws) * (b - a)
        cut = b if cut <= a else cut  # both sides hold a row
        low = add([r for r in part if r[f] < cut], depth + 1)
        high = add([r for r in part if r[f] >= cut], depth + 1)
        nodes[at] = (at, f, cut, low, high, 0.0)
        return at

    add(rows, 0)
    return nodes


def grow_forest(df: DataFrame, columns: list[str], key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The nodes of ``trees`` trees over the number columns ``columns``, which hold no null.

    The trees * sample rows with the least hashes are the pool; every tree takes ``sample`` of them by a hash of its own.
    """
    x = [F.col(c).cast("double") for c in columns]
    pool = df.select(F.xxhash64(F.lit(seed), key).alias("h"), F.array(*x).alias("x")).orderBy("h", "x").limit(trees * sample)
    drawn = pool.select("x", "h", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("order", F.xxhash64("tree", "h"))
    taken = drawn.withColumn("k", F.row_number().over(Window.partitionBy("tree").orderBy("order", "x"))).filter(F.col("k") <= sample)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        import random

        tree = int(part["tree"].iloc[0])
        draw = random.Random(seed * 1_000_003 + tree)
        rows = [tuple(r) for r in part.sort_values("k")["x"]]
        made = grow(rows, iter(draw.random, 2.0), max(1, math.ceil(math.log2(max(2, len(rows))))))
        return pd.DataFrame([(tree, *n) for n in made], columns=["tree", "node", "feature", "cut", "low", "high", "length"])

    return taken.select("tree", "k", "x").groupBy("tree").applyInPandas(one, NODES)


def laid_out(feature, cut, low, high, length):
    """A tree as a full one: (depth, features, cuts, lengths of the last level); node i has its children at 2 i + 1 and 2 i + 2.

    Below a leaf its length is repeated, so every row takes the same number of steps.
    """
    import numpy as np

    level, src, depth = [0], [], 0
    while any(feature[i] >= 0 for i in level):
        src += level
        level = [int(j) for i in level for j in ((low[i], high[i]) if feature[i] >= 0 else (i, i))]
        depth += 1
    inner = feature[src] >= 0 if src else np.zeros(0, dtype=bool)
    return depth, np.where(inner, feature[src], 0).astype(np.intp) if src else np.zeros(0, dtype=np.intp), np.where(inner, cut[src], 0.0) if src else np.zeros(0), length[level]


def path_lengths(x, trees):
    """The sum over ``trees`` (of ``laid_out``) of the lengths of the paths that the rows of ``x`` (features, rows) take."""
    import numpy as np

    n = x.shape[1]
    flat, place, total = x.ravel(), np.arange(n), np.zeros(n)
    at, i, mine, cuts, low = np.empty(n, np.intp), np.empty(n, np.intp), np.empty(n), np.empty(n), np.empty(n, bool)
    for depth, feature, cut, length in trees:
        at.fill(0)
        for level in range(depth):
            if level:
                np.take(feature, at, out=i, mode="clip")
                i *= n
                i += place
                np.take(flat, i, out=mine, mode="clip")
                np.take(cut, at, out=cuts, mode="clip")
                np.less(mine, cuts, out=low)
            else:
                np.less(x[feature[0]], cut[0], out=low)
            at *= 2
            at += 2
            at -= low
        at -= 2**depth - 1
        np.take(length, at, out=mine, mode="clip")
        total += mine
    return total


def with_scores(df: DataFrame, columns: list, forest: DataFrame, sample: int, name: str = "anomaly_score") -> DataFrame:
    """Add the isolation score, 2 ** -(mean path / mean path of ``sample`` rows): near 1 is odd, below a half is usual.

    ``columns`` are names or expressions, in the order of the forest's features.
    """
    held = forest.orderBy("tree", "node").toPandas()  # trees * (2 * sample - 1) nodes at most
    packed = [laid_out(*(part[c].to_numpy() for c in ("feature", "cut", "low", "high", "length"))) for _, part in held.groupby("tree", sort=True)]
    usual, k = average_path(sample) or 1.0, len(columns)
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` double"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            given = batch.num_columns - k
            x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in batch.columns[given:]])
            score = 2.0 ** (-(path_lengths(x, packed) / max(1, len(packed))) / usual)
            yield pa.RecordBatch.from_arrays([*batch.columns[:given], pa.array(score)], names=[*batch.schema.names[:given], name])

    numbered = df.select("*", *[(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    return numbered.mapInArrow(run, kind)


def isolation_flags(df: DataFrame, columns: list[str], key: str, share: float = 0.05, least: int = 10, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Add anomaly_score and is_anomaly: the top ``share`` of isolation scores is flagged.

    A missing number counts as its column's median; columns without any number are left out. A frame of fewer than ``least`` rows, or
    without numbers, has no anomalies and scores of 0. Rows are scored once and written with their scores, which the cut is taken from.
    """
    held = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(try_num(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    n, found = held["n"], {c: held[f"c{i}"] for i, c in enumerate(columns)}
    used = [c for c in columns if found[c]]
    if n < least or not used:
        return df.withColumn("anomaly_score", F.lit(0.0)).withColumn("is_anomaly", F.lit(False))
    gaps = [c for c in used if found[c] < n]
    medians = {c: p[0] for c, (_, p) in percentiles(long_numbers(df, gaps), (0.5,)).items()} if gaps else {}
    numbers = [F.coalesce(try_num(F.col(f"`{c}`")), F.lit(medians[c])) if c in medians else try_num(F.col(f"`{c}`")) for c in used]
    names = [f"__f{i}" for i in range(len(used))]
    forest = grow_forest(df.select("*", *[x.alias(f) for x, f in zip(numbers, names)]), names, key, trees, sample, seed)
    scored = shared_files(with_scores(df, numbers, forest, min(sample, n)))
    cut = percentiles(scored.select(F.lit("score").alias("column"), F.col("anomaly_score").alias("x")), (1 - share,))["score"][1][0]
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > cut)
