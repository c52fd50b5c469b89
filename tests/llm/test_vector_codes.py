import hashlib
import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from grovetable.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = len(min(kept, key=lambda r: (r[0] is None, r[0] or 0))[1])
    kept = [r for r in kept if len(r[1]) == size]
    w = size // parts
    least = {}
    for i, v, _ in kept:
        least[i] = min(v, least.get(i, v))
    seeds = [least[i] for i in sorted(least, key=lambda i: (i is None, i or 0))[:entries]]
    books = [[s[p * w : (p + 1) * w] for s in seeds] for p in range(parts)]

    def nearest(v, p):
        x = v[p * w : (p + 1) * w]
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(v, p)[1]].append(v[p * w : (p + 1) * w])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if groups[k] else e for k, e in enumerate(books[p])]
    coded = [(i, c, [nearest(v, p) for p in range(parts)]) for i, v, c in kept]
    errors = defaultdict(int)
    for _, c, near in coded:
        errors[c] += sum(d for d, _ in near)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), errors[c], digest) for i, c, near in coded), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def made(n, size, seed=3, grain=None):
    draw = random.Random(seed)
    value = lambda: draw.choice(grain) if grain else draw.gauss(0, 0.2)
    f32 = lambda x: __import__("struct").unpack("f", __import__("struct").pack("f", x))[0]
    return [(i, [f32(value()) for _ in range(size)], draw.choice([0, 1, 2, None])) for i in range(n)]


def test_vector_codes(spark):
    rows = made(400, 32)
    rows += [(i, rows[i][1], 1) for i in range(20)] + [(None, rows[5][1], None), (None, rows[6][1], 2), (500, None, 1), (501, [], 1), (-4, [float("nan")] * 32, 1), (-3, [float("inf")] + [0.0] * 31, 1), (-2, [None] + [0.0] * 31, 1)]
    rows += [(3, rows[9][1], 0), (600, [0.5] * 31, 3), (601, [40_000.0, -40_000.0] * 16, 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows)
    assert got(vector_codes.compress_vectors(frame)) == want
    clash = frame
    for c in ("q", "v", "entry", "upper", "lower", "code", "error", "of"):
        clash = clash.withColumn(c, F.lit("mine"))
    assert got(vector_codes.compress_vectors(clash)) == want
    assert vector_codes.compress_vectors(frame.limit(0)).count() == 0
    assert vector_codes.compress_vectors(frame.filter("vec_id < 0")).count() == 0


def test_ties_and_few_vectors(spark):
    """Coarse values give many equal distances; fewer vectors than entries; a single one."""
    for rows in (made(300, 16, grain=[-0.01, 0.0, 0.004, 0.0079]), made(200, 32, grain=[0.0, 1.0]), made(9, 16), made(1, 16), [(i, [0.25] * 16, 0) for i in range(70)]):
        assert got(vector_codes.compress_vectors(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    rows = made(500, 16, seed=8, grain=[i / 256 for i in range(-3, 4)])
    assert got(vector_codes.compress_vectors(spark.createDataFrame(rows, SCHEMA), rounds=5)) == plain(rows, rounds=5)


def test_lengths_that_do_not_divide(spark):
    rows = made(100, 18)
    filled = [(i, v + [0.0] * 14, c) for i, v, c in rows]
    assert got(vector_codes.compress_vectors(spark.createDataFrame(rows, SCHEMA))) == plain(filled)


def test_bounds_save_scans(spark, monkeypatch):
    """Most parts keep their entry without a scan once rounds settle."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    centres = rng.integers(-200, 200, (16, 64, 4))
    pick = rng.integers(0, 64, (2000, 16))
    values = (centres[np.arange(16)[None, :], pick] + rng.integers(-2, 3, (2000, 16, 4))).astype("<i4")
    calls = []
    scan = vector_codes.scanned
    monkeypatch.setattr(vector_codes, "scanned", lambda v, b: calls.append(len(v)) or scan(v, b))
    columns = [pa.array(range(2000), pa.int64()), pa.array([0] * 2000, pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())]
    state = list(vector_codes._assigning(centres.astype(np.int64), None, True)([pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v"])]))
    assert sum(calls) == 2000 * 16
    calls.clear()
    list(vector_codes._assigning(centres.astype(np.int64), np.ones((16, 64)), True)(state))
    assert sum(calls) < 0.2 * 2000 * 16
