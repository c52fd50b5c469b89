"""Product codes of vectors by Lloyd rounds with Hamerly's bounds.

Every part of every vector keeps its codebook entry, an upper bound on the distance to it and a lower bound
on the distance to the second nearest entry, in a table in the shared folder. When entries move, the upper bound grows by
the way of the own entry and the lower one shrinks by the longest way of any other. As long as the upper bound is strictly
below the lower one the entry is still the only nearest; only where that fails, with the upper bound made exact,
all entries are scanned in integers, ties to the lower index.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are held within this, so that squared distances of vectors with up to 1,024 components fit a long.
MOST = 1 << 25
#: Bounds are rounded outwards by this share, more than double arithmetic can lose.
LOOSE = 1e-9
ROWS = 2_048


def scanned(values, book):
    """Nearest entry (lower index on ties), its squared distance and the second least one, for parts ``values`` (n, w) and entries ``book`` (k, w)."""
    import numpy as np

    top = max(int(np.abs(values).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 8 * top * top * values.shape[1] < 1 << 53 else np.int64  # either is exact
    v, b = values.astype(kind), book.astype(kind)
    square = (v * v).sum(1)[:, None] - 2 * (v @ b.T) + (b * b).sum(1)
    at = np.arange(len(v))
    own = square.argmin(1)
    least = square[at, own].astype(np.int64)
    if len(book) == 1:
        return own, least, np.full(len(v), np.iinfo(np.int64).max)
    square[at, own] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
    return own, least, square.min(1).astype(np.int64)


def _assigning(books, moved, state: bool):
    """Batches of (vec_id, label, v as bytes of int32[, entry, upper, lower]) with entries and bounds brought up to date.

    ``books``: (PARTS, k, w) integers. ``moved``: how far each entry went since the bounds were made, None in the first round.
    With ``state`` the bounds are passed on; otherwise codes and exact errors come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        parts, k, w = books.shape
        if moved is not None:
            order = np.argsort(-moved, axis=1, kind="stable")
            way = np.take_along_axis(moved, order, 1)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                n = batch.num_rows
                column = lambda i, kind, batch=batch: np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=kind).reshape(batch.num_rows, parts, -1)
                values = column(2, "<i4").astype(np.int64)
                own, upper, lower, exact = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts)), np.zeros((n, parts), np.int64)
                if moved is not None:
                    own = column(3, "u1")[:, :, 0].astype(np.int64)
                    upper, lower = column(4, "<f4")[:, :, 0].astype(np.float64), column(5, "<f4")[:, :, 0].astype(np.float64)
                for p in range(parts):
                    v = values[:, p]
                    open_ = np.ones(n, bool)
                    if moved is not None:
                        other = np.where(order[p, 0] == own[:, p], way[p, 1] if k > 1 else 0.0, way[p, 0])
                        upper[:, p] = (upper[:, p] + moved[p, own[:, p]]) * (1 + LOOSE)
                        lower[:, p] = np.maximum(0, (lower[:, p] - other) * (1 - LOOSE) - LOOSE * other)
                        open_ = ~(upper[:, p] < lower[:, p])
                        tight = open_ if state else np.ones(n, bool)  # the last round needs every exact distance
                        exact[tight, p] = ((v[tight] - books[p][own[tight, p]]) ** 2).sum(1)
                        upper[tight, p] = np.sqrt(exact[tight, p].astype(np.float64)) * (1 + LOOSE)
                        open_ &= ~(upper[:, p] < lower[:, p])
                    if open_.any():
                        near, first, second = scanned(v[open_], books[p])
                        own[open_, p], exact[open_, p] = near, first
                        upper[open_, p] = np.sqrt(first.astype(np.float64)) * (1 + LOOSE)
                        lower[open_, p] = np.sqrt(second.astype(np.float64)) * (1 - LOOSE)
                if state:
                    up = np.nextafter(upper.astype("<f4"), np.float32(np.inf))
                    low = np.maximum(np.nextafter(lower.astype("<f4"), np.float32(-np.inf)), 0).astype("<f4")
                    own8 = own.astype("u1")
                    blobs = [pa.array([x[i].tobytes() for i in range(n)], pa.binary()) for x in (own8, up, low)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *blobs], names=["vec_id", "label", "v", "entry", "upper", "lower"])
                else:
                    code = [own[i].astype("u1").tobytes().hex() for i in range(n)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(exact.sum(1), pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _summing(parts: int, k: int, w: int):
    """Counts and component sums by part and entry, one set of rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sums, counts = np.zeros((parts, k, w), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), "u1").reshape(batch.num_rows, parts)
            values = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(batch.num_rows, parts, w)
            for p in range(parts):
                np.add.at(sums[p], own[:, p], values[:, p])
                counts[p] += np.bincount(own[:, p], minlength=k)
        p, e = np.nonzero(counts)
        held = np.concatenate([counts[p, e][:, None], sums[p, e]], axis=1)
        slot = np.repeat(p * k + e, w + 1)
        place = np.tile(np.arange(w + 1), len(p))
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(place, pa.int32()), pa.array(held.reshape(-1), pa.int64())], names=["slot", "place", "total"])

    return run


def _moved_books(state: DataFrame, books):
    """The next codebooks, componentwise floor(sum / count); unused entries stay. What is collected has the codebooks' size."""
    parts, k, w = books.shape
    sums = state.select("v", "entry").mapInArrow(_summing(parts, k, w), "slot int, place int, total long").groupBy("slot", "place").agg(F.sum("total").alias("total")).collect()
    held = {(r["slot"], r["place"]): r["total"] for r in sums}
    out = books.copy()
    for slot in {s for s, _ in held}:
        out[divmod(slot, k)] = [held[slot, i + 1] // held[slot, 0] for i in range(w)]
    return out


def _whole(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(vec_id, label, q): kept vectors as integers."""
    q = F.col(vector_column).cast("array<double>")
    usable = F.coalesce(F.size(q) > 0, F.lit(False)) & F.coalesce(F.forall(q, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(q, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-4.0 * MOST), F.least(F.lit(4.0 * MOST), x * SCALE))))).cast("int"))
    return vectors.filter(usable).select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("int").alias("label"), whole.alias("q"))


def _least_ids(most: int):
    """The ``most`` least distinct ids of a task, null last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, null = set(), False
        for batch in batches:
            ids = batch.column(0)
            null |= ids.null_count > 0
            least = set(sorted(least.union(ids.drop_null().to_pylist()))[:most])
        yield pa.RecordBatch.from_arrays([pa.array([*least, *[None] * null], pa.int64())], names=["vec_id"])

    return run


def _seeds(kept: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the ``entries`` least vec_ids, in order: the only vectors that come to the driver."""
    ids = kept.select("vec_id").mapInArrow(_least_ids(entries), "vec_id long").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    wanted = [r["vec_id"] for r in ids.collect()]
    own = F.col("vec_id").isin([i for i in wanted if i is not None])
    held = kept.filter(own | F.col("vec_id").isNull() if None in wanted else own).groupBy("vec_id").agg(F.min("q").alias("q"))
    return [r["q"] for r in held.orderBy(F.col("vec_id").asc_nulls_last()).collect()]


def _packing(size: int, width: int):
    """Integer lists of ``size`` as bytes, with zeros up to ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(batch.num_rows, size)
            flat = np.pad(flat, ((0, 0), (0, width - size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in flat], pa.binary())], names=["vec_id", "label", "v"])

    return run


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distance to the coded vector), label_error, codebooks_sha256.

    Rows whose vector is null, empty, or holds a null or non-finite component are left out. Components become floor(256 * x), held
    within 2 ** 25 either way. Codebooks start as the parts of the ``entries`` least vec_ids (null comes last; of rows that repeat
    a vec_id, the least vector), fewer if there are fewer; at most 256. The seed vectors' commonest length, the shorter on ties, is that of the codes: vectors of
    other lengths are left out. A length that ``parts`` does not divide is filled with zeros. ``label_error`` adds up errors over
    equal labels, nulls together. An empty table gives no rows; other columns are ignored.
    """
    import numpy as np

    schema = "vec_id long, label int, code string, error long, label_error long, codebooks_sha256 string"
    kept = _whole(vectors, id_column, vector_column, label_column)
    found = _seeds(kept, entries)
    if not found:
        return vectors.sparkSession.createDataFrame([], schema)
    sizes = Counter(map(len, found))
    size = min(sizes, key=lambda n: (-sizes[n], n))
    kept = kept.filter(F.size("q") == size)
    seeds = found if len(sizes) == 1 else _seeds(kept, entries)
    w = -(-size // parts)
    seed = np.pad(np.array(seeds, dtype=np.int64), ((0, 0), (0, w * parts - size)))
    books = np.ascontiguousarray(seed.reshape(len(seeds), parts, w).transpose(1, 0, 2))
    state = kept.mapInArrow(_packing(size, w * parts), "vec_id long, label int, v binary")
    moved, before = None, None
    for _ in range(rounds):
        state = settle(state.mapInArrow(_assigning(books, moved, True), "vec_id long, label int, v binary, entry binary, upper binary, lower binary"), "codes-state")
        if before is not None:
            discard(before)
        before = state
        new = _moved_books(state, books)
        moved = np.sqrt(((new - books) ** 2).sum(2).astype(np.float64)) * (1 + LOOSE)
        books = new
    coded = settle(state.mapInArrow(_assigning(books, moved, False), "vec_id long, label int, code string, error long"), "codes")
    if before is not None:
        discard(before)
    digest = sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(errors, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
