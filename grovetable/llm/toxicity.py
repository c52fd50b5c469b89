"""Severity of toxic language by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(threshold[k] - weights . features)``: one weight vector shared by all
thresholds, which are kept in order. Features are the hashed words that a text holds. The model
is fitted on a bounded sample of labelled rows; every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

BUCKETS = 1 << 18
#: The fit sees this many labelled rows at most.
SAMPLE = 12_000
#: Words seen in fewer sampled documents carry no weight.
LEAST_DOCUMENTS = 6
#: Standard errors that a word's log odds must be from zero to carry a weight under the plain penalty.
SURE = 2.5
#: Words between UNSURE and SURE standard errors carry a weight that is held HEAVY times as hard.
UNSURE, HEAVY = 1.5, 10.0
#: How far toxic rows are brought to count as much as clean ones: 0 a row is a row, 1 both kinds count the same.
EVEN = 1.0
#: Words known to a scoring task before it starts anew.
REMEMBERED = 400_000


def _words():
    import re
    from zlib import crc32

    find = re.compile(r"\w+").findall
    return lambda text: find((text or "").lower()), lambda word: crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def _featuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, place = _words()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            sets = [sorted({place(w) for w in set(words(t))}) for t in some.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sets, pa.list_(pa.int32()))], names=["doc_id", "grade", "features"])


@dataclass
class OrdinalModel:
    """Shared weights, and thresholds in rising order: one less than there are grades."""

    weights: dict[int, float]
    thresholds: list[float]

    def chances(self, score: float) -> list[float]:
        """P(grade = k) for every grade."""
        from math import exp

        upto = [1 / (1 + exp(min(60.0, max(-60.0, score - t)))) for t in self.thresholds] + [1.0]
        return [b - a for a, b in zip([0.0, *upto], upto)]


def log_odds(hit, flat, owner, seen):
    """Every feature's log odds ratio between rows that are ``hit`` and others, and its standard error."""
    import numpy as np

    n = int(hit.sum())
    a = np.bincount(flat[hit[owner]], minlength=BUCKETS) + 0.5
    b = seen - a + 1.0
    c, d = n + 1.0 - a, len(hit) - n + 1.0 - b
    return np.log(a / c) - np.log(b / d), np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def fit_ordinal(rows: list[tuple[int, list[int]]], grades: int, least: int = LEAST_DOCUMENTS, rounds: int = 300, penalty: float = 3e-4, rate: float = 0.1, sure: float = SURE, even: float = EVEN, unsure: float = UNSURE) -> OrdinalModel:
    """Fit by full-batch Adam on the mean negative log likelihood and half the penalty times the squared weights. ``rows`` has (grade, features).

    Features carry a weight if at least ``least`` rows have them, no more than half of all do, and they tell
    grade 0 from the others by ``unsure`` standard errors of their log odds; below ``sure`` the penalty is HEAVY times
    as large. Rows of grade 0 and all others are weighed by the inverse of their share to the power of ``even``.
    """
    import numpy as np

    if not rows or grades < 2:
        return OrdinalModel({}, [0.0] * max(0, grades - 1))
    y = np.array([g for g, _ in rows])
    flat = np.concatenate([np.asarray(f, dtype=np.int64) for _, f in rows]) if rows else np.array([], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    seen = np.bincount(flat, minlength=BUCKETS)
    odds, error = log_odds(y > 0, flat, owner, seen)
    clear = np.abs(odds) / error
    used = np.flatnonzero((seen >= least) & (seen <= 0.5 * len(rows)) & (clear >= unsure))
    ridge = penalty * np.where(clear[used] >= sure, 1.0, HEAVY)
    index = np.full(BUCKETS, -1)
    index[used] = np.arange(len(used))
    keep = index[flat] >= 0
    cols, owner = index[flat][keep], owner[keep]
    part = np.where(y > 0, (y > 0).mean(), (y == 0).mean()) ** -even
    part = part / part.sum()  # what a row counts
    share = np.clip(np.cumsum(np.bincount(y, weights=part, minlength=grades))[:-1], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    # Thresholds are the first one plus sums of exp(gap): in order whatever the step.
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    p = np.concatenate([np.zeros(len(used)), first[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        w, t = p[: len(used)], np.cumsum(np.concatenate([p[len(used) : len(used) + 1], np.exp(p[len(used) + 1 :])]))
        s = np.bincount(owner, weights=w[cols], minlength=len(rows))
        up = np.where(y < grades - 1, sig(np.append(t, 0.0)[np.minimum(y, grades - 2)] - s), 1.0)
        lo = np.where(y > 0, sig(t[np.maximum(y - 1, 0)] - s), 0.0)
        q = np.maximum(up - lo, 1e-9)
        d_up, d_lo = part * np.where(y < grades - 1, up * (1 - up), 0.0) / q, part * np.where(y > 0, lo * (1 - lo), 0.0) / q
        d_t = np.zeros(grades - 1)
        np.add.at(d_t, np.minimum(y, grades - 2), -d_up * (y < grades - 1))
        np.add.at(d_t, np.maximum(y - 1, 0), d_lo * (y > 0))
        g = np.concatenate([np.bincount(cols, weights=(d_up - d_lo)[owner], minlength=len(used)) + ridge * w, [d_t.sum()], np.exp(p[len(used) + 1 :]) * np.cumsum(d_t[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, t = p[: len(used)], np.cumsum(np.concatenate([p[len(used) : len(used) + 1], np.exp(p[len(used) + 1 :])]))
    return OrdinalModel({int(k): float(x) for k, x in zip(used, w) if abs(x) > 1e-4}, [float(x) for x in t])


def severity_grades(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[int, list[int]]]:
    """(grade, features) of at most ``sample`` labelled documents, in an order that does not depend on the run.

    Labels are 0 or 1; severity is graded from them: 0 for clean; of the toxic documents, grade 2
    for those that hold more telling words (log odds above 1) than the middle one, and 1 for the rest. The words that
    tell come from the labels of the other half of the sample, so no document's grade rests on its own words.
    Rows without a label or document are left out.
    """
    import numpy as np

    some = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = settle(some, "toxic-sample")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")  # at most `sample` rows
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample)  # a doc_id may come many times
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("grade"), "text").mapInArrow(_featuring, "doc_id long, grade int, features array<int>").collect()
    rows = sorted((r["doc_id"], r["grade"], list(r["features"])) for r in rows)
    strength = [0] * len(rows)
    for half in (0, 1):
        other = [r for i, r in enumerate(rows) if i % 2 != half]
        if not other:
            continue
        flat = np.concatenate([np.asarray(f, dtype=np.int64) for _, _, f in other])
        owner, seen = np.repeat(np.arange(len(other)), [len(f) for _, _, f in other]), np.bincount(flat, minlength=BUCKETS)
        odds, error = log_odds(np.array([bool(t) for _, t, _ in other]), flat, owner, seen)
        telling = (odds > 1) & (odds > SURE * error) & (seen >= LEAST_DOCUMENTS)
        for i in range(half, len(rows), 2):
            strength[i] = int(telling[rows[i][2]].sum())
    middle = float(np.median([s for s, r in zip(strength, rows) if r[1]] or [0]))
    return [(0 if not r[1] else 2 if s > middle else 1, r[2]) for s, r in zip(strength, rows)]


def score_severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_severity, severity (likeliest grade) and toxic (any severity is likelier than none) for every row of ``docs``.

    Null and empty texts have no features and get the grade that the thresholds alone give; repeated
    rows are scored each for itself; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place = _words()
        known: dict[str, float] = {}

        def score(text: str | None) -> float:
            seen, total = set(), 0.0
            for word in set(words(text)):
                x = known.get(word)
                if x is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    x = known[word] = model.weights.get(place(word), 0.0)
                if x and (at := place(word)) not in seen:  # a bucket counts once
                    seen.add(at)
                    total += x
            return total

        for batch in batches:
            all_chances = [model.chances(score(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([sum(k * c for k, c in enumerate(cs)) for cs in all_chances], pa.float64()),
                    pa.array([max(range(len(cs)), key=cs.__getitem__) for cs in all_chances], pa.int32()),
                    pa.array([cs[0] < 0.5 for cs in all_chances], pa.bool_()),
                ],
                names=["doc_id", "expected_severity", "severity", "toxic"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_severity double, severity int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the labelled sample and score all of ``docs``. Without labels nothing is called toxic."""
    rows = severity_grades(docs, labels, sample)
    model = fit_ordinal(rows, 3) if any(g for g, _ in rows) else OrdinalModel({}, [20.0, 30.0])
    return score_severity(docs, model)
