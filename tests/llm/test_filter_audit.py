from collections import Counter
from itertools import permutations

import reference as R
from pyspark.sql import functions as F

from grovetable.llm import filter_audit


def plain(rows, labels):
    """Every order applied document by document."""
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    judged = []
    for d, t, _, source, *_ in rows:
        t = t or ""
        ws = R.words(t)
        fails = {"A"} if len(ws) < 200 else set()
        fails |= {"B"} if 100 * len(set(ws)) < 50 * len(ws) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if d is not None and d > first[t] else set()
        judged.append((source or "", fails, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                failing = sum(f in j[1] for j in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(j[1] == {f} for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone)]
                shapley[part, f] += len(gone)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = "doc_id long, quality int, toxic int"


def test_filter_audit(spark, docs, rows, nothing, clashing):
    extra = [(None, rows[0][1], "en", "a", 3), (None, None, None, None, 0), (200, "A" * 300 + " word" * 300, "en", "a", 0), (201, " ".join(f"u{i}" for i in range(260)), "en", None, 0), (202, " ".join(f"u{i}" for i in range(260)), "en", "", 0)]
    given = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    told = [(i, i % 2, i % 3 % 2) for i in range(0, 112)] + [(3, 1, 1), (3, None, None), (None, 1, 1), (200, None, 1), (201, 1, 0), (900, 1, 1)]
    labels = spark.createDataFrame(told, LABELS)
    got = sorted(tuple(r) for r in filter_audit.audit(given, labels).select(*COLUMNS).collect())
    assert got == plain([*rows, *extra], told)
    assert len(got) == 600 * len({r[0] for r in got})
    assert filter_audit.audit(nothing, labels).count() == 0
    none = labels.limit(0)
    for column in ("part", "mask", "digest", "n", "good", "first"):
        clashing = clashing.withColumn(column, F.lit("mine"))
    blank = filter_audit.audit(clashing, none).agg(F.sum("good_lost") + F.sum("toxic_lost"), F.count(F.lit(1))).first()
    assert blank[0] == 0 and blank[1] == 600 * len({r[3] or "" for r in rows})


def test_copies_beyond_number(spark):
    """A text that a third of all rows share, a doc_id that many rows repeat."""
    rows = [(i, "x " * 300, "en", "s", 0) for i in range(300)] + [(7, f"y{i} " * 3, "en", "s", 0) for i in range(300)] + [(1000 + i, f"z{i} # Z", "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(7, 1, 0)], LABELS)
    got = sorted(tuple(r) for r in filter_audit.audit(docs, labels).select(*COLUMNS).collect())
    assert got == plain(rows, [(7, 1, 0)])
