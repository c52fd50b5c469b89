import uuid
from collections import Counter
from math import ceil

import pytest
import reference as R
from test_operators import check_pieces

import corpus_pipeline
from grovetable.llm.common import scratch_root

def measures(text):
    n, chars, symbols, dups, repeats, failed = R.quality_counts(text)
    lines = [x for x in (text or "").split("\n") if R.words(x)]
    return (chars * 1000 // max(n, 1), symbols * 10_000 // max(chars, 1), dups * 10_000 // max(len(lines), 1), repeats * 10_000 // max(n, 1)), failed


def beyond(text):
    """The shares that meet fences: without two symbols, a repeated line, a window found twice."""
    n, chars, symbols, dups, repeats, _ = R.quality_counts(text)
    lines = [x for x in (text or "").split("\n") if R.words(x)]
    return max(symbols - 2, 0) * 10_000 // max(chars, 1), max(dups - 1, 0) * 10_000 // max(len(lines), 1), max(repeats - 16, 0) * 10_000 // max(n, 1)


def bucket(v):
    power = (v + 1).bit_length() - 1
    return power * 32 + (v + 1 - (1 << power)) * 32 // (1 << power)


def least(b):
    base = 1 << (b // 32)
    return base + ceil((b % 32) * base / 32) - 1


def quantile(values, share):
    counts = Counter(map(bucket, values))
    rank, before = ceil(len(values) * share), 0
    for b in sorted(counts):
        if before + counts[b] >= rank:
            return least(b) + (rank - before) / counts[b] * (least(b + 1) - 1 - least(b))
        before += counts[b]


def good(rows):
    """Rows that pass, where every group is small enough to take the sketch of all documents."""
    own = [measures(r[1]) for r in rows]
    fine = [m for m, failed in own if not failed]
    q1, q3 = (quantile([m[0] for m in fine], s) for s in (0.25, 0.75))
    plain = [m for m in fine if q1 - (q3 - q1) <= m[0] <= q3 + (q3 - q1)]
    high = [1.25 * quantile([m[i] for m in plain], 0.998) for i in (1, 2, 3)]
    return [r for r, (m, failed) in zip(rows, own) if not failed and q1 - 4 * (q3 - q1) <= m[0] <= q3 + 4 * (q3 - q1) and all(x <= h for x, h in zip(beyond(r[1]), high))]


def similar(rows):
    """The smallest doc_id of every component of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more."""
    sets = []
    for r in rows:
        ws = R.words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    heads = {}
    for i, r in enumerate(rows):
        heads[root(i)] = min(r[0], heads.get(root(i), r[0]))
    return set(heads.values())


def test_stages_one_by_one(spark, docs, rows):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack"]
    at = docs

    def step(name):
        nonlocal at
        out = dict(corpus_pipeline.STAGES)[name](spark, at, "")
        path = f"{scratch_root(spark)}/test-{uuid.uuid4().hex}"
        out.write.parquet(path)
        at = spark.read.parquet(path)
        return at.collect()

    plain = lambda rs: sorted((tuple(r) for r in rs), key=repr)
    kept = step("quality_rules")
    want = good(rows)
    assert plain(kept) == plain(want) and 0 < len(want) < len(rows)

    last = {}
    for r in want:
        if r[1] not in last or r[0] > last[r[1]][0]:
            last[r[1]] = r
    single = step("exact_dedup")  # of rows that repeat number and text any one stays
    assert plain(r[:2] for r in single) == plain(r[:2] for r in last.values()) and set(plain(single)) <= set(plain(want))

    heads = similar(single)
    near = [r for r in single if r[0] in heads]
    got = step("near_dedup")
    assert sorted(r["doc_id"] for r in got) == sorted(heads) and set(plain(got)) <= set(plain(near))

    sizes = Counter()
    for r in got:
        sizes[r["source"]] += len(R.words(r["text"]))
    target = R.targets(sizes)
    mixed = step("mix_sources")
    words = Counter()
    for r in mixed:
        words[r["source"]] += len(R.words(r["text"]))
        assert r["doc_id"] in heads
    assert all(abs(words[s] - target[s]) <= 1 for s in sizes)

    tokenizer = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from grovetable.llm import packing

    check_pieces(packing.pack_documents(at, tokenizer).collect(), [tuple(r) for r in mixed], tokenizer)
    pieces = step("pack")
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in mixed}
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)


def test_whole_run(spark, tmp_path, docs, nothing):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    nothing.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_leave_each_other_alone(spark, docs):
    """Results of a stage that are not written yet can still be read after other calls, and runs in two threads do not meet."""
    one, two = (corpus_pipeline.quality_rules(spark, docs.filter(f"doc_id % 2 = {i}"), "") for i in (0, 1))
    corpus_pipeline.exact_dedup(spark, docs, "")
    assert one.count() + two.count() > 0


def test_runs_in_threads(spark, tmp_path, docs):
    from concurrent.futures import ThreadPoolExecutor

    for i in (0, 1):
        docs.filter(f"doc_id % 2 = {i}").write.parquet(str(tmp_path / str(i) / "documents.parquet"))
    alone = [sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path / str(i))).select("doc_id", "start", "length").collect())) for i in (0, 1)]
    with ThreadPoolExecutor(2) as pool:
        both = list(pool.map(lambda i: sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path / str(i))).select("doc_id", "start", "length").collect())), (0, 1)))
    assert both == alone


def test_only_what_the_block_wrote_is_its_own(spark):
    from grovetable.llm.common import discard, owning, settle

    before = settle(spark.range(3), "a")
    with owning() as left:
        kept, gone = settle(spark.range(4), "b"), settle(spark.range(5), "c")
        discard(before)
        discard(gone)
        assert left == [kept.settled_path]
    settle(spark.range(2), "d")
    assert left == [kept.settled_path] and kept.count() == 4
