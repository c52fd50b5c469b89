import random
import re
from collections import Counter
from itertools import combinations

import reference as R
from pyspark.sql import functions as F

import corpus_pipeline
from grovetable.llm import near, simhash


def sets_of(text):
    ws = R.words(text.lower())
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)}


def alike(a, b):
    return len(a & b) / len(a | b)


def edited(draw, words, edits):
    out = list(words)
    for at in draw.sample(range(len(out)), edits):
        out[at] = f"edit{draw.getrandbits(40)}"
    return out


def test_planted_edits_are_caught(spark):
    """Copies of 300 words with 1 to 9 replaced words: similarity 0.97 down to below 0.8. Pairs of 0.8 or more go, others stay."""
    draw = random.Random(5)
    texts = []
    for i in range(300):
        base = [f"w{draw.randrange(20_000)}" for _ in range(300)]
        texts += [" ".join(base), " ".join(edited(draw, base, 1 + i % 9))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    near_ones = [i for i in range(0, 600, 2) if alike(sets_of(texts[i]), sets_of(texts[i + 1])) >= 0.8]
    caught = sum(i + 1 not in got for i in near_ones)
    print("near copies", len(near_ones), "caught", caught)
    assert 150 < len(near_ones) < 300 and caught >= 0.99 * len(near_ones)
    assert got >= {i for i in range(0, 600, 2)} | {i + 1 for i in range(0, 600, 2) if i not in near_ones}


def test_components_are_exact(spark, docs, rows):
    texts = [(r[0], r[1] or "") for r in rows]
    least = {}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [sets_of(t) for _, t in texts]
    for i, j in combinations(range(len(texts)), 2):
        if alike(sets[i], sets[j]) >= 0.8:
            parent[root(i)] = root(j)
    for i, (d, _) in enumerate(texts):
        least[root(i)] = min(d, least.get(root(i), d))
    want = sorted((d, least[root(i)]) for i, (d, _) in enumerate(texts))
    assert sorted(tuple(r) for r in near.near_components(docs).collect()) == want
    assert near.near_components(docs.limit(0)).count() == 0


def test_large_groups(spark):
    """More copies of one text than a group may join with itself, two edits each: all but one go."""
    draw = random.Random(6)
    base = [f"w{draw.randrange(20_000)}" for _ in range(200)]
    texts = [" ".join(base)] + [" ".join(edited(draw, base, 2)) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [r["doc_id"] for r in near.drop_near_copies(docs).collect()] == [0]


def test_a_large_group_loses_no_link(spark):
    """A group that shares a long passage and whose members are alike in several knots only: all links count, and no others."""
    draw = random.Random(9)
    base = [f"w{draw.randrange(20_000)}" for _ in range(120)]
    texts = []
    for knot in range(5):
        own = edited(draw, base, 2)  # knots are about 0.85 from the base, and less from each other
        texts += [" ".join(edited(draw, own, 1)) for _ in range(40)]
    sets = [sets_of(t) for t in texts]
    least = list(range(len(texts)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if alike(sets[i], sets[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            least[b] = a
    want = [root(i) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [c for _, c in sorted(tuple(r) for r in near.near_components(docs).collect())]
    assert got == want


def test_differences_to_a_reference_lose_no_link(spark):
    """Members that are all apart: what the bound leaves joins exactly what similarity joins, and is far from all pairs."""
    draw = random.Random(12)
    base = [f"w{draw.randrange(20_000)}" for _ in range(150)]
    longer = base + [f"w{draw.randrange(20_000)}" for _ in range(40)]
    texts = [" ".join(base), " ".join(longer)]
    texts += [" ".join(edited(draw, draw.choice((base, longer, base[: 100 + i % 50])), i % 7)) for i in range(140)]
    sets = [sets_of(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    prints = docs.mapInArrow(near._reading(5, False), "row long, key long, n long, fp long, bands array<long>")
    heads = near.settle(prints.groupBy("key").agg(F.min("row").alias("row"), F.first("n").alias("n")), "test-heads")
    row_of = {r["key"]: r["row"] for r in heads.collect()}
    pivot = next(k for k, r in row_of.items() if r == 0)
    members = heads.select(F.lit(pivot).alias("pivot"), "key", "n", F.col("key").alias("root"), F.lit(True).alias("lone"))
    found = [(row_of[r["a"]], row_of[r["b"]]) for r in near._close(members, heads, docs, 0.8, 5).collect()]
    rows = sorted(row_of.values())

    def parts(pairs):
        least = {r: r for r in rows}

        def root(i):
            while least[i] != i:
                i = least[i]
            return i

        for i, j in pairs:
            if alike(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                least[b] = a
        return [root(r) for r in rows]

    assert parts(found) == parts(combinations(rows, 2))
    assert 1 < len(set(parts(found))) < len(rows)


def heads_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    return docs.mapInArrow(near._reading(5, False), "row long, key long, n long, fp long, bands array<long>")


def test_copies_meet_in_the_pivot_table(spark):
    """Keys share a signature where the pivot rows of one of their min-wise fingerprints agree in two families, and most pairs at 0.8 do; others hardly ever."""
    draw = random.Random(21)
    texts = []
    for _ in range(150):  # 404 words are 400 shingles; 9 edits far apart change 45, which leaves 355 of 445: 0.798
        base = [f"w{draw.randrange(50_000)}" for _ in range(404)]
        other = list(base)
        for at in range(9):
            other[20 + 40 * at] = f"edit{draw.getrandbits(40)}"
        texts += [" ".join(base), " ".join(other)]
    heads = near.settle(heads_of(spark, texts), "test-heads")
    rows = {r["key"]: r for r in heads.collect()}
    signed = near._signatures(heads)
    met = {tuple(r) for r in near._pairs(signed.alias("x").join(signed.alias("y"), F.expr("x.sig = y.sig AND x.key < y.key"))).collect()}
    families, own = simhash.references(simhash.COARSE), (1 << 64) - 1
    block = lambda fp, family: tuple(bin((fp & own) & r).count("1") for r in family)
    table = {k: [[block(fp, f) for f in families] for fp in r["bands"]] for k, r in rows.items()}
    want = {(a, b) for a, b in combinations(sorted(rows), 2) if any(sum(p == q for p, q in zip(x, y)) >= 2 for x, y in zip(table[a], table[b]))}
    assert met == want
    copies = sum(rows[a]["row"] // 2 == rows[b]["row"] // 2 for a, b in met)
    print("pairs at 0.798 that met", copies, "others", len(met) - copies)
    assert copies >= 0.98 * 150 and len(met) - copies <= 2


def test_differences_are_held_once(spark, monkeypatch):
    """A text of many large groups is compared with one reference of them all, not with one for each, and no link is lost."""
    draw = random.Random(22)
    base = [f"w{draw.randrange(20_000)}" for _ in range(120)]
    texts = [" ".join(edited(draw, base, 3)) for _ in range(260)]
    held = []

    def close(members, *more):
        held.extend(members.select("pivot", "key").collect())
        return near_close(members, *more)

    near_close = near._close
    monkeypatch.setattr(near, "_close", close)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [c for _, c in sorted(tuple(r) for r in near.near_components(docs).collect())]
    print("held", len(held), "keys", len({r["key"] for r in held}), "references", len({r["pivot"] for r in held}))
    assert len(held) > 100 and len(held) == len({r["key"] for r in held})
    sets = [sets_of(t) for t in texts]
    least = list(range(len(texts)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if alike(sets[i], sets[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            least[b] = a
    assert got == [root(i) for i in range(len(texts))]


def rows_of_joins_by_sig(spark, work):
    """Result of ``work`` and rows that its joins by nothing but ``sig`` have made, as Spark counts them."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        listed = store.executionsList()
        return {listed.apply(i).executionId() for i in range(listed.size())}

    before = executions()
    got, rows = work(), 0
    for e in executions() - before:
        nodes, values = store.planGraph(e).allNodes(), store.executionMetrics(e)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if re.fullmatch(r"\w+Join(\(skew=true\))? \[sig#\d+L?\], \[sig#\d+L?\], Inner(, Build\w+)?(, false)?", node.desc().strip()):
                metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                made = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                rows += sum(int(m.get().replace(",", "")) for m in made if m.isDefined())
    return got, rows


def test_members_are_joined_by_group_few_times(spark):
    """What joins by group make grows with the members of groups: each is met once for all groups, and three times more in large groups that are apart."""
    draw = random.Random(23)
    base = [f"w{draw.randrange(20_000)}" for _ in range(120)]
    texts = [" ".join(edited(draw, base, 3)) for _ in range(260)]
    sizes = Counter(r["sig"] for r in near._signatures(near.settle(heads_of(spark, texts), "test-heads")).select("sig").collect())
    grouped, large = (sum(n for n in sizes.values() if n > least) for least in (1, near.DENSE))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, made = rows_of_joins_by_sig(spark, lambda: near.near_components(docs).count())
    print("members of groups", grouped, "of large ones", large, "rows of joins by group", made)
    assert got == len(texts) and large > 500
    # Besides, a few rows a large group for its reference.
    assert grouped <= made <= grouped + 3 * large + 3 * sum(n > near.DENSE for n in sizes.values())


def test_rows_without_number(spark, docs):
    """A row without a doc_id stays where its component has no other; input columns of any name are carried."""
    a, b = "one text of more than five words in all", "and some other text of its own that is kept"
    rows = [(None, a), (None, a.upper()), (None, b), (4, b), (4, b), (9, b + " "), (None, None), (3, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("mine")).withColumn("key", F.lit("mine")).withColumn("root", F.lit("mine"))
    kept = near.drop_near_copies(table)
    assert kept.columns == table.columns
    got = sorted(((r["doc_id"], (r["text"] or "").strip().lower()) for r in kept.collect()), key=repr)
    assert got == sorted([(None, a), (4, b), (3, "")], key=repr)
    assert near.drop_near_copies(table.limit(0)).count() == 0
