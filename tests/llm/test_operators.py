import zlib
from collections import Counter, defaultdict

import pytest
import reference as R
from pyspark.sql import functions as F

from grovetable.llm import exact, licenses, mixing, packing, quality, sharding, simhash, substrings, toxicity

pytestmark = pytest.mark.filterwarnings("ignore")


def take(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def check_pieces(pieces, rows, tokenizer, size=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    blobs = Counter()
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        blobs[r[0], b"".join(i.to_bytes(4, "little") for i in ids)] += 1
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
    # each id in exactly one piece: pieces of a document, in order of start, give its bytes as often as it occurs
    want = defaultdict(Counter)
    for (d, b), n in blobs.items():
        want[d, len(b) // 4][b] += n
    assert set(want) == set(by_doc)
    for k, ps in by_doc.items():
        n = sum(want[k].values())
        assert sum(p["length"] for p in ps) == n * k[1]
        if len(want[k]) == 1:
            (blob,) = want[k]
            cover = [0] * k[1]
            for p in ps:
                assert bytes(p["ids"]) == blob[4 * p["start"] : 4 * (p["start"] + p["length"])]
                for i in range(p["start"], p["start"] + p["length"]):
                    cover[i] += 1
            assert set(cover) == {n}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for i in sorted(sequences):
        at = 0
        for offset, length in sorted(sequences[i]):
            assert offset == at
            at += length
        assert at == size or i == max(sequences)


def test_packing(docs, rows, nothing, clashing, tokenizer):
    pieces = packing.pack_documents(docs, tokenizer).collect()
    check_pieces(pieces, rows, tokenizer)
    assert packing.pack_documents(nothing, tokenizer).count() == 0
    assert packing.pack_documents(clashing, tokenizer).count() == len(pieces)


def round_robin(queues, quanta, phases):
    """Documents in the order a plain deficit round-robin sends them: (queue, start, place). ``queues``: {name: [tokens, ...]}."""
    out, place = [], 0
    for phase in (0, 1):
        left = {q: list(d) for q, d in queues.items() if phases[q] == phase}
        credit, start = Counter(), Counter()
        while any(left.values()):
            for q in sorted(left):
                credit[q] += quanta[q]
                while left[q] and credit[q] > 1e-9:
                    n = left[q].pop(0)
                    out.append((q, start[q], place))
                    credit[q] -= n
                    start[q] += n
                    place += n
    return out


def walk(pieces, sequence_tokens, weights):
    """What the pieces say, and what walking the queues round by round gives."""
    heads = sorted({(p["source_queue"], p["queue_start"], p["doc_tokens"], p["sequence_id"] * sequence_tokens + p["offset"]) for p in pieces if p["start"] == 0})
    queues = defaultdict(list)
    for q, start, n, _ in heads:
        assert start == sum(queues[q])  # a queue has no gap
        queues[q].append(n)
    named = {q: weights.get(None if q == "1" else q[1:], 0) if weights else sum(d) for q, d in queues.items()}
    phases = {q: int(not w) for q, w in named.items()}
    shares = {q: w or sum(queues[q]) for q, w in named.items()}
    quanta = {q: sequence_tokens * w / sum(x for k, x in shares.items() if phases[k] == phases[q]) for q, w in shares.items()}
    return [(q, s, at) for q, s, _, at in heads], sorted(round_robin(queues, quanta, phases))


@pytest.mark.parametrize("weights", [None, {"a": 4.0, "b": 2.0, "c": 1.0, "Ωd": 1.0, None: 1.0}, {"a": 1.0, "c": 3.0, "b": 0.0}])
def test_packing_is_a_deficit_round_robin(docs, rows, tokenizer, weights):
    pieces = packing.pack_documents(docs, tokenizer, sequence_tokens=64, weights=weights).collect()
    check_pieces(pieces, rows, tokenizer, 64)
    got, want = walk(pieces, 64, weights)
    assert got == want


def test_packing_in_many_blocks(spark):
    """Places do not depend on how rounds are put in blocks."""
    sent = spark.range(500).select("id", F.concat(F.lit("0"), F.col("id") % 3).alias("queue"), F.lit(0).alias("part"), (F.col("id") * 7 % 40 + 1).alias("doc_tokens"))
    by = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("queue").orderBy("id").rowsBetween(-1000, -1)
    sent = sent.withColumn("queue_start", F.coalesce(F.sum("doc_tokens").over(by), F.lit(0))).withColumnRenamed("id", "row")
    one, many = (take(packing.round_places(sent, 64, None, n), "row", "place") for n in (10_000, 20))
    assert one == many


def test_packing_ids_of_any_text(tokenizer):
    """The quick word splitter gives the tokenizer's ids, whatever the characters."""
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    whole, codes = Tokenizer.from_file(tokenizer), packing.WordCodes(tokenizer)
    some = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aZ09 _.,'’-\t\n\x0b\x1c\x85\xa0<|>éßŒǅİıſ²½")), max_size=40)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(some, max_size=4).map(" ".join))
    def same(text):
        assert codes.code(text) == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids)

    same()


def test_sharding(docs, rows, nothing, clashing):
    placed = sharding.shard_by_sampled_splitters(docs.filter("doc_id <> 109"), 4).collect()
    assert len(placed) == len(rows) - 1
    total, by = 0, defaultdict(list)
    for r in placed:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        total += r["size"]
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= max(r["size"] for r in placed)
    assert sharding.shard_by_sampled_splitters(nothing).count() == 0
    out = sharding.shard_by_sampled_splitters(clashing)
    assert out.count() == len(rows) and dict(out.dtypes)["shard"] == "int"


def test_sharding_splits_a_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text number "), "id")).alias("text"))
    sizes = [r[1] for r in sharding.shard_by_sampled_splitters(docs, 8).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.02 * sum(sizes) / 8


def test_sharding_in_many_pieces(spark):
    """Small pieces, a hot text that fills several, and rows that repeat number and text."""
    docs = spark.range(3000).select((F.col("id") % 1500).alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text number "), F.col("id") % 700)).alias("text"))
    placed = sharding.shard_by_sampled_splitters(docs, 4, piece_bytes=300).collect()
    by, shards = defaultdict(list), defaultdict(set)
    for r in placed:
        by[r["shard"]].append(r["slot"])
        shards[r["text"]].add(r["shard"])
    total = sum(r["size"] for r in placed)
    assert len(placed) == 3000 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(abs(sum(r["size"] for r in placed if r["shard"] == k) - total / 4) < 0.02 * total for k in range(4))
    assert sum(len(v) > 1 for v in shards.values()) <= 4  # a boundary cuts the hot text, and at most the piece it lies in


def test_simhash(docs, rows, nothing, clashing):
    want = R.simhash([r[:2] for r in rows])
    assert take(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.simhash_components(nothing).count() == 0
    assert simhash.simhash_components(clashing).count() == len(rows)


def test_simhash_dense_groups(spark, monkeypatch):
    import random

    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(6)]
    values = list({b ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for b in base for _ in range(40)} | set(base))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(values) for b in values[:i] if bin(a ^ b).count("1") <= 2}
    assert {tuple(r) for r in simhash.near_links(prints).collect()} == want
    monkeypatch.setattr(simhash, "DENSE", 3)
    assert {tuple(r) for r in simhash.near_links(prints).collect()} == want


def test_quality(docs, rows, nothing, clashing):
    got = take(quality.quality_verdicts(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((r[0], *R.quality_counts(r[1])) for r in rows), key=repr)
    verdicts = quality.quality_verdicts(docs).collect()
    assert all(not v["kept"] for v in verdicts if v["base_failed"]) and any(v["kept"] for v in verdicts)
    assert quality.quality_verdicts(nothing).count() == 0
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == sum(v["kept"] for v in verdicts)


def test_quality_fences_follow_the_group(spark):
    """Two groups of other habits get other fences on every measure, and a document of the livelier one falls in the other."""
    import random

    draw = random.Random(3)

    def text(lively, words=None):
        own = [draw.choice("abcdefgh") * draw.randint(3, 9 if lively else 5) + str(draw.randrange(10**6)) for _ in range(120)]
        if lively:
            own[3] = "#" * draw.randint(1, 40) + own[3]
            own[20:30] = own[5:15]
        lines = [" ".join(own[i : i + 10]) for i in range(0, 120, 10)] + (["the end of it"] * 3 if lively else [])
        return "\n".join(lines)

    rows = [(i, text(i % 2), "xy"[i % 2], "s") for i in range(400)]
    rows += [(1000 + i, text(1), "x", "s") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    features = quality.keyed(quality.quality_features(docs))
    x, y = sorted(quality.learn_fences(features).collect(), key=lambda r: r["__q_lang"])
    for column in ("__q_word_length_high", "__q_symbol_share_high", "__q_dup_line_share_high", "__q_repeat_share_high"):
        assert x[column] < y[column], column
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(docs).collect()}
    assert sum(kept[i] for i in range(400)) >= 396
    assert not any(kept[1000 + i] for i in range(3))


def test_quality_columns_of_other_names_stay(docs):
    """Input columns that are called like measures, keys or fences are carried through."""
    odd = docs
    for name in ("lang_key", "source_key", "measure", "bucket", "n", "a", "t", "word_length", "word_length_high", "kept"):
        odd = odd.withColumn(name, F.lit("mine"))
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.filter("word_length_high = 'mine' AND a = 'mine'").count() == quality.keep_good(docs).count() > 0


def test_quality_sketches_merge(spark):
    values = spark.range(5000).select((F.col("id") * 37 % 4999).alias("v"))
    off = values.withColumn("b", quality.bucket(F.col("v"))).withColumn("low", quality.bucket_value(F.col("b")))
    assert off.filter("low > v OR v - low > v / 32 + 1").count() == 0


def test_exact(docs, rows, nothing, clashing):
    out = exact.exact_groups(docs)
    assert take(out, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(R.exact([r[:2] for r in rows]), key=repr)
    kept = [r for r in out.collect() if r["kept"]]
    assert len(kept) == len({r[1] or "" for r in rows}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact.exact_groups(nothing).count() == 0
    assert exact.exact_groups(clashing).filter("kept").count() == len(kept)
    # with room for one frequent digest only, the others take the ordinary way
    assert take(exact.exact_groups(docs, frequent=1, tracked=8), "doc_id", "keep_id", "group_size") == take(out, "doc_id", "keep_id", "group_size")


def digests(cut):
    return take(cut.withColumn("kept_sha256", F.sha2("kept_text", 256)), "doc_id", "n_words", "n_removed", "kept_sha256")


def test_repeats(docs, rows, nothing, clashing):
    want = sorted(R.repeats([r[:2] for r in rows]), key=repr)
    for batches in (1, 3, 5):
        cut = substrings.remove_repeats(docs, batches)
        assert digests(cut) == want
    for r in cut.collect():
        assert r["n_removed"] == sum(s["last_word"] - s["first_word"] + 1 for s in r["removed"]) == r["n_words"] - len(R.words(r["kept_text"]))
    assert substrings.remove_repeats(nothing).count() == 0
    assert substrings.remove_repeats(clashing).count() == len(rows)


def test_repeats_without_number_keep_all(spark, rows):
    docs = spark.createDataFrame([(None, rows[0][1] * 3), (None, rows[0][1] * 3), (5, rows[0][1] * 3)], "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.remove_repeats(docs).collect()] == [0, 0, 0]


def test_repeats_of_a_periodic_text(spark):
    """A shingle that comes again and again: stretches are cut at other places in every document."""
    docs = [(1, "a b " * 60), (2, "x y z " + "a b " * 47 + "end"), (3, "b " + "a b " * 9), (4, "p q r " * 30 + "a b " * 8), (5, "q r p " * 25)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert digests(substrings.remove_repeats(table, 2)) == sorted(R.repeats(docs), key=repr)


def test_repeats_against_a_saved_index(spark, tmp_path, docs, rows):
    """Batches added to an index that was saved and opened again give what one run over all gives."""
    want = sorted(R.repeats([r[:2] for r in rows]), key=repr)
    parts = [docs.filter("doc_id < 20"), docs.filter("doc_id >= 20 AND doc_id < 50"), docs.filter("doc_id >= 50")]
    folder = "file://" + str(tmp_path / "index")
    substrings.FingerprintIndex.new(spark, folder, 4).save()
    got, filed = [], None
    for part in parts:
        index = substrings.FingerprintIndex.open(spark, folder)
        got += digests(substrings.remove_repeats(part, 1, index, filed))
        index.save()
        filed = part if filed is None else filed.union(part)
    assert sorted(got, key=repr) == want
    with pytest.raises(ValueError):
        substrings.remove_repeats(parts[0], 1, substrings.FingerprintIndex.open(spark, folder), filed)
    index.close()


def test_mixing(docs, rows, nothing, clashing):
    plan = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(R.words(r[1]))
    want = R.targets(sizes)
    taken = Counter()
    for p in plan:
        source = None if p["source_key"] == "1" else p["source_key"][1:]
        assert p["source_size"] == sizes[source] and abs(p["target"] - want[source]) < 1e-6 * want[source] + 1e-6
        assert 0 <= p["taken"] <= 3 * p["size"]
        taken[source] += p["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(p["size"] for p in plan) == sorted(len(R.words(r[1])) for r in rows)
    assert sorted(map(tuple, plan)) == sorted(map(tuple, mixing.mix_plan(docs).collect()))
    assert mixing.mix_plan(nothing).count() == 0
    assert mixing.mix_plan(clashing).count() == len(rows)
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r["source"]] += len(R.words(r["text"]))
    assert got == +taken


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000, "c": 5}, {"a": 10, "b": 10, "c": 10, None: 10}, {"x": 0, "y": 7}, {"one": 12}])
def test_targets(spark, sizes):
    table = spark.createDataFrame([("1" if k is None else "0" + k, v) for k, v in sizes.items()], "source_key string, source_size long")
    got = {None if r["source_key"] == "1" else r["source_key"][1:]: r["target"] for r in mixing.mix_targets(table).collect()}
    want = R.targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def plain_words(text):
    import re

    return re.findall(r"[^\W_]+", text.lower())


def contained(text, template, lengths=1):
    """The share of a template's five-word shingles in the best stretch of so many times its length."""
    grams = lambda ws: [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    own, have = grams(plain_words(template)), grams(plain_words(text))
    want = set(own)
    places = [i for i, g in enumerate(have) if g in want]
    return max((len({g for g in have[i : i + lengths * len(own)] if g in want}) for i in places), default=0) / len(want)


def test_licenses_against_brute_force(spark, docs, nothing, clashing):
    """Every license, whole and edited, in long texts and alone: what brute force finds is found, and nothing else."""
    import random

    draw = random.Random(12)
    templates = dict(licenses.TEMPLATES)
    filler = lambda n: " ".join(f"filler{draw.randrange(500)}" for _ in range(n))
    rows = []
    for name, text in templates.items():
        for edit in (0, 0, 1, 1, 2, 3):
            ws = text.split()
            for _ in range(edit * max(1, len(ws) // 60) if len(ws) > 12 else 0):
                ws[draw.randrange(len(ws))] = "changed"
            body = " ".join(ws)
            rows.append((len(rows), f"{filler(draw.randrange(400))} {body.upper() if draw.random() < 0.3 else body} {filler(draw.randrange(400))}"))
    rows += [(1000, None), (1001, ""), (1002, filler(3000)), (1003, " ".join(templates["mit"].split()[:90]))]
    found = {(r["doc_id"], r["license_id"]): r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    share = {(d, name): contained(t or "", text) for d, t in rows for name, text in templates.items()}
    want = {k for k, v in share.items() if v >= 0.8}
    assert len(want) > 100 and len(want & set(found)) >= 0.99 * len(want)
    texts = dict(rows)
    for (d, name), r in found.items():  # windows are two to four times as long as the template
        assert max(0.8, share[d, name]) - 1e-9 <= r["containment"] <= contained(texts[d], templates[name], 4) + 1e-9
    whole = [r for (d, name), r in found.items() if r["containment"] == 1.0]
    assert len(whole) >= 2 * len(templates)
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(nothing).count() == 0 and licenses.scan_licenses(clashing).count() == 0
    assert licenses.scan_licenses(docs, ()).count() == 0


def test_toxicity_learns_graded_words(spark, docs, nothing, clashing, rows):
    import random

    draw = random.Random(4)
    def text(bad):
        ws = [f"plain{draw.randrange(300)}" for _ in range(120)] + [draw.choice(["vile", "scum", "idiot", "rot"]) for _ in range(bad)]
        draw.shuffle(ws)
        return " ".join(ws)
    data = [(i, text(bad), int(bad > 0)) for i, bad in enumerate(draw.choice([0, 0, 0, 1, 2, 4]) for _ in range(1200))]
    table = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    labels = table.filter("doc_id < 800").select("doc_id", "toxic")
    held = table.filter("doc_id >= 800")
    got = toxicity.toxicity(table.select("doc_id", "text"), labels).join(held.select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    assert sum(bool(r["truth"]) == r["toxic"] for r in got) / len(got) > 0.97
    mean = lambda want: sum(r["expected_severity"] for r in got if r["severity"] == want) / max(1, sum(r["severity"] == want for r in got))
    assert mean(0) < mean(1) < mean(2)
    none = labels.limit(0)
    assert not any(r["toxic"] for r in toxicity.toxicity(docs, none).collect())
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert toxicity.toxicity(clashing, labels).count() == len(rows)


def test_ordinal_thresholds_stay_in_order():
    model = toxicity.fit_ordinal([(k % 4, [k % 4, 10]) for k in range(400)], 4, least=1)
    assert model.thresholds == sorted(model.thresholds)
    chances = model.chances(0.3)
    assert abs(sum(chances) - 1) < 1e-9 and min(chances) >= 0
    scores = [model.weights.get(k, 0.0) for k in range(4)]
    assert scores == sorted(scores)
