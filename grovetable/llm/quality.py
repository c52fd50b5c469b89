"""Quality rules whose thresholds follow each language and source.

Every document gets a few whole-number measures. Their distributions are summed up per language
and source in log-bucket quantile sketches: counts per bucket, so sketches of parts, sources or
languages merge by adding up, in any order and without error. Fences drawn from the sketches
replace fixed cutoffs; documents meet their group's fences in a join.

The length of words has fences on both sides, in interquartile ranges beyond the quartiles. The
other measures are zero for most documents, so that quartiles say nothing; their fence is a high
quantile among the group's plain documents, those with ordinary words, and some slack. Where plain documents hold
none at all that fence is zero; so a single occurrence, as ALLOWED counts it, is never held against a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, group_key, settle, words_of

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Buckets per power of two: a quantile is off by one part in 32 at most.
STEPS = 32
#: The measure with fences on both sides, and those with an upper one.
LENGTH, SHARES = "word_length", ("symbol_share", "dup_line_share", "repeat_share")
MEASURES = (LENGTH, *SHARES)
#: Interquartile ranges from the quartiles to the fences of word length, and to the bounds of plain documents.
REACH, PLAIN = 4.0, 1.0
#: The share of plain documents within a fence of the other measures, and its factor.
TAIL, SLACK = 0.998, 1.25
#: Counts that are set off before a share meets its fence, with the whole of the share: two symbols, a line, an 8-word window found twice.
ALLOWED = {"symbol_share": ("n_symbols", 2, "word_chars"), "dup_line_share": ("n_dup_lines", 1, "n_lines"), "repeat_share": ("n_repeat_words", 2 * WINDOW, "n_words")}
OWN = "__quality"


def quality_features(docs: DataFrame, name: str = OWN) -> DataFrame:
    """Add the struct ``name`` of counts and measures of the whole ``text``.

    Counts: n_words, word_chars (code points in words), n_symbols, n_lines and n_dup_lines (of
    lines with a word), n_repeat_words (words inside 8-word windows found twice or more), base_failed.
    Measures, in whole parts of ten thousand: word_length (times 1000 words' mean length), symbol_share
    (symbols to code points in words), dup_line_share, repeat_share. Null text counts as empty: no words,
    all zero, base_failed.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    w, h, p8, s, d = (f"{name}_{x}" for x in ("w", "h", "p", "s", "d"))
    head = lambda a, by: F.slice(a, 1, F.greatest(F.size(a) - by, F.lit(0)))
    tail = lambda a, by: F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))
    step = docs.withColumn(w, words_of(F.col("text").cast("string"))).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    # Hashes of 2, 4, then 8 words in a row: each from two of the half as long. A column each, so that none is worked out twice.
    for by, last in ((1, h), (2, h), (4, p8)):
        step = step.withColumn(last, F.zip_with(head(h, by), tail(h, by), lambda x, y: F.xxhash64(x, y)))
    # Only a text with a window found twice is sorted; windows two or more alike keep all their places.
    found_twice = F.size(F.array_distinct(p8)) < F.size(p8)
    step = step.withColumn(s, F.when(found_twice, F.sort_array(F.transform(F.col(p8), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    flagged = F.filter(
        F.transform(s, lambda y, k: F.when((y["x"] == F.get(F.col(s), k - 1)["x"]) | (y["x"] == F.get(F.col(s), k + 1)["x"]), y["i"])),
        lambda i: i.isNotNull(),
    )
    covered = F.aggregate(
        F.sort_array(flagged),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("end")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i + WINDOW - acc["end"])).cast("long").alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )
    step = step.withColumn(d, F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    lines = F.col(d)
    counts = step.withColumn(
        name,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            # Not deterministic, so that no filter is pushed below and works everything out a second time.
            F.monotonically_increasing_id().alias("row"),
        ),
    ).drop(w, h, p8, s, d)
    q = F.col(name)
    share = lambda part, whole, scale: F.expr(f"{part} * {scale} div greatest({whole}, 1)")
    fields = [f"{name}.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]
    return counts.withColumn(
        name,
        F.struct(
            *[F.col(x) for x in fields],
            ((q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])).alias("base_failed"),
            share(f"{name}.word_chars", f"{name}.n_words", 1000).alias("word_length"),
            share(f"{name}.n_symbols", f"{name}.word_chars", 10_000).alias("symbol_share"),
            share(f"{name}.n_dup_lines", f"{name}.n_lines", 10_000).alias("dup_line_share"),
            share(f"{name}.n_repeat_words", f"{name}.n_words", 10_000).alias("repeat_share"),
        ),
    )


def bucket(value: Column) -> Column:
    """The log bucket of a whole number of 0 or more."""
    power = F.length(F.bin(value + 1)) - 1
    base = F.expr("1L") * F.pow(F.lit(2), power).cast("long")
    return (power * STEPS + F.floor((value + 1 - base) * STEPS / base)).cast("int")


def bucket_value(b: Column) -> Column:
    """The least whole number in a bucket."""
    base = F.pow(F.lit(2), F.floor(b / STEPS)).cast("long")
    return (base + F.ceil(F.pmod(b, F.lit(STEPS)) * base / STEPS) - 1).cast("long")


LANG, SOURCE = "__q_lang", "__q_source"


def sketch(features: DataFrame, measures: tuple[str, ...], name: str = OWN) -> DataFrame:
    """The quantile sketches of languages and sources: one row per measure and bucket in use, with its count."""
    stacked = features.select(LANG, SOURCE, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(f"{name}.{m}")).alias("bucket")) for m in measures])).alias("s"))
    return stacked.groupBy(LANG, SOURCE, "s.measure", "s.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(groups: DataFrame, sketches: DataFrame, shares: dict[str, float], least_docs: int) -> DataFrame:
    """``groups`` (language, source, measure) with a column for each quantile in ``shares``.

    A group of fewer than ``least_docs`` documents takes the merged sketch of its language, and a language of
    fewer that of all documents.
    """
    merged_lang = sketches.groupBy(LANG, "measure", "bucket").agg(F.sum("n").alias("n"))
    merged_all = merged_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    out = groups
    for tag, s, keys in (("own", sketches, [LANG, SOURCE]), ("lang", merged_lang, [LANG]), ("all", merged_all, [])):
        by = Window.partitionBy(*keys, "measure")  # a row per bucket in use: some hundreds
        run = s.withColumn("c", F.sum("n").over(by.orderBy("bucket"))).withColumn("t", F.sum("n").over(by))
        rank = {n: F.ceil(F.col("t") * x) for n, x in shares.items()}
        hit = [F.min(F.when(F.col("c") >= r, F.struct("bucket", "c", "n", r.alias("rank")))).alias(f"{n}_{tag}") for n, r in rank.items()]
        found = run.groupBy(*keys, "measure").agg(F.max("t").alias(f"docs_{tag}"), *hit)
        for n in shares:  # between the least and the largest number of the bucket, by rank
            h = F.col(f"{n}_{tag}")
            low = bucket_value(h["bucket"])
            found = found.withColumn(f"{n}_{tag}", low + (h["rank"] - h["c"] + h["n"]) / h["n"] * (bucket_value(h["bucket"] + 1) - 1 - low))
        out = out.join(found, [*keys, "measure"], "left")
    pick = lambda n: F.when(F.col("docs_own") >= least_docs, F.col(f"{n}_own")).when(F.col("docs_lang") >= least_docs, F.col(f"{n}_lang")).otherwise(F.col(f"{n}_all"))
    return out.select(LANG, SOURCE, "measure", *[pick(n).alias(n) for n in shares])


def keyed(docs: DataFrame) -> DataFrame:
    """Add the keys of language and source; null is a language or source of its own."""
    return docs.withColumn(LANG, group_key(F.col("lang"))).withColumn(SOURCE, group_key(F.col("source")))


def learn_fences(features: DataFrame, name: str = OWN, reach: float = REACH, least_docs: int = 100) -> DataFrame:
    """The fences of every language and source, in columns that start with ``__q_``, from the documents that pass the base rules."""
    fine = features.filter(~F.col(f"{name}.base_failed"))
    lengths = settle(sketch(fine, (LENGTH,), name), "quality-sketch")
    groups = lengths.select(LANG, SOURCE).distinct()
    length = quantiles(groups.withColumn("measure", F.lit(LENGTH)), lengths, {"a": 0.25, "b": 0.75}, least_docs)
    iqr = F.col("b") - F.col("a")
    length = settle(
        length.select(
            LANG, SOURCE, (F.col("a") - reach * iqr).alias(f"__q_{LENGTH}_low"), (F.col("b") + reach * iqr).alias(f"__q_{LENGTH}_high"), (F.col("a") - PLAIN * iqr).alias("__q_plain_low"), (F.col("b") + PLAIN * iqr).alias("__q_plain_high")
        ),
        "quality-lengths",
    )
    plain = fine.join(length, [LANG, SOURCE]).filter(F.col(f"{name}.{LENGTH}").between(F.col("__q_plain_low"), F.col("__q_plain_high")))
    tails = settle(sketch(plain, SHARES, name), "quality-sketch")
    wanted = groups.withColumn("measure", F.explode(F.array(*map(F.lit, SHARES))))
    tail = quantiles(wanted, tails, {"t": TAIL}, least_docs)
    high = tail.groupBy(LANG, SOURCE).agg(*[F.max(F.when(F.col("measure") == m, F.col("t") * SLACK)).alias(f"__q_{m}_high") for m in SHARES])
    limits = settle(length.drop("__q_plain_low", "__q_plain_high").join(high, [LANG, SOURCE]), "quality-fences")
    for done in (lengths, length, tails):
        discard(done)
    return limits


def judge(features: DataFrame, limits: DataFrame, verdict: str = "kept", name: str = OWN) -> DataFrame:
    """Add ``verdict``: false where the base rules fail or a measure lies beyond its group's fences."""
    joined = features.join(limits, [LANG, SOURCE], "left")
    fine = F.col(f"{name}.{LENGTH}").between(F.col(f"__q_{LENGTH}_low"), F.col(f"__q_{LENGTH}_high"))
    for m, (count, allowed, whole) in ALLOWED.items():
        over = F.expr(f"greatest({name}.{count} - {allowed}, 0) * 10000 div greatest({name}.{whole}, 1)")
        fine = fine & F.coalesce(over <= F.col(f"__q_{m}_high"), F.lit(True))
    return joined.withColumn(verdict, ~F.col(f"{name}.base_failed") & F.coalesce(fine, F.lit(True)))


def quality_verdicts(docs: DataFrame, reach: float = REACH, least_docs: int = 100) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs`` (doc_id, text, lang, source).

    Null lang and null source are groups of their own; repeated rows are judged each for itself;
    an empty table gives no rows; other columns are ignored.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    features = settle(keyed(quality_features(own).drop("text")), "quality-features")
    judged = judge(features, learn_fences(features, OWN, reach, least_docs))
    q = F.col(OWN)
    return judged.select("doc_id", *[q[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept", *[q[m].alias(m) for m in MEASURES])


def keep_good(docs: DataFrame, reach: float = REACH, least_docs: int = 100) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whose names must not start with ``__q``."""
    rows = settle(keyed(quality_features(docs)), "quality-rows")  # with the texts, so that measures are worked out once
    return judge(rows, learn_fences(rows, OWN, reach, least_docs), "__q_kept").filter("__q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
