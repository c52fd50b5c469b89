"""License texts found by MinHash bands over overlapping windows.

Texts and templates become sequences of plain words and five-word shingles. Windows of several
lengths, each twice a template size class and moved by half, are min-hashed; a window that
shares a band with a template is a candidate, and the share of the template's shingles that
the window holds decides. A window can share a band only if it holds the shingle that is the
template's minimum there, so texts and windows without any such shingle are left out first.
Templates shorter than a shingle are looked up by their words among the runs of as many words.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, settle
from .license_texts import TEMPLATES

SHINGLE = 5
CONTAINMENT = 0.8
#: Bands of one row each. A template of at least half its class lies with 80 % of its shingles in a window of
#: twice the class, so their Jaccard similarity is 0.19 at least and 32 bands all miss with chance 0.81 ** 32 = 0.001;
#: a whole template has 0.25 at least and 0.0001.
BANDS = 32

#: So many minima, 32 for each template, become constants of the plan; more of them are a table that texts are joined with.
CONSTANTS = 12_800


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: str) -> Column:
    """Hashes of the five-word shingles of a column of words, in order; a shorter text is one shingle; no words, none."""
    w = F.col(words)
    five = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(w) == 0, F.array().cast("array<long>")).when(F.size(w) < SHINGLE, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(five)


def band_minima(hashes: Column, bands: int = BANDS, seed: int = 5) -> Column:
    """(value, shingle) for every band: the least of the shingle hashes under that band's keyed hash, and the shingle it comes from."""
    draw = random.Random(seed)
    keys = [(draw.getrandbits(63), draw.getrandbits(62) * 2 + 1) for _ in range(bands)]
    return F.array(*[F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h.bitwiseXOR(F.lit(x)), F.lit(y)).alias("value"), h.alias("shingle")))) for x, y in keys])


def template_table(spark: SparkSession, templates) -> DataFrame:
    """license_id and words of every template, from (id, text) pairs or a table (license_id, template)."""
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame([(str(a), str(b)) for a, b in templates], "license_id string, template string")
    return templates.select(F.col("license_id").cast("string").alias("license_id"), plain_words(F.col("template")).alias("words")).filter(F.size("words") > 0)


def with_class(table: DataFrame) -> DataFrame:
    """license_id, its shingles and its size class: the power of two at or above its number of shingles."""
    t = table.withColumn("t", F.array_distinct(shingle_hashes("words"))).drop("words")
    return t.withColumn("class", F.pow(F.lit(2), F.ceil(F.log2(F.size("t")))).cast("int"))


def holding(rows: DataFrame, keys: list[str], hashes: str, minima: DataFrame, constants: int) -> DataFrame:
    """The rows of which the array ``hashes`` holds one of ``minima`` (shingle), which has no repeats. ``keys`` tell the rows apart."""
    known = minima.limit(constants + 1).collect()  # bounded
    if len(known) <= constants:
        return rows.filter(F.arrays_overlap(hashes, F.array(*[F.lit(r[0]) for r in known])))
    met = rows.select(*keys, F.explode(hashes).alias("shingle")).join(minima, "shingle", "left_semi").select(*keys).distinct()
    return rows.join(met, keys)


def scan_short(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, license_id, containment, first_word, last_word) of templates under SHINGLE words: the first run of the same words in each document."""
    lengths = sorted(r[0] for r in table.select(F.size("words")).distinct().collect())  # SHINGLE - 1 at most
    w = docs.select("doc_id", plain_words(F.col("text")).alias("w"))
    run = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i + 1, n), " ").alias("run"))))
    runs = w.select("doc_id", F.explode(F.flatten(F.array_compact(F.array(*[run(n) for n in lengths])))).alias("r")).select("doc_id", "r.*")
    named = table.select("license_id", F.size("words").alias("n"), F.array_join("words", " ").alias("run"))
    first = runs.join(named, "run").groupBy("doc_id", "license_id", "n").agg(F.min("at").alias("first_word"))
    return first.select("doc_id", "license_id", F.lit(1.0).alias("containment"), "first_word", (F.col("first_word") + F.col("n") - 1).alias("last_word"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, bands: int = BANDS, constants: int = CONSTANTS) -> DataFrame:
    """(doc_id, license_id, containment, first_word, last_word) of every template found in ``docs`` (doc_id, text), best window each.

    ``templates`` is a list of any number of (id, text), or a table (license_id, template). Word places count plain words from 0.
    Null and empty texts and templates hold nothing; a template shorter than a shingle is found where its words follow each other;
    rows that repeat a doc_id give one result together; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    everything = template_table(spark, templates)
    short, table = everything.filter(F.size("words") < SHINGLE), with_class(everything.filter(F.size("words") >= SHINGLE))
    none = docs.limit(0).select("doc_id", F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"), F.lit(0).alias("last_word"))
    brief = none if short.isEmpty() else scan_short(docs, short)
    banded = settle(table.select("license_id", "class", F.posexplode(band_minima(F.col("t"), bands)).alias("band", "m")).select("license_id", "class", "band", "m.value", "m.shingle"), "license-bands")
    minima = banded.select("shingle").distinct()
    classes = sorted({r["class"] for r in banded.select("class").distinct().collect()})  # powers of two
    if not classes:
        return brief

    # The row number is not deterministic, so the filter is not pushed below and shingles are hashed once.
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), plain_words(F.col("text")).alias("words")).select("doc_id", "row", shingle_hashes("words").alias("s"))
    few = minima.limit(constants + 1).count() <= constants
    numbered = own if few else settle(own, "license-shingles")  # rows that are joined by their number need a lasting one
    shared = settle(holding(numbered, ["row"], "s", minima, constants), "license-shared")

    def windows_of(c: int) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.size("s") / F.lit(c)).cast("int") - 2)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.lit(c).alias("class"), (i * c).alias("at"), F.slice("s", i * c + 1, 2 * c).alias("w")))

    windows = shared.select("doc_id", "row", F.explode(F.flatten(F.array(*[windows_of(c) for c in classes]))).alias("x")).select("doc_id", "row", "x.*")
    windows = settle(holding(windows, ["row", "class", "at"], "w", minima, constants), "license-windows")
    keys = windows.select("row", "class", "at", F.posexplode(F.transform(band_minima(F.col("w"), bands), lambda m: m["value"])).alias("band", "value"))
    met = keys.join(banded.drop("shingle"), ["class", "band", "value"]).select("row", "class", "at", "license_id").distinct()
    met = met.join(windows, ["row", "class", "at"]).join(table.select("license_id", "t"), "license_id")
    met = met.withColumn("containment", F.size(F.array_intersect("t", "w")) / F.size("t")).filter(F.col("containment") >= containment)
    places = F.transform(F.filter(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: F.array_contains(F.col("t"), x["h"])), lambda x: x["i"])
    spans = met.withColumn("p", places).select(
        "doc_id", "license_id", "containment", (F.col("at") + F.array_min("p")).alias("first_word"), (F.col("at") + F.array_max("p") + SHINGLE - 1).alias("last_word")
    )
    best = F.max_by(F.struct("containment", "first_word", "last_word"), F.struct("containment", -F.col("first_word"), -F.col("last_word")))
    found = settle(spans.groupBy("doc_id", "license_id").agg(best.alias("m")), "license-found")
    for done in (banded, shared, windows, *([] if few else [numbered])):
        discard(done)
    return found.select("doc_id", "license_id", "m.containment", "m.first_word", "m.last_word").unionByName(brief)
