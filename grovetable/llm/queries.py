"""The corpus operators as named queries over a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, filter_audit, jaccard, licenses, mixing, packing, quality, sharding, simhash, substrings, toxicity, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids", "source_queue", "queue_start", "round")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    records = table(spark, sf_dir, "documents").select(
        F.col("doc_id"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), (F.octet_length(text) + 1).cast("long").alias("size")
    )  # without texts: places need keys and sizes only
    placed = sharding.shard_by_sampled_splitters(records, key=F.col("text_hash"), size=F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_conversations(table(spark, sf_dir, "conversations"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, sf_dir, "documents"), carry=False)
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).drop("source_key")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_sharding, op3_chat_formatting, op4_simhash, op5_quality_rules, op6_exact_dedup, op7_license_scan, op8_toxicity, op9_substring_dedup, op10_mixing,
        op11_jaccard_join, op12_filter_audit, op13_vector_codes,
    )
}

ORACLES = {
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op12_filter_audit": """
        WITH told AS (SELECT doc_id, max(coalesce((quality = 1)::int, 0)) AS good, max(coalesce((toxic = 1)::int, 0)) AS toxic FROM labels GROUP BY doc_id),
        d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
            FROM documents
        ),
        f AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                   100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(d.doc_id > first_id, false) AS e
            FROM d LEFT JOIN told ON told.doc_id = d.doc_id
        ),
        m AS (
            SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
                   count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
            FROM f GROUP BY ALL
        ),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
            SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM l p, l q, l r, l s, l t
            WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
        ),
        steps AS (SELECT filter_order, k AS step, filter_order[k] AS own, filter_order[1:k - 1] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
        judged AS (
            SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS failing, fails = own AS alone, earlier <> '' AND regexp_matches(fails, concat('[', CASE WHEN earlier = '' THEN '!' ELSE earlier END, ']')) AS gone
            FROM m, steps
        ),
        sums AS (
            SELECT part, filter_order, step, own,
                   coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed, coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
                   coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost
            FROM judged GROUP BY ALL
        )
        SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley
        FROM sums
    """,
}
