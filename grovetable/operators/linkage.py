"""Linking records of one person across datasets, and scanning the groups for conflicts.

Every step is an equality join on a block: the number itself, its delete-neighbourhood, name and
birth date, or day of birth. Clusters are led by their earliest record: a record without an
earlier free neighbour becomes a leader, and others join their earliest leader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import deletes, dob_date, name_similarity, norm_dob, norm_id, norm_name

FIELDS = ("ic", "source_type", "dataset_id", "name", "dob", "gender", "state", "district", "measure_date", "weight_kg", "height_cm", "bmi", "waz", "haz", "baz")
#: Which source is believed first.
PRIORITY = {"wide_registry": 0, "wide_multiyear": 1, "school_age": 2, "general": 3}


def child_records(df: DataFrame, dataset_id: str, source_type: str, candidates: dict[str, list[str]]) -> DataFrame:
    """Project any table onto the record fields: the first candidate column that is there, textual nulls as null, a date from year and month if need be."""
    by = {c.lower(): c for c in df.columns}
    pick = lambda f: next((F.col(f"`{by[c.lower()]}`") for c in candidates.get(f, [f]) if c.lower() in by), F.lit(None))
    tidy = lambda c: F.when(~F.lower(F.trim(c.cast("string"))).isin("nan", "none", "nat", ""), F.trim(c.cast("string")))
    numbers = ("weight_kg", "height_cm", "bmi", "waz", "haz", "baz")
    out = {f: pick(f).try_cast("double") if f in numbers else tidy(pick(f)) for f in FIELDS}
    out["dataset_id"], out["source_type"] = F.lit(dataset_id), F.lit(source_type)
    if "year" in by and "month" in by:
        out["measure_date"] = F.coalesce(out["measure_date"], F.format_string("%04d-%02d-01", F.col(by["year"]).try_cast("int"), F.col(by["month"]).try_cast("int")))
    return df.select(*[c.alias(f) for f, c in out.items()])


def numbered(records: DataFrame) -> DataFrame:
    """Add row (order of records), and the normalised id, name and birth date."""
    out = records if "row" in records.columns else records.withColumn("row", F.monotonically_increasing_id())
    return out.withColumn("nid", norm_id(F.col("ic"))).withColumn("nname", norm_name(F.col("name"))).withColumn("ndob", norm_dob(F.col("dob")))


def grouped(records: DataFrame) -> DataFrame:
    """``records`` with ``group``: records with the same twelve digits share the first one's row; any other is a group of its own.

    Records keep their columns on the way, so they need not be met again by row, which two records may share.
    """
    rows = numbered(records)
    lead = rows.filter("nid <> ''").groupBy("nid").agg(F.min("row").alias("lead"))
    return rows.join(lead, "nid", "left").withColumn("group", F.coalesce("lead", "row")).drop("nid", "nname", "ndob", "lead")


def link_exact(records: DataFrame) -> DataFrame:
    """(row, group) of ``grouped``."""
    return grouped(records).select("row", "group")


def fuzzy_pairs(ids: DataFrame, most: int = 1) -> DataFrame:
    """(a, b, a_first, b_first) for distinct ids at most ``most`` edits apart, a first seen before b.

    Ids share a block if deleting up to ``most`` characters can make them equal, so none is missed and no two unrelated ids meet.
    """
    blocks = ids.select("nid", "first", F.explode(deletes(F.col("nid"), most)).alias("block"))
    met = blocks.alias("l").join(blocks.alias("r"), F.expr("l.block = r.block AND l.first < r.first"))
    near = F.levenshtein(F.col("l.nid"), F.col("r.nid"), most)
    return met.filter((near >= 1) & (near <= most)).select(F.col("l.nid").alias("a"), F.col("r.nid").alias("b"), F.col("l.first").alias("a_first"), F.col("r.first").alias("b_first")).distinct()


#: A rest of at most this many open links is decided by one task, and so is each component of a larger rest.
ONE_TASK = 200_000
#: Parallel rounds before the rest is looked at; they decide all but chains.
ROUNDS = 2


def _deciding(kind: str):
    """Rows (root, b, a, a_leads) in order of root, b and a, one with a null ``a`` for every b, to (node, role, leader) of every b.

    Of one component only what has been decided so far is held: a node comes before all that it could lead.
    """

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "bigint": pa.int64()}
        leads, root, b, leader, made = set(), None, None, None, []

        def batch():
            node, role, lead = (list(x) for x in zip(*made)) if made else ([], [], [])
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(node, kinds[kind]), pa.array(role, pa.string()), pa.array(lead, kinds[kind])], names=["node", "role", "leader"])

        def close():
            if b is not None:
                made.append((b, "follows", leader) if leader is not None else (b, "leads", b))
                if leader is None:
                    leads.add(b)

        for part in batches:
            for r, node, a, a_leads in zip(*[c.to_pylist() for c in part.columns]):
                if node != b or r != root:
                    close()
                    b, leader = node, None
                if r != root:
                    root = r
                    leads.clear()
                if a is not None and leader is None and (a_leads or a in leads):
                    leader = a
            yield batch()
        close()
        yield batch()

    return run


def components(links: DataFrame, settle) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b), root the least node reachable.

    Least labels go to neighbours, and labels of labels are taken: settled rounds that grow with the logarithm of a path's length.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").filter("u <> v").distinct())
    labels = settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    while True:
        least = both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("near"))
        near = labels.join(least, "u").select("u", F.col("l").alias("old"), F.least("l", "near").alias("l"))
        moved = settle(near.join(labels.select(F.col("u").alias("l"), F.col("l").alias("ll")), "l").select("u", "old", F.least("l", "ll").alias("l")))
        labels = moved.select("u", "l")
        if moved.filter("old <> l").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("l").alias("root"))


def lead_clusters(nodes: DataFrame, links: DataFrame, settle) -> DataFrame:
    """(node, leader) by greedy leader clustering in order of ``first``.

    ``nodes`` (node, first), ``links`` (a, b, a_first, b_first) with a before b. A node all of whose earlier neighbours are followers
    leads; a node whose earliest neighbour that is not a follower is a leader follows it. Two parallel rounds decide all but
    chains. The rest is decided in order: by one task if it is small, else by tasks that hold whole components. Only components of
    more than ONE_TASK links take further rounds. Every step is settled, so lineage stays short.
    """
    state = settle(nodes.select("node", "first", F.when(F.lit(False), "").alias("role"), F.when(F.lit(False), F.col("node")).alias("leader")))
    links, kind, rounds = settle(links), dict(state.dtypes)["node"], 0
    while True:
        live = links.join(state.select(F.col("node").alias("a"), F.col("role").alias("a_role")), "a").filter("a_role IS NULL OR a_role = 'leads'")
        if rounds == ROUNDS:
            undecided = state.filter("role IS NULL").select(F.col("node").alias("b"), F.col("first").alias("b_first"))
            live = settle(live.join(undecided.select("b"), "b", "left_semi"))
            rows = live.select("b", "b_first", "a", "a_first", F.col("a_role").isNotNull().alias("a_leads"))
            none = rows.schema["a"].dataType, rows.schema["a_first"].dataType
            rows = rows.unionByName(undecided.select("b", "b_first", F.lit(None).cast(none[0]).alias("a"), F.lit(None).cast(none[1]).alias("a_first"), F.lit(False).alias("a_leads")))
            if live.count() <= ONE_TASK:
                rows = rows.join(live.select(F.col("a").alias("b")).union(live.select("b")).distinct(), "b", "left_semi").withColumn("root", F.lit(0)).coalesce(1)
            else:
                roots = components(live.filter("a_role IS NULL"), settle)
                rows = rows.join(roots.withColumnRenamed("node", "b"), "b", "left").withColumn("root", F.coalesce("root", "b"))
                rows = rows.join(rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= ONE_TASK).select("root"), "root").repartition("root")
            decided = rows.sortWithinPartitions("root", "b_first", "b", F.col("a_first").asc_nulls_first()).select("root", "b", "a", "a_leads").mapInArrow(_deciding(kind), f"node {kind}, role string, leader {kind}")
            state = settle(state.join(settle(decided).toDF("node", "r", "l"), "node", "left").select("node", "first", F.coalesce("role", "r").alias("role"), F.coalesce("leader", "l").alias("leader")))
            rounds += 1
            continue
        earliest = live.groupBy("b").agg(F.min(F.struct("a_first", "a", "a_role")).alias("e"))
        now = state.join(earliest, state.node == F.col("b"), "left").select(
            "node", "first",
            F.coalesce("role", F.when(F.col("e").isNull(), "leads").when(F.col("e.a_role") == "leads", "follows")).alias("role"),
            F.coalesce("leader", F.when(F.col("role").isNull() & F.col("e").isNull(), F.col("node")).when(F.col("role").isNull() & (F.col("e.a_role") == "leads"), F.col("e.a"))).alias("leader"),
        )
        state, rounds = settle(now), rounds + 1
        if state.filter("role IS NULL").isEmpty():
            return state.select("node", "leader")


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; one is made only in local mode where none is set."""
    import tempfile

    if not spark.sparkContext.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="spark-grovetable-")
        spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def shared_scratch(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_files(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the session's shared checkpoint folder, so that later passes read only the columns they need."""
    import uuid

    path = f"{shared_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def link_records(records: DataFrame, id_edits: int = 1, dob_days: int = 1, name_cut: float = 0.85, min_confidence: float = 0.0) -> DataFrame:
    """(row, group, confidence, reason) over all datasets.

    1 same number 1.00; 2 numbers within ``id_edits`` edits 0.85 for the whole group; 3 without a number, name and birth date of a group
    0.70; 4 similar name and birth date within ``dob_days`` of a group's first record; 5 the rest, 0.00. A group of two sources or more in one
    single state gains 0.10.
    """
    rows = shared_scratch(numbered(records).withColumn("bdate", dob_date(F.col("dob"))))
    ids = rows.filter("nid <> ''").groupBy("nid").agg(F.min("row").alias("first"))
    clusters = lead_clusters(ids.select(F.col("nid").alias("node"), "first"), fuzzy_pairs(ids, id_edits), shared_scratch)
    sizes = clusters.groupBy("leader").agg(F.count(F.lit(1)).alias("k"))
    lead = clusters.join(sizes, "leader").join(ids.select(F.col("nid").alias("leader"), F.col("first").alias("group")), "leader").select(F.col("node").alias("nid"), "group", F.when(F.col("k") > 1, 0.85).otherwise(1.0).alias("confidence"), F.when(F.col("k") > 1, "fuzzy_ic").otherwise("exact_ic").alias("reason"))
    known = shared_scratch(rows.filter("nid <> ''").join(lead, "nid").select("row", "group", "confidence", "reason", "nname", "ndob", "bdate", "name"))

    bare = rows.filter("nid = ''")
    named = known.filter("nname <> '' AND ndob <> ''").groupBy("nname", "ndob").agg(F.min("group").alias("group"))
    third = bare.filter("nname <> '' AND ndob <> ''").join(named, ["nname", "ndob"]).select("row", "group", F.lit(0.7).alias("confidence"), F.lit("name_dob").alias("reason"))
    # The rest meets the first record of every group, and each other, on the days of birth within reach.
    rest = bare.join(third.select("row"), "row", "left_anti")
    heads = known.groupBy("group").agg(F.min_by(F.struct("name", "bdate"), "row").alias("h")).select(F.col("group").alias("node"), F.col("h.name").alias("name"), F.col("h.bdate").alias("bdate"), F.lit(0).alias("late"))
    members = heads.union(rest.select(F.col("row").alias("node"), "name", "bdate", F.lit(1).alias("late")))
    dated = members.filter("bdate IS NOT NULL AND name IS NOT NULL").withColumn("on", F.col("bdate"))
    near = dated.filter("late = 1").withColumn("on", F.explode(F.sequence(F.date_sub("bdate", dob_days), F.date_add("bdate", dob_days))))
    pairs = near.alias("r").join(dated.alias("l"), F.expr("l.on = r.on AND (l.late < r.late OR (l.late = r.late AND l.node < r.node))"))
    pairs = pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.col("l.name").alias("an"), F.col("r.name").alias("bn"), F.col("l.late").alias("al"))
    alike = pairs.withColumn("s", name_similarity(F.col("an"), F.col("bn"))).filter(F.col("s") >= name_cut).select("a", "b", F.struct(F.col("al"), F.col("a")).alias("a_first"), F.struct(F.lit(1).alias("al"), F.col("b").alias("a")).alias("b_first"))
    nodes = members.select("node", F.struct(F.col("late").alias("al"), F.col("node").alias("a")).alias("first"))
    late = lead_clusters(nodes, alike, shared_scratch)
    fourth = rest.select("row").join(late, F.col("row") == F.col("node")).withColumn("own", F.col("leader") == F.col("row"))
    fourth = fourth.select("row", F.col("leader").alias("group"), F.when(F.col("own"), 0.0).otherwise(0.7).alias("confidence"), F.when(F.col("own"), "unmatched").otherwise("fuzzy_name_dob").alias("reason"))

    linked = known.select("row", "group", "confidence", "reason").unionByName(third).unionByName(fourth)
    per = linked.join(rows.select("row", "state", "dataset_id"), "row").groupBy("group").agg(F.min("confidence").alias("least"), F.count_distinct("state").alias("states"), F.count_distinct("dataset_id").alias("sources"))
    total = F.least(F.lit(1.0), F.round(F.col("least") + F.when((F.col("sources") >= 2) & (F.col("states") == 1), 0.1).otherwise(0.0), 2))
    return linked.drop("confidence").join(per.select("group", total.alias("confidence")), "group").filter(F.col("confidence") >= min_confidence).select("row", "group", "confidence", "reason")


def canonical(linked: DataFrame, fields: list[str], newest: Column | None = None) -> DataFrame:
    """(group, field, value): the most frequent value; ties by newest dataset, then source priority, then value."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("source_type")), F.lit(9))
    rows = linked.select("group", (newest if newest is not None else F.lit(None).cast("timestamp")).alias("at"), rank.alias("rank"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("v")).select("group", "at", "rank", "v.*")
    counts = rows.filter("value IS NOT NULL").groupBy("group", "field", "value").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"), F.min("rank").alias("rank"))
    best = Window.partitionBy("group", "field").orderBy(F.desc("n"), F.desc_nulls_last("at"), "rank", "value")
    return counts.withColumn("k", F.row_number().over(best)).filter("k = 1").select("group", "field", "value")


def timeline(linked: DataFrame) -> DataFrame:
    """(group, seq, at, weight_kg, height_cm, dataset_id): a group's visits by date; undated ones are left out."""
    from ..functions.values import parse_date

    rows = linked.withColumn("at", parse_date(F.col("measure_date"))).filter("at IS NOT NULL")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("group").orderBy("at", "row"))).select("group", "seq", "at", "weight_kg", "height_cm", "dataset_id")


def conflicts(linked: DataFrame, name_soft: float = 0.85, name_hard: float = 0.6) -> DataFrame:
    """(group, field, severity, n_values): gender, state and birth date hard, district soft, names by how far they are from the group's first."""
    simple = linked.select("group", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.upper(F.trim(F.col(f).cast("string"))).alias("value")) for f in ("gender", "state", "dob", "district")])).alias("v")).select("group", "v.*")
    sets = simple.filter("value IS NOT NULL AND value <> ''").groupBy("group", "field").agg(F.count_distinct("value").alias("n_values")).filter("n_values > 1")
    states = sets.filter("field = 'state'").select("group", F.lit(True).alias("moved"))
    sets = sets.join(states, "group", "left").select("group", "field", F.when((F.col("field") == "district") & F.col("moved").isNull(), "soft").otherwise("hard").alias("severity"), "n_values")
    names = linked.filter("name IS NOT NULL").select("group", "row", "name")
    first = names.groupBy("group").agg(F.min_by("name", "row").alias("lead"), F.count_distinct("name").alias("n_values")).filter("n_values > 1")
    far = names.select("group", "name").distinct().join(first, "group").filter("name <> lead").withColumn("s", name_similarity(F.col("name"), F.col("lead"))).groupBy("group").agg(F.min("s").alias("s"), F.max("n_values").alias("n_values"))
    return sets.unionByName(far.select("group", F.lit("name").alias("field"), F.when(F.col("s") >= name_soft, "soft").when(F.col("s") >= name_hard, "hard").otherwise("strong").alias("severity"), "n_values"))


def reconciliation(linked: DataFrame) -> DataFrame:
    """One row: records, groups, duplicates, their rate, groups over several sources."""
    per = linked.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dataset_id").alias("s"))
    out = per.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("s") > 1).alias("multi_source"))
    return out.withColumn("duplicates", F.col("records") - F.col("groups")).withColumn("duplicate_rate", F.round(100.0 * (F.col("records") - F.col("groups")) / F.col("records"), 2))


def source_overlap(linked: DataFrame) -> DataFrame:
    """(sources, groups): groups by their set of datasets."""
    per = linked.groupBy("group").agg(F.array_join(F.array_sort(F.collect_set("dataset_id")), "+").alias("sources"))
    return per.groupBy("sources").agg(F.count(F.lit(1)).alias("groups"))


def export_rows(linked: DataFrame) -> DataFrame:
    """One row per group and dataset, largest groups first."""
    size = F.count(F.lit(1)).over(Window.partitionBy("group"))
    rows = linked.withColumn("group_size", size).groupBy("group", "dataset_id", "source_type").agg(F.max("group_size").alias("group_size"), F.max("confidence").alias("confidence"), F.min("row").alias("first_row"))
    return rows.orderBy(F.desc("group_size"), F.desc("confidence"), "group", "dataset_id")


def duplicate_worklist(linked: DataFrame) -> DataFrame:
    """The records of every group that has more than one."""
    several = linked.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
    return linked.join(several, "group").select("group", "row", "ic", "name", "dob", "source_type", "dataset_id", "confidence")


def conflict_worklist(linked: DataFrame) -> DataFrame:
    """The records of every group with a conflict, once for each field in conflict, with that field's ``value`` in the record.

    Values stay in their records' rows, so a large group is never gathered in one cell.
    """
    value = F.try_element_at(F.create_map(*[x for f in ("gender", "state", "dob", "district", "name") for x in (F.lit(f), F.col(f).cast("string"))]), F.col("field"))
    found = linked.join(conflicts(linked).select("group", "field", "severity"), "group")
    return found.select("group", "row", "ic", "name", "dob", "source_type", "dataset_id", "confidence", "field", "severity", value.alias("value"))
