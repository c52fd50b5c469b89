"""Repeated passages found through a log-structured fingerprint index.

Every window of 13 words is filed under its anchor, the least hash of its nine five-word shingles.
Neighbouring windows mostly share their anchor; a stretch of up to nine of them is one entry of the
index: its anchor and the hash of all its words. Equal windows have equal anchors, so none is
missed, and the index holds about a fifth as many entries as there are windows.

The index is a list of immutable runs, each sorted and bucketed by anchor. A new batch of documents
becomes a run and is merge-joined with the runs before it. Stretches whose words agree are
repeats as a whole. Where only the anchor agrees, the windows of one document for each different
stretch are compared by their own hashes. Two hashes of 64 bits, of other words and with other
bases, must agree before words go: the anchor's and the stretch's or window's. Runs of one level are
compacted into one of the next; a saved index is opened again for a later batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, discard, release, remove_path, scratch_root, settle

WINDOW = 13
SHINGLE = 5
#: Runs of one level that are compacted into one run of the next.
FANOUT = 2
#: Odd multipliers of the two rolling hashes, below 2 ** 64.
ANCHOR_BASE, WHOLE_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Rolling:
    """64-bit hashes of any spans of a byte string, from one running sum."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, None, None
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        """Powers of the base and of its inverse, up to ``n``."""
        import numpy as np

        n = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            powers = lambda b: np.concatenate((np.ones(1, dtype=np.uint64), np.multiply.accumulate(np.full(n, b, dtype=np.uint64))))
            self.up, self.down = powers(self.base), powers(pow(self.base, -1, 1 << 64))

    def spans(self, data, starts, ends):
        import numpy as np

        if len(data) >= len(self.up):
            self.grow(len(data) + 1)
        with np.errstate(over="ignore"):
            run = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=run[1:])
            x = (run[ends] - run[starts]) * self.down[starts]
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))


class Windows:
    """Anchors, stretches and whole-window hashes of texts, as spans of their words joined by one blank."""

    def __init__(self, window: int = WINDOW, shingle: int = SHINGLE):
        self.window, self.shingle = window, min(shingle, window)
        self.longest = self.window - self.shingle + 1
        self.near, self.far = Rolling(ANCHOR_BASE), Rolling(WHOLE_BASE)

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").split()

    def edges(self, words: list[bytes]):
        """The joined words, and where each starts and ends."""
        import numpy as np

        data = np.frombuffer(b" ".join(words), dtype=np.uint8)
        blanks = np.flatnonzero(data == 32)
        return data, np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(data)]))

    def stretches(self, words: list[bytes]):
        """(anchors, hashes, first windows, numbers of windows, edges) of all stretches, in order; None for a text without a window."""
        import numpy as np

        if len(words) < self.window:
            return None
        data, starts, ends = edges = self.edges(words)
        least = self.near.spans(data, starts[: len(words) - self.shingle + 1], ends[self.shingle - 1 :])
        done = 1
        while done < self.longest:  # minima over 2, 4, 8 ... shingles, then as many as are asked for
            by = min(done, self.longest - done)
            least = np.minimum(least[:-by], least[by:])
            done += by
        n = len(least)
        first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        counts = np.diff(np.append(first, n))
        if counts.max() > self.longest:  # a shingle that comes again and again: cut into pieces
            pieces = -(-counts // self.longest)
            first = np.repeat(first, pieces) + self.longest * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            counts = np.diff(np.append(first, n))
        hashes = self.far.spans(data, starts[first], ends[first + counts + self.window - 2])
        return least[first].view(np.int64), hashes.view(np.int64), first, counts, edges

    def whole(self, edges, at):
        """The hashes of the windows that start at the words ``at``."""
        import numpy as np

        data, starts, ends = edges
        return self.far.spans(data, starts[at], ends[at + self.window - 1]).view(np.int64)


def _filing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    own, none = Windows(), np.empty(0, dtype=np.int64)
    for batch in batches:
        for some in by_bytes(batch, 1):
            found = [own.stretches(own.words(t)) or (none, none) for t in some.column(1).to_pylist()]
            ids = np.repeat(np.asarray(some.column(0).to_numpy(zero_copy_only=False)), [len(x[0]) for x in found])
            anchors, hashes = (np.concatenate([x[i] for x in found]) if found else none for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(hashes, pa.int64()), pa.array(ids).cast(pa.int64())], names=["anchor", "stretch", "doc_id"])


def index_entries(docs: DataFrame) -> DataFrame:
    """(anchor, stretch, doc_id) of every stretch in ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_filing, "anchor long, stretch long, doc_id long")


@dataclass
class Run:
    level: int
    table: str
    path: str
    last_doc: int


@dataclass
class FingerprintIndex:
    """Sorted immutable runs of (anchor, stretch, first_doc): the stretches of documents filed so far and the smallest doc_id of each.

    ``save`` notes the runs in ``folder``, and ``open`` takes them up again, in another session too.
    """

    spark: SparkSession
    buckets: int
    folder: str
    fanout: int = FANOUT
    runs: list[Run] = field(default_factory=list)

    @classmethod
    def new(cls, spark: SparkSession, folder: str | None = None, buckets: int | None = None) -> FingerprintIndex:
        folder = folder or f"{scratch_root(spark)}/substring-index-{uuid.uuid4().hex}"
        return cls(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index as last saved in ``folder``."""
        saved = spark.read.parquet(f"{folder}/saved")
        rows = saved.join(saved.agg(F.max("version").alias("version")), "version").collect()  # a row per run
        index = cls(spark, rows[0]["buckets"], folder, rows[0]["fanout"])
        for r in (r for r in rows if r["path"]):
            name = f"grovetable_run_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} (anchor LONG, stretch LONG, first_doc LONG, last_doc LONG) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor, stretch) INTO {index.buckets} BUCKETS LOCATION '{r['path']}'")
            index.runs.append(Run(r["level"], name, r["path"], r["last_doc"]))
        return index

    def save(self) -> None:
        """Note the runs as the next version of the index."""
        rows = [(r.level, r.path, r.last_doc, self.buckets, self.fanout) for r in self.runs] or [(0, "", 0, self.buckets, self.fanout)]
        table = self.spark.createDataFrame(rows, "level int, path string, last_doc long, buckets int, fanout int")
        version = 0
        if self._exists(f"{self.folder}/saved"):
            version = self.spark.read.parquet(f"{self.folder}/saved").agg(F.max("version")).first()[0] + 1
        table.coalesce(1).write.parquet(f"{self.folder}/saved/version={version}")

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _write(self, rows: DataFrame, level: int, last_doc: int) -> Run:
        name = f"grovetable_run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        (
            rows.repartition(self.buckets, "anchor").write.option("path", path).option("compression", "zstd")
            .bucketBy(self.buckets, "anchor").sortBy("anchor", "stretch").format("parquet").saveAsTable(name)
        )
        release(self.spark)
        return Run(level, name, path, last_doc)

    def add(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """File a batch's entries (anchor, stretch, doc_id), whose ids must be above all filed ones.

        Returns the stretches that are repeats as a whole (doc_id, stretch), and those whose windows must be
        compared (doc_id, stretch): one document for every different stretch of an anchor, filed ones included.
        """
        low, high = entries.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is not None and any(r.last_doc >= low for r in self.runs):
            raise ValueError("a batch's doc_ids must be above all that are filed")
        first, last = F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
        new = self._write(entries.groupBy("anchor", "stretch").agg(first, last), 0, high or 0)
        batch = self.spark.table(new.table)
        met = [self.spark.table(r.table).join(batch, "anchor", "left_semi").select("anchor", "stretch", "first_doc") for r in self.runs]
        filed = settle(reduce(DataFrame.union, met), "substring-filed") if met else None
        several = batch.groupBy("anchor").count().filter("count > 1").select("anchor")
        if filed is not None:
            several = several.union(filed.select("anchor")).distinct()
        near = batch.join(several.withColumn("several", F.lit(True)), "anchor", "left").filter("several OR last_doc > first_doc")
        near = near.select("anchor", "stretch", F.coalesce("several", F.lit(False)).alias("several"), "first_doc", "last_doc", F.lit(True).alias("fresh"), F.lit(False).alias("filed"))
        if filed is not None:
            near = near.union(filed.select("anchor", "stretch", F.lit(True), "first_doc", F.col("first_doc").alias("last_doc"), F.lit(False), F.lit(True)))
            near = near.groupBy("anchor", "stretch").agg(
                F.max("several").alias("several"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.max("fresh").alias("fresh"), F.max("filed").alias("filed")
            )
        near = settle(near, "substring-near")
        again = near.filter("fresh AND (filed OR last_doc > first_doc)").select("anchor", "stretch", "first_doc")
        repeats = settle(entries.join(again, ["anchor", "stretch"]).filter("doc_id > first_doc").select("doc_id", "stretch").distinct(), "substring-whole")
        compare = settle(near.filter("several").select(F.col("first_doc").alias("doc_id"), "stretch"), "substring-compare")
        for done in [near, *([filed] if filed is not None else [])]:
            discard(done)
        self.runs.append(new)
        self._compact()
        return repeats, compare

    def _compact(self) -> None:
        level = 0
        while sum(r.level == level for r in self.runs) >= self.fanout:
            old = [r for r in self.runs if r.level == level]
            rows = reduce(DataFrame.union, [self.spark.table(r.table).select("anchor", "stretch", "first_doc", "last_doc") for r in old])
            merged = rows.groupBy("anchor", "stretch").agg(F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))
            self.runs = [r for r in self.runs if r.level != level] + [self._write(merged, level + 1, max(r.last_doc for r in old))]
            self._drop(old)
            level += 1

    def _drop(self, runs: list[Run]) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r.table}")
            remove_path(self.spark, r.path)

    def close(self) -> None:
        """Delete all runs."""
        self._drop(self.runs)
        self.runs = []
        remove_path(self.spark, self.folder)


def _showing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the stretches that are asked for."""
    import numpy as np

    own = Windows()
    for batch in batches:
        for some in by_bytes(batch, 1):
            rows = [[], [], [], [], []]
            for doc_id, text, asked in zip(*(some.column(i).to_pylist() for i in range(3))):
                found = own.stretches(own.words(text))
                if found is None:
                    continue
                anchors, hashes, first, counts, edges = found
                hit = np.flatnonzero(np.isin(hashes, np.asarray(asked, dtype=np.int64)))
                n = counts[hit]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                columns = (np.full(n.sum(), doc_id), np.repeat(hashes[hit], n), place, np.repeat(anchors[hit], n), own.whole(edges, np.repeat(first[hit], n) + place))
                for out, column in zip(rows, columns):
                    out.append(column)
            if rows[0]:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r)).cast(k) for r, k in zip(rows, kinds)], names=["doc_id", "stretch", "place", "anchor", "hash"])


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    own = Windows()
    span = pa.struct([("first_word", pa.int32()), ("last_word", pa.int32())])
    for batch in batches:
        for some in by_bytes(batch, 1):
            counts, removed, kept, spans = [], [], [], []
            for text, drops in zip(some.column(1).to_pylist(), some.column(2).to_pylist()):
                words = own.words(text)
                gone, found = np.zeros(len(words) + 1, dtype=np.int32), own.stretches(words) if drops else None
                if found is not None:
                    masks = {d["stretch"]: d["mask"] for d in drops}
                    for h, at, n in zip(found[1].tolist(), found[2].tolist(), found[3].tolist()):
                        mask = masks.get(h, 0)
                        for k, m in ((0, n),) if mask == -1 else ((k, 1) for k in range(n) if mask >> k & 1):
                            gone[at + k] += 1
                            gone[at + k + m - 1 + WINDOW] -= 1
                away = np.concatenate(([False], np.cumsum(gone[:-1]) > 0, [False]))
                ends = np.flatnonzero(away[1:] != away[:-1])
                spans.append([{"first_word": int(a), "last_word": int(b) - 1} for a, b in zip(ends[::2], ends[1::2])])
                counts.append(len(words))
                removed.append(int(away.sum()))
                kept.append(b" ".join([w for w, g in zip(words, away[1:].tolist()) if not g] if removed[-1] else words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(span))], names=["doc_id", "n_words", "n_removed", "kept_text", "removed"]
            )


def remove_repeats(docs: DataFrame, batches: int = 3, index: FingerprintIndex | None = None, filed: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and removed (first and last word of each span) for every row of ``docs`` (doc_id, text).

    A word goes if a window of 13 words covers it whose words also start in a document with a smaller
    doc_id. Kept words are joined by one blank. Null text has no words; texts under 13 words keep all; rows that share a
    doc_id are one document when it comes to "smaller"; rows without a doc_id keep everything; an empty table
    gives no rows; other columns are ignored.

    With an ``index``, its documents count as well and ``docs``, whose ids must be above theirs, are added to it; ``filed``
    (doc_id, text) are its documents, of which those are read that share an anchor. Without one, an index is made and deleted.
    """
    spark = docs.sparkSession
    narrow = lambda d: d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = narrow(docs)
    bounds = own.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = sorted({int(b) for b in bounds})
    used = index or FingerprintIndex.new(spark)
    whole: list[DataFrame] = []
    compare: list[DataFrame] = []
    try:
        for low, high in zip([None, *bounds], [*bounds, None]):
            part = own.filter("doc_id IS NOT NULL")
            part = part.filter(F.col("doc_id") > low) if low is not None else part
            part = part.filter(F.col("doc_id") <= high) if high is not None else part
            entries = settle(index_entries(part), "substring-entries")
            for kind, found in zip((whole, compare), used.add(entries)):
                kind.append(found)
            discard(entries)
    finally:
        if index is None:
            used.close()

    asked = reduce(DataFrame.union, compare).groupBy("doc_id").agg(F.collect_set("stretch").alias("asked"))  # no more than the document's own stretches
    texts = own if filed is None else own.union(narrow(filed))
    shown = settle(texts.join(asked, "doc_id").mapInArrow(_showing, "doc_id long, stretch long, place int, anchor long, hash long"), "substring-shown")
    for c in compare:
        discard(c)
    first = shown.groupBy("anchor", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("last > first").drop("last")
    later = shown.join(first, ["anchor", "hash"]).filter("doc_id > first")
    partly = later.groupBy("doc_id", "stretch").agg(F.bit_or(F.expr("shiftleft(1, place)")).alias("mask"))
    wholly = reduce(DataFrame.union, whole).select("doc_id", "stretch", F.lit(-1).alias("mask"))
    drops = settle(partly.union(wholly).groupBy("doc_id").agg(F.collect_list(F.struct("stretch", "mask")).alias("drops")), "substring-drops")
    for done in (*whole, shown):
        discard(done)
    return own.join(drops, "doc_id", "left").mapInArrow(_cutting, "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<first_word: int, last_word: int>>")
