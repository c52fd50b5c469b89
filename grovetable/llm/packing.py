"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of documents. In each round every queue earns a quantum of tokens, its
target share of one sequence, and sends whole documents while it has credit left. What the last
document takes beyond the credit is carried on as the queue's deficit, through sequences and
through partitions alike, and the queue waits until later quanta have paid for it. The document that
starts ``t`` tokens into its queue goes out in round ``floor(t / quantum)``, so every document finds its
round from the queue's prefix sum alone, and its place from a prefix sum over rounds; no task
ever walks a queue. The stream of documents is cut into sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, group_key, settle

#: Documents of a block of rounds, which one task puts in order.
BLOCK_DOCS = 50_000
#: Words that a Python worker remembers, twice at most.
REMEMBERED = 300_000


#: The tokenizer's split pattern, for the characters in PLAIN only.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
PLAIN = "[\x21-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]+"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from 256 up."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Recent(dict):
    """What was lately asked for, worked out on demand: two generations, of which the older goes when the newer is full."""

    def __init__(self, work, size: int):
        super().__init__()
        self.work, self.size, self.old = work, size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.work(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class WordCodes:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never joins tokens across words, so a text's ids are its
    words' ids in a row, and a word needs to be coded only once. Texts of plain letters are cut into the
    vocabulary's words here; of any other text, the chunks with other characters go through the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str, remembered: int = REMEMBERED):
        import re
        from array import array

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file)
        letters, model = byte_letters(), Tokenizer.from_file(tokenizer_file).model
        pack = lambda ids: array("I", ids).tobytes()

        def word(w: str) -> bytes:
            return pack([t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(letters))])

        self.words = Recent(word, remembered)
        self.odd = Recent(lambda c: pack(self.whole.encode(c, add_special_tokens=False).ids), remembered // 10)
        self.plain = re.compile(PLAIN).fullmatch
        self.plain_text = re.compile(PLAIN.replace("[", "[ \\t-\\r", 1).replace("]+", "]*")).fullmatch
        self.pieces = re.compile(PIECES).findall
        self.knotty = re.compile(r"[^\w\s.,]|[\d_]|[.,][.,]").search
        self.chunks = re.compile(r"[^ \t-\r]+").findall

    def _words(self, text: str) -> list[str]:
        import unicodedata

        t = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        if self.knotty(t):
            return self.pieces(t)
        return t.replace(".", " . ").replace(",", " , ").split()

    def code(self, text: str) -> bytes:
        get = self.words.__getitem__
        if "<|" not in text and self.plain_text(text):
            return b"".join(map(get, self._words(text)))
        out = []
        for chunk in self.chunks(text):
            if self.plain(chunk) and "<|" not in chunk:
                out += map(get, self._words(chunk))
            else:
                out.append(self.odd[chunk])
        return b"".join(out)


_codes: dict[str, WordCodes] = {}


def word_codes(tokenizer_file: str) -> WordCodes:
    """The tokenizer of this Python worker, which remembers words from one task to the next."""
    if tokenizer_file not in _codes:
        _codes[tokenizer_file] = WordCodes(tokenizer_file)
    return _codes[tokenizer_file]


TOKENS = "doc_id long, queue string, part int, row long, queue_start long, doc_tokens long, ids binary"


def _tokenizing(tokenizer_file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sent, at = word_codes(tokenizer_file), {}, 0
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for some in by_bytes(batch, 3):
                queues, blobs, starts = some.column(1).to_pylist(), [], []
                for queue, blob in zip(queues, (codes.code(t or "") for t in some.column(3).to_pylist())):
                    blobs.append(blob + end)
                    starts.append(sent.get(queue, 0))
                    sent[queue] = starts[-1] + len(blobs[-1]) // 4
                rows = [(p << 33) + at + i for i, p in enumerate(some.column(2).to_pylist())]
                at += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), some.column(2), pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(b) // 4 for b in blobs], pa.int64()), pa.array(blobs, pa.binary())],
                    names=["doc_id", "queue", "part", "row", "queue_start", "doc_tokens", "ids"],
                )

    return run


def round_places(sent: DataFrame, sequence_tokens: int, weights: dict[str | None, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """row, queue_start (in the whole queue), phase, round and place for every row of ``sent`` (row, queue, part, queue_start, doc_tokens).

    Documents stand in a queue by part, then by queue_start, which counts tokens within the part. ``place`` is the
    number of tokens that go out before the document.
    """
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per queue and task
    bases = sent.groupBy("part", "queue").agg(F.sum("doc_tokens").alias("t")).select("part", "queue", "t", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base"))
    bases = settle(bases, "pack-bases")
    totals = bases.groupBy("queue").agg(F.sum("t").alias("total"))
    if weights is None:
        shares = totals.select("queue", F.lit(0).alias("phase"), F.col("total").cast("double").alias("share"))
    else:
        given = [("1" if k is None else "0" + k, float(w)) for k, w in weights.items() if w > 0]
        table = sent.sparkSession.createDataFrame(given, "queue string, w double")
        shares = totals.join(table, "queue", "left").select("queue", F.when(F.col("w").isNull(), 1).otherwise(0).alias("phase"), F.coalesce("w", F.col("total").cast("double")).alias("share"))
    quanta = shares.withColumn("quantum", sequence_tokens * F.col("share") / F.sum("share").over(Window.partitionBy("phase"))).drop("share")  # a row per queue
    starts = bases.join(quanta, "queue").select("part", "queue", "base", "phase", "quantum")
    rounds = sent.join(starts, ["part", "queue"]).select(
        "row", "queue", (F.col("base") + F.col("queue_start")).alias("queue_start"), "doc_tokens", "phase", F.floor((F.col("base") + F.col("queue_start")) / F.col("quantum")).cast("long").alias("round")
    )
    rounds = settle(rounds, "pack-rounds")

    # Prefix sum over rounds: blocks of rounds first, then documents within a block.
    ends = {r["phase"]: (r["last"], r["n"]) for r in rounds.groupBy("phase").agg(F.max("round").alias("last"), F.count(F.lit(1)).alias("n")).collect()}  # one row per phase
    width = {p: max(1, (last + 1) * block_docs // max(n, block_docs)) for p, (last, n) in ends.items()}
    blocked = rounds.withColumn("block", F.floor(F.col("round") / F.when(F.col("phase") == 1, width.get(1, 1)).otherwise(width.get(0, 1))).cast("long"))
    before = Window.orderBy("phase", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row per BLOCK_DOCS documents
    ahead = blocked.groupBy("phase", "block").agg(F.sum("doc_tokens").alias("t")).select("phase", "block", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("phase", "block").orderBy("round", "queue", "queue_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.join(ahead, ["phase", "block"]).withColumn("place", F.col("ahead") + F.coalesce(F.sum("doc_tokens").over(inside), F.lit(0)))
    return placed.select("row", "queue_start", "phase", "round", "place")


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    sequence_tokens: int = 2048,
    end_id: int = 1,
    weights: dict[str | None, float] | None = None,
) -> DataFrame:
    """Place every token of ``docs`` (doc_id, source, text) into sequences of ``sequence_tokens``.

    ``weights`` gives each source's target share; without it a source's share is its share of all
    tokens, so that all queues run dry together. When a queue runs dry the others go on in their
    own proportions. Sources without a weight, or with none above 0, follow after all others, in
    proportion to their tokens. Sequences are filled without gaps; only the last may be short.

    Returns one row per piece: doc_id, source_queue, queue_start, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset, round. Null text counts as empty and gives the end
    token alone; a null source is a queue of its own; repeated rows are packed each for itself;
    an empty table gives no pieces; other columns are ignored.
    """
    wanted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        group_key(F.col("source")).alias("queue"),
        F.spark_partition_id().alias("part"),
        F.col("text").cast("string").alias("text"),
    )
    tokens = settle(wanted.mapInArrow(_tokenizing(tokenizer_file, end_id), TOKENS), "pack-tokens")
    places = round_places(tokens.select("row", "queue", "part", "queue_start", "doc_tokens"), sequence_tokens, weights)
    size = F.lit(sequence_tokens).cast("long")
    laid = tokens.drop("queue_start", "part").hint("merge").join(places, "row")  # as at scale, where places are too many to send to every task
    first, last = F.floor(F.col("place") / size), F.floor((F.col("place") + F.col("doc_tokens") - 1) / size)

    def piece(s: Column) -> Column:
        start = F.greatest(F.lit(0).cast("long"), s * size - F.col("place"))
        length = F.least(F.col("doc_tokens"), (s + 1) * size - F.col("place")) - start
        ids = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), ids.alias("ids"), s.alias("sequence_id"), (F.col("place") + start - s * size).alias("offset"))

    # A document's pieces hold its ids once, so a very long one costs its length only.
    cut = laid.select("doc_id", F.col("queue").alias("source_queue"), "queue_start", "doc_tokens", "round", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return cut.select("doc_id", "source_queue", "queue_start", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset", "round")
