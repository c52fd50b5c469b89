"""Size-balanced shards by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records are range-partitioned by
them; ranges are cut into pieces of bounded bytes, and pieces that are still overfull, since one key
fills them, are subdivided; exact totals then place every record, so shards are as even as the
largest record allows whatever the sample was like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Bytes of records in a piece, which one task sorts.
PIECE_BYTES = 64 << 20


def shard_by_sampled_splitters(
    records: DataFrame,
    n_shards: int = 8,
    ranges_per_shard: int = 16,
    samples_per_range: int = 32,
    piece_bytes: int = PIECE_BYTES,
    snap_share: float = 0.002,
    seed: int = 7,
    key: Column | None = None,
    size: Column | None = None,
) -> DataFrame:
    """Give every row of ``records`` a shard of near equal bytes and a slot in it.

    ``key`` (a 64-bit hash) and ``size`` (bytes, at least 1) may be given; without them the key is a hash of ``text``
    and the size its UTF-8 bytes plus one, none for null text. Equal keys lie side by side and share a shard, but for
    a group larger than ``snap_share`` of a shard, which a boundary may cut. The sample holds about
    ``n_shards * ranges_per_shard * samples_per_range`` keys whatever the input's size; the number of pieces follows
    the input.

    Adds size (long), shard (int), slot (long, gapless from 0 in each shard); input columns of these
    names are replaced, all others are carried along. Repeated rows are placed each for itself;
    an empty table stays empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")) if key is None or size is None else None
    rows = settle(
        records.withColumn("__key", F.xxhash64(text) if key is None else key)
        .withColumn("size", ((F.octet_length(text) + 1) if size is None else size).cast("long"))
        .drop("shard", "slot")
        .withColumn("__row", F.monotonically_increasing_id()),  # written with its row: it would change with the split
        "shard-rows",
    )
    narrow = rows.select("__key", "__row", "size", F.xxhash64("__row", F.lit(seed)).alias("__tie"))
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_ranges = n_shards * ranges_per_shard
    ideal = max(1.0, total / n_ranges)

    # Poisson sample, chance in proportion to size: bounded by its expectation, not by the input.
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(samples_per_range / ideal))
    draw = F.shiftrightunsigned(F.xxhash64("__tie", "__key", F.lit(seed + 1)), 11) / F.lit(float(1 << 53))
    sample = sorted(r[0] for r in narrow.filter(draw < chance).select("__key").collect())
    splitters = sorted({sample[len(sample) * i // n_ranges] for i in range(1, n_ranges)}) if sample else []
    bounds = F.array(*[F.lit(x).cast("long") for x in splitters]) if splitters else F.array().cast("array<long>")
    narrow = narrow.withColumn("__range", F.size(F.filter(bounds, lambda b: b <= F.col("__key"))))

    # A range is cut into pieces at equal steps of the key. At most n_ranges rows come to the driver.
    fill = narrow.groupBy("__range").agg(F.sum("size").alias("fill")).collect()
    ends = [float(x) for x in (-(1 << 63), *splitters, 1 << 63)]
    table = [x for r in fill for x in (r["__range"], F.struct(F.lit(ends[r["__range"]]).alias("low"), F.lit(ends[r["__range"] + 1] - ends[r["__range"]]).alias("width"), F.lit(int(r["fill"] // piece_bytes) + 1).alias("parts")))]
    if table:
        own = F.element_at(F.create_map(*[F.lit(x) if isinstance(x, int) else x for x in table]), F.col("__range"))
        step = F.floor((F.col("__key").cast("double") - own["low"]) / own["width"] * own["parts"])
        piece = F.greatest(F.lit(0), F.least(own["parts"] - 1, step)).cast("int")
    else:
        piece = F.lit(0)
    narrow = narrow.withColumn("__piece", piece)
    # Keys are hashes, so a piece twice as full as meant has a key that fills it: it is subdivided row by row.
    whole = max(piece_bytes, 1 + int(ideal) // 4)
    over = narrow.groupBy("__range", "__piece").agg(F.sum("size").alias("fill")).filter(F.col("fill") > 2 * whole)
    over = over.select("__range", "__piece", F.ceil(F.col("fill") / whole).cast("int").alias("__subs"))
    narrow = narrow.join(over, ["__range", "__piece"], "left").withColumn("__sub", F.when(F.col("__subs").isNull(), 0).otherwise(F.pmod("__tie", "__subs"))).drop("__subs")
    narrow = settle(narrow, "shard-pieces")

    place = ["__range", "__piece", "__sub"]
    sums = narrow.groupBy(*place).agg(F.sum("size").alias("__b"), F.count(F.lit(1)).alias("__n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    in_range = before(Window.partitionBy("__range").orderBy("__piece", "__sub"))
    in_all = before(Window.orderBy("__range"))  # one row per range
    ranges = sums.groupBy("__range").agg(F.sum("__b").alias("__b"), F.sum("__n").alias("__n"))
    ranges = ranges.select("__range", F.coalesce(F.sum("__b").over(in_all), F.lit(0)).alias("__rb"), F.coalesce(F.sum("__n").over(in_all), F.lit(0)).alias("__rn"))
    bases = sums.select(*place, F.coalesce(F.sum("__b").over(in_range), F.lit(0)).alias("__bytes"), F.coalesce(F.sum("__n").over(in_range), F.lit(0)).alias("__rows")).join(ranges, "__range")

    inside = Window.partitionBy(*place).orderBy("__key", "__tie")
    group = Window.partitionBy(*place, "__key").orderBy("__tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        narrow.join(bases, place)
        .withColumn("__at", F.col("__rb") + F.col("__bytes") + F.coalesce(F.sum("size").over(before(inside)), F.lit(0)))
        .withColumn("__nth", F.col("__rn") + F.col("__rows") + F.row_number().over(inside) - 1)
        .withColumn("__first", F.min("__at").over(group))
    )
    snapped = F.when(F.col("__at") - F.col("__first") <= F.lit(int(snap_share * total / n_shards)), F.col("__first")).otherwise(F.col("__at"))
    placed = settle(placed.select("__row", "__nth", F.least(F.lit(n_shards - 1), F.floor(snapped * n_shards / F.lit(max(1, total)))).cast("int").alias("shard")), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("__nth").alias("__start"))  # one row per shard
    slots = placed.join(F.broadcast(firsts), "shard").select("__row", "shard", (F.col("__nth") - F.col("__start")).cast("long").alias("slot"))
    return rows.join(slots, "__row").drop("__row", "__key")
