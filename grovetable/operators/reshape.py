"""Wide tables to long ones."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_blank, try_num
from .cleaning import with_row_id

PREFIXED = re.compile(r"^(\d{4})\s*(Berat|Tinggi|Tarikh)", re.I)


def registry_to_long(df: DataFrame) -> DataFrame:
    """A row per (row, year) with a weight or a height, from year-prefixed columns; other columns are repeated.

    ``_row_id`` orders the result by input row, then year.
    """
    blocks: dict[str, dict[str, str]] = {}
    for c in df.columns:
        if m := PREFIXED.match(c):
            blocks.setdefault(m[1], {}).setdefault(m[2].capitalize(), c)
    years = sorted(blocks)
    base = [c for c in with_row_id(df).columns if c != "_row_id" and not any(y in c for y in years)]
    value = lambda y, k: F.col(f"`{blocks[y][k]}`").cast("string") if k in blocks[y] else F.lit(None).cast("string")
    if not years:
        return with_row_id(df)
    parts = F.array(*[F.struct(F.lit(int(y)).alias("Year"), *[value(y, k).alias(k) for k in ("Berat", "Tinggi", "Tarikh")]) for y in years])
    long = with_row_id(df).select(F.col("_row_id").alias("__row"), *[F.col(f"`{c}`") for c in base], F.explode(parts).alias("y")).select("__row", *[F.col(f"`{c}`") for c in base], "y.*")
    long = long.filter(try_num(F.col("Berat")).isNotNull() | try_num(F.col("Tinggi")).isNotNull())
    return long.withColumn("_row_id", F.col("__row") * 10_000 + F.col("Year")).drop("__row")


def multiyear_to_long(df: DataFrame, years: tuple[int, ...] = (2023, 2024, 2025, 2026)) -> DataFrame:
    """Year blocks under each other, year by year, with ``tahun_ukur``; rows whose whole block is blank are left out."""
    own = {y: {re.sub(rf"^{y}\s*", "", c).strip(): c for c in df.columns if re.match(rf"^{y}\b", c)} for y in years}
    rest = [c for c in df.columns if not any(c in block.values() for block in own.values())]
    parts = []
    for y, block in own.items():
        if block:
            some = reduce(lambda a, b: a | b, [~is_blank(F.col(f"`{c}`")) for c in block.values()])
            parts.append(df.filter(some).select(*[F.col(f"`{c}`") for c in rest], *[F.col(f"`{c}`").alias(k) for k, c in block.items()], F.lit(str(y)).alias("tahun_ukur")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else df
