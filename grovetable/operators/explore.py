"""Search, sort, page, flag and edit rows of a cleaned table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import try_num
from ..plans.ranges import RANGES, bounds
from ..plans.rules import humanise


def place_filter(df: DataFrame, state: str | None = None, district: str | None = None, state_col: str = "negeri", district_col: str = "daerah") -> DataFrame:
    """Rows of a state and district, whatever the case; blanks around a state do not count."""
    if state:
        df = df.filter(F.lower(F.trim(F.col(state_col).cast("string"))) == state.strip().lower())
    return df.filter(F.lower(F.col(district_col).cast("string")) == district.lower()) if district else df


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows with a public column that holds the text; nan and none hold nothing."""
    q = query.strip().lower()
    cells = [F.lower(F.col(f"`{c}`").cast("string")) for c in df.columns if not c.startswith("_")]
    return df.filter(F.exists(F.array(*cells), lambda x: F.coalesce(x.contains(q) & ~x.isin("nan", "none"), F.lit(False)))) if q else df


def page(df: DataFrame, sort: str | None = None, descending: bool = False, offset: int = 0, limit: int = 10_000, key: str = "_row_id") -> DataFrame:
    """A window of the sorted table, nulls last, ties by row."""
    order = [F.col(key)]
    if sort:
        order.insert(0, F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last())
    return df.orderBy(*order).offset(offset).limit(min(limit, 100_000))


def page_info(df: DataFrame, size: int) -> dict:
    n = df.count()
    return {"total": n, "total_pages": max(1, -(-n // size))}


def row_flag(weight: Column, height: Column, bmi: Column, reason: Column | None = None, quality: Column | None = None) -> Column:
    """True for a row to look at: a quality label other than Valid if there is one, else a review reason, a gap or a value outside the screen's bounds."""
    if quality is not None:
        return F.coalesce(quality != "Valid", F.lit(True))
    out = F.lit(False) if reason is None else F.coalesce(F.trim(reason) != "", F.lit(False))
    for c, k in ((weight, "flag_weight"), (height, "flag_height"), (bmi, "flag_bmi")):
        out = out | c.isNull() | ~c.between(*bounds(RANGES, k))
    return out


def cell_state(c: Column, key: str, margin: float = 0.1) -> Column:
    """danger outside the bounds or missing, warn within a tenth of the span of an edge, else ok."""
    low, high = bounds(RANGES, key)
    edge = (high - low) * margin
    return F.when(c.isNull() | ~c.between(low, high), "danger").when(~c.between(low + edge, high - edge), "warn").otherwise("ok")


def analysis_view(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter("analyzable").drop("analyzable", "exclude_reason", "review_reason", "drop_codes", "review_codes")


def full_view(cleaned: DataFrame, key: str = "_row_id") -> DataFrame:
    """Flags first, codes as labels, analyzable rows on top in file order."""
    flags = ["analyzable", "exclude_reason", "review_reason"]
    shown = [F.col("analyzable"), *[humanise(F.col(c)).alias(c) for c in flags[1:] if c in cleaned.columns]]
    rest = [F.col(f"`{c}`") for c in cleaned.columns if c not in flags]
    return cleaned.select(*shown, *rest).orderBy(F.desc("analyzable"), key)


def explorer_view(cleaned: DataFrame) -> DataFrame:
    return cleaned.withColumn("_exclude_label", humanise(F.col("exclude_reason"))).drop("analyzable")


def apply_edits(df: DataFrame, edits: DataFrame, key: str = "_row_id") -> DataFrame:
    """Overlay (row, column, value, edited_at) edits; the latest wins; a number column takes numbers only."""
    names = [c for c in df.columns if c != key]
    last = edits.filter(F.col("column").isin(names)).groupBy(F.col("row").alias(key), "column").agg(F.max_by("value", "edited_at").alias("value"))
    changes = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("__edits"))
    joined = df.join(changes, key, "left")
    kinds = dict((f.name, f.dataType) for f in df.schema)

    def cell(c: str) -> Column:
        new = F.try_element_at("__edits", F.lit(c))
        typed = try_num(new).cast(kinds[c]) if isinstance(kinds[c], T.NumericType) else new.cast(kinds[c])
        return F.when(F.coalesce(F.map_contains_key("__edits", F.lit(c)), F.lit(False)), typed).otherwise(F.col(f"`{c}`")).alias(c)

    return joined.select(F.col(key), *[cell(c) for c in names])


def select_rows(df: DataFrame, flagged: bool = False, analyzable: bool = False, query: str = "") -> DataFrame:
    """The screen's filters: flagged only, analyzable only, search."""
    keep = [F.lit(True)]
    if flagged:
        keep.append(F.coalesce(F.trim("review_reason") != "", F.lit(False)))
    if analyzable:
        keep.append(F.col("analyzable"))
    return search(df.filter(reduce(lambda a, b: a & b, keep)), query)
