"""Identity numbers, names and birth dates as column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import SENTINELS, parse_date

#: Words that tell nothing about who someone is.
PARTICLES = ("bin", "binti", "bt", "bte", "b", "a/l", "a/p", "al", "ap", "anak")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def validate_id(raw: Column) -> Column:
    """struct(valid, issue, cleaned, type) of an identity number: twelve digits that start with a plausible month and day."""
    t = F.trim(raw.cast("string"))
    missing = t.isNull() | F.lower(t).isin(*[s.lower() for s in SENTINELS])
    scientific = t.rlike(r"^[0-9.]+[eE][+]?[0-9]+$")
    t = F.when(scientific, F.coalesce(t.try_cast("double").cast("decimal(30,0)").cast("string"), t)).otherwise(t)
    result = lambda ok, issue, cleaned, kind: F.struct(F.lit(ok).alias("valid"), (issue if isinstance(issue, Column) else F.lit(issue).cast("string")).alias("issue"), (cleaned if isinstance(cleaned, Column) else F.lit(cleaned).cast("string")).alias("cleaned"), F.lit(kind).alias("type"))

    def twelve(t: Column) -> Column:
        digits = F.regexp_replace(F.split(t, "[_-]")[0], "[^0-9]", "")
        return let(digits, lambda d: F.when(F.length(d) < 12, F.regexp_replace(t, "[^0-9]", "")).otherwise(d))

    def judged(whole: Column) -> Column:
        month, day, n = F.substring(whole, 3, 2).try_cast("int"), F.substring(whole, 5, 2).try_cast("int"), F.length(whole)
        return (
            F.when((n == 12) & month.between(1, 12) & day.between(1, 31), result(True, None, whole, "ic"))
            .when(n == 12, result(False, "invalid_date", whole, "ic"))
            .when(n < 12, result(False, F.concat(F.lit("too_short_"), n), whole, "ic"))
            .otherwise(result(False, F.concat(F.lit("too_long_"), n), whole, "ic"))
        )

    def read(t: Column) -> Column:
        return (
            F.when(t.rlike(r"^[A-Za-z]"), result(True, None, t, "system_id"))
            .when(t.rlike(r"^[0-9]+[A-Za-z]"), result(False, "corrupted", F.substring(F.regexp_replace(t, "[^0-9]", ""), 1, 12), "corrupted"))
            .otherwise(let(twelve(t), judged))
        )

    return F.when(missing, result(False, "missing", None, "missing")).otherwise(let(t, read))


def id_gender(cleaned: Column) -> Column:
    """Odd last digit of twelve: Male."""
    d = F.regexp_replace(cleaned.cast("string"), "[^0-9]", "")
    return F.when(F.length(d) == 12, F.when(F.substring(d, 12, 1).try_cast("int") % 2 == 1, "Male").otherwise("Female"))


def id_birth_date(cleaned: Column, as_of: Column) -> Column:
    """The date in the first six digits; two-digit years above this year's are last century's."""
    d = F.regexp_replace(cleaned.cast("string"), "[^0-9]", "")
    yy = F.substring(d, 1, 2).try_cast("int")
    year = F.when(yy > F.year(as_of) % 100, 1900 + yy).otherwise(2000 + yy)
    return F.when(F.length(d) == 12, F.concat_ws("-", year.cast("string"), F.substring(d, 3, 2), F.substring(d, 5, 2)).try_cast("date"))


def norm_id(c: Column) -> Column:
    d = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[ -]", "")
    return F.when(d.rlike(r"^[0-9]{12}$"), d).otherwise("")


def norm_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.upper(F.coalesce(c.cast("string"), F.lit("")))), r"\s+", " ")


def norm_dob(c: Column) -> Column:
    """yyyymmdd text; digits that are day-first are turned round; else empty."""
    d = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")
    year = F.substring(d, 1, 4).try_cast("int")
    return F.when(F.length(d) < 8, "").when(year.between(1900, 2100), F.substring(d, 1, 8)).otherwise(F.concat(F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2)))


def dob_date(c: Column) -> Column:
    return F.coalesce(parse_date(c), F.try_to_date(norm_dob(c), "yyyyMMdd"))


def name_tokens(c: Column) -> Column:
    """Words of a normalised name without particles."""
    return F.array_except(F.array_remove(F.split(F.lower(norm_name(c)), r"[^a-z0-9/]+"), ""), F.array(*[F.lit(p) for p in PARTICLES]))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two strings, 0 to 1."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    """The best of whole-name, sorted-token and token-set similarity."""
    ta, tb = name_tokens(a), name_tokens(b)
    return F.greatest(ratio(norm_name(a), norm_name(b)), ratio(F.array_join(F.sort_array(ta), " "), F.array_join(F.sort_array(tb), " ")), jaccard(ta, tb))


def deletes(c: Column, most: int = 1) -> Column:
    """The string and everything that is left after taking out up to ``most`` characters."""
    out = F.array(c)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))))))
    return out


def check_spelling(df: DataFrame, column: str, valid: list[str], cutoff: float = 0.6) -> DataFrame:
    """(value, n, suggestion) for values outside ``valid``; only distinct values meet the matcher."""
    words = sorted(v.lower() for v in valid)

    @F.pandas_udf("string")
    def closest(values: pd.Series) -> pd.Series:
        return pd.Series([(difflib.get_close_matches(v, words, 1, cutoff) or [None])[0] for v in values], dtype="object")

    v = F.lower(F.trim(F.col(column)))
    off = df.filter(F.col(column).isNotNull() & ~v.isin(words)).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return off.withColumn("suggestion", closest("value"))
