"""Entry errors: suggestions for values far out, and a robust anomaly score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import try_num
from .profile import long_numbers
from .quantiles import percentiles


def _medians(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float, int]]:
    return {c: (*p, n) for c, (n, p) in percentiles(long_numbers(df, columns), (0.25, 0.5, 0.75)).items()}


def swapped_digits(c: Column) -> Column:
    """All numbers that one swap of neighbouring digits makes."""
    t = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(24,4)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1, F.lit(1)), F.substr(t, i, F.lit(1)), F.substr(t, i + 2)).try_cast("double"))


def suggestions(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, column, value, suggestion, pattern, error_type) for values beyond three interquartile ranges.

    Patterns in order: ten times or a tenth of the median, two digits swapped, another column's median. Columns with fewer than ten numbers are left alone.
    """
    stats = {c: s for c, s in _medians(df, columns).items() if s[3] >= 10}
    parts = []
    for c, (a, m, b, _) in stats.items():
        x = try_num(F.col(f"`{c}`"))
        r = F.try_divide(x, F.lit(m))
        swap = F.exists(swapped_digits(x), lambda y: F.abs(y - m) <= 0.05 * abs(m))
        pattern = F.when(r.between(9.5, 10.5), "decimal_shift_x10").when(r.between(0.095, 0.105), "decimal_shift_div10").when(swap, "digit_transposition")
        for other, (oa, om, ob, _) in stats.items():
            if other != c:
                pattern = pattern.when(F.abs(x - om) <= ob - oa, f"column_swap:{other}")
        off = (x < a - 3 * (b - a)) | (x > b + 3 * (b - a))
        parts.append(F.when(off, F.struct(F.lit(c).alias("column"), x.alias("value"), F.lit(round(m, 4)).alias("suggestion"), pattern.alias("pattern"))))
    if not parts:
        parts = [F.lit(None).cast("struct<column:string,value:double,suggestion:double,pattern:string>")]
    out = df.select(F.col(key), F.explode(F.array_compact(F.array(*parts))).alias("s")).select(key, "s.*")
    return out.withColumn("error_type", F.when(F.col("pattern").isNotNull(), "entry_error").otherwise("unknown"))


def anomaly_flags(df: DataFrame, columns: list[str], share: float = 0.05, least: int = 10) -> DataFrame:
    """Add anomaly_score and is_anomaly: the largest robust distance over the columns; the top ``share`` is flagged.

    Distances are to the median in units of the median absolute deviation; a missing number counts as the median.
    A frame of fewer than ``least`` rows has no anomalies.
    """
    med = {c: s[1] for c, s in _medians(df, columns).items()}
    gaps = df.select(*[F.abs(F.coalesce(try_num(F.col(f"`{c}`")), F.lit(m)) - m).alias(c) for c, m in med.items()])
    mads = {c: s[1] for c, s in _medians(gaps, list(med)).items()}
    dist = [F.abs(F.coalesce(try_num(F.col(f"`{c}`")), F.lit(m)) - m) / (1.4826 * mads[c] or 1.0) for c, m in med.items()]
    scored = df.withColumn("anomaly_score", F.greatest(*dist, F.lit(0.0)) if dist else F.lit(0.0))
    n, cuts = percentiles(scored.select(F.lit("score").alias("column"), F.col("anomaly_score").alias("x")), (1 - share,)).get("score", (0, []))
    cut = cuts[0] if n >= least else float("inf")
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > cut)
