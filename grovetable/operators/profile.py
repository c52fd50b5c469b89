"""Column profiles, distributions, outliers and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import missing_severity, severity_score, text, try_num
from .quantiles import percentiles

pct_of = lambda part, whole, digits=2: F.round(F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0)), digits)


def long_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x): all numbers of some columns under each other, for one aggregate over all of them."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), try_num(F.col(f"`{c}`")).alias("x")) for c in columns])).alias("v")).select("v.*")


def long_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(F.col(f"`{c}`")).alias("value")) for c in columns])).alias("v")).select("v.*")


def missing_values(df: DataFrame, columns: list[str], row_id: str | None = None, sample: int = 20) -> DataFrame:
    """(column, n, missing, pct, severity, score[, first_rows]) in one aggregate.

    The first rows come from a running minimum per partition, so no list of all missing rows is ever gathered.
    """
    out = long_texts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("missing"))
    out = out.withColumn("pct", pct_of(F.col("missing"), F.col("n"))).withColumn("severity", missing_severity(F.col("pct"))).withColumn("score", severity_score(F.col("pct")))
    if row_id:
        gone = df.select(F.col(row_id).alias("r"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").isNull().alias("gone")) for c in columns])).alias("v")).filter("v.gone").select("v.column", "r")
        first = gone.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("r"))).filter(F.col("k") <= sample)
        out = out.join(first.groupBy("column").agg(F.sort_array(F.collect_list("r")).alias("first_rows")), "column", "left")
    return out


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, non_null, missing_pct, n_unique, kind): Numeric if more than half of the values are numbers."""
    out = long_texts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("non_null"), F.count_distinct("value").alias("n_unique"), F.count_if(try_num(F.col("value")).isNotNull()).alias("numbers"))
    return out.select("column", "n", "non_null", pct_of(F.col("n") - F.col("non_null"), F.col("n")).alias("missing_pct"), "n_unique", F.when(F.col("numbers") > 0.5 * F.col("non_null"), "Numeric").otherwise("Text").alias("kind"))


def quality_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """Before cleaning: nulls, distinct values, numbers' range and mean, severity per column."""
    num = try_num(F.col("value"))
    out = long_texts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("non_null"), F.count_distinct("value").alias("n_unique"), F.count(num).alias("numbers"), F.min(num).alias("lo"), F.max(num).alias("hi"), F.avg(num).alias("mean"))
    numeric = (F.col("non_null") > 0) & (F.col("numbers") > 0.8 * F.col("non_null"))
    null_pct = pct_of(F.col("n") - F.col("non_null"), F.col("n"))
    only = lambda c: F.when(numeric, F.col(c))
    return out.select("column", "n", "non_null", null_pct.alias("null_pct"), "n_unique", numeric.alias("is_numeric"), only("lo").alias("min"), only("hi").alias("max"), F.round(only("mean"), 4).alias("mean"),
                      F.when(null_pct >= 50, "critical").when(null_pct >= 10, "warning").otherwise("ok").alias("severity"))


def completeness_pct(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_texts(df, columns).agg(pct_of(F.count("value"), F.count(F.lit(1))).alias("completeness"))


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """(column, place, value, n): the k most frequent values, ties by value."""
    counts = long_texts(df, columns).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def categorical_summary(df: DataFrame, columns: list[str], blank: str = "TIADA DATA") -> DataFrame:
    """(column, value, n, pct); a missing value is a value of its own."""
    counts = long_texts(df, columns).groupBy("column", F.coalesce("value", F.lit(blank)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", pct_of(F.col("n"), F.sum("n").over(Window.partitionBy("column"))))


def numerical_summary(df: DataFrame, columns: list[str], bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Moments, quantiles, outlier counts and box-plot whiskers per column.

    Skewness and kurtosis are the bias-corrected sample ones. The smallest of equally frequent modes is given. Quantiles are
    selected before, as exact ones that need no buffer of all values.
    """
    x = long_numbers(df, columns).filter("x IS NOT NULL")
    modes = x.groupBy("column", "x").agg(F.count(F.lit(1)).alias("c")).groupBy("column").agg(F.min_by("x", F.struct(-F.col("c"), F.col("x"))).alias("mode"))
    p = quantile_table(df, columns, (0.05, 0.25, 0.5, 0.75, 0.95))
    base = x.groupBy("column").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2")).join(p, "column")
    n = F.col("n").cast("double")
    base = base.select(
        "column", "n", "min", "max", (F.col("max") - F.col("min")).alias("range"), "mean", "std", *[F.col("p")[i].alias(a) for i, a in enumerate(("p5", "q1", "median", "q3", "p95"))],
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
    ).withColumn("iqr", F.col("q3") - F.col("q1")).join(modes, "column")
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    far = (F.col("x") < F.col("q1") - 3 * F.col("iqr")) | (F.col("x") > F.col("q3") + 3 * F.col("iqr"))
    bio = F.lit(False)
    for c, (a, b) in (bounds or {}).items():
        bio = bio | ((F.col("column") == c) & ~F.col("x").between(a, b))
    # The per-column statistics are one row per named column.
    second = x.join(F.broadcast(base.select("column", "q1", "q3", "iqr", "mean", "std")), "column").groupBy("column").agg(
        F.count_if((F.col("x") < lo) | (F.col("x") > hi)).alias("iqr_outliers"), F.count_if(far).alias("extreme_outliers"),
        F.count_if((F.col("std") > 0) & (F.abs(F.col("x") - F.col("mean")) > 3 * F.col("std"))).alias("z_outliers"), F.count_if(bio).alias("bio_outliers"),
        F.min(F.when(F.col("x") >= lo, F.col("x"))).alias("whisker_low"), F.max(F.when(F.col("x") <= hi, F.col("x"))).alias("whisker_high"),
    )
    return base.join(second, "column")


def quantile_table(df: DataFrame, columns: list[str], shares: tuple[float, ...]) -> DataFrame:
    """(column, p): exact quantiles, one row a column that has numbers."""
    held = percentiles(long_numbers(df, columns), shares)
    return F.broadcast(df.sparkSession.createDataFrame([(c, p) for c, (_, p) in held.items()], "column string, p array<double>"))


def outlier_points(df: DataFrame, columns: list[str], most: int = 50) -> DataFrame:
    """(column, place, x): the ``most`` least values beyond 1.5 interquartile ranges, to three digits.

    Places are limited in every task before values of a column come together.
    """
    q = quantile_table(df, columns, (0.25, 0.75)).select("column", F.col("p")[0].alias("q1"), F.col("p")[1].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    far = long_numbers(df, columns).join(q, "column").filter((F.col("x") < F.col("q1") - reach) | (F.col("x") > F.col("q3") + reach))
    placed = far.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy("x")))
    return placed.filter(F.col("place") <= most).select("column", "place", F.round("x", 3).alias("x"))


def fences(df: DataFrame, columns: list[str], reach: float) -> dict[str, tuple[float, float]]:
    """Quartile fences of each column, as numbers for the plan."""
    held = percentiles(long_numbers(df, columns), (0.25, 0.75))
    return {c: (a - reach * (b - a), b + reach * (b - a)) for c, (_, (a, b)) in held.items()}


#: The outlier module's own ranges.
OUTLIER_RANGES = {"weight": (0.5, 80.0), "height": (30.0, 200.0), "bmi": (5.0, 60.0), "age_months": (0.0, 120.0)}


def outlier_masks(df: DataFrame, column: str, bio: tuple[float, float] | None) -> dict[str, Column]:
    """Conditions for one column: biological, iqr, extreme, zscore. A null is never an outlier."""
    x = try_num(F.col(f"`{column}`"))
    numbers = long_numbers(df, [column])
    held, q = percentiles(numbers, (0.25, 0.75)), numbers.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).first()
    none = F.lit(False)
    if not held:
        return dict.fromkeys(("biological", "iqr", "extreme", "zscore"), none)
    a, b = held[column][1]
    off = lambda k: F.coalesce((x < a - k * (b - a)) | (x > b + k * (b - a)), none)
    return {
        "biological": F.coalesce(~x.between(*bio), none) if bio else none, "iqr": off(1.5), "extreme": off(3.0),
        "zscore": F.coalesce(F.abs(x - q["m"]) > 3 * q["s"], none) if q["s"] else none,
    }


def detect_outliers(df: DataFrame, bios: dict[str, tuple[float, float] | None]) -> DataFrame:
    """(column, biological, iqr, extreme, zscore, any_method) counts."""
    aggs, names = [], []
    for c, bio in bios.items():
        masks = outlier_masks(df, c, bio)
        masks["any_method"] = masks["biological"] | masks["iqr"] | masks["zscore"]
        aggs.append(F.struct(F.lit(c).alias("column"), *[F.count_if(m).alias(k) for k, m in masks.items()]).alias(c))
        names.append(c)
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"`{c}`") for c in names])).alias("v")).select("v.*")


def remove_outliers(df: DataFrame, column: str, method: str, bio: tuple[float, float] | None = None) -> DataFrame:
    return df.filter(~outlier_masks(df, column, bio)[method])


def flag_outliers(df: DataFrame, column: str, method: str, bio: tuple[float, float] | None = None) -> DataFrame:
    return df.withColumn(f"{column}_outlier", outlier_masks(df, column, bio)[method])


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) of equal bins from least to greatest, the last one closed; one value makes a bin of width one."""
    x = F.col("x")
    numbers = df.select(try_num(F.col(f"`{column}`")).alias("x")).filter("x IS NOT NULL")
    ends = numbers.agg(F.min("x").alias("a"), F.max("x").alias("b")).withColumn("same", F.col("a") == F.col("b"))
    ends = ends.select(F.when(F.col("same"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("same"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    row = ends.first()
    if row["a"] is None:
        return numbers.select(F.lit(0).alias("bin"), x.alias("lo"), x.alias("hi"), F.lit(0).cast("long").alias("n")).limit(0)
    a, b = row
    width = (b - a) / bins
    return numbers.groupBy(F.least(F.width_bucket(x, F.lit(a), F.lit(b), F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (a + (F.col("bin") - 1) * width).alias("lo"), (a + F.col("bin") * width).alias("hi"), "n")


def scatter_sample(df: DataFrame, x: str, y: str, key: str, n: int = 3000) -> DataFrame:
    """A fixed sample of points with both values, chosen by a hash of the row key."""
    points = df.select(F.col(key), try_num(F.col(x)).alias("x"), try_num(F.col(y)).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return points.orderBy(F.xxhash64(key, F.lit(42)), key).limit(n)


def trend_by_year(df: DataFrame, year: Column, flags: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(year, indicator, cases, assessed, rate): each indicator over the rows that it can be told for."""
    rows = df.select(year.cast("int").alias("year"), F.explode(F.array(*[F.struct(F.lit(k).alias("indicator"), f.cast("boolean").alias("hit"), known.alias("known")) for k, (f, known) in flags.items()])).alias("v")).select("year", "v.*")
    out = rows.filter("year IS NOT NULL").groupBy("year", "indicator").agg(F.count_if(F.col("hit") & F.col("known")).alias("cases"), F.count_if("known").alias("assessed"))
    return out.withColumn("rate", pct_of(F.col("cases"), F.col("assessed")))


def age_distribution(df: DataFrame, months: Column, measured: Column, today: Column) -> DataFrame:
    """One row: range, mean, median and counts of young, older, missing, impossible ages and future dates."""
    m = df.select(months.cast("double").alias("m"), measured.alias("d"))
    held = percentiles(m.select(F.lit("m").alias("column"), F.col("m").alias("x")), (0.5,))
    median = F.lit(held["m"][1][0] if held else None).cast("double")
    return m.agg(F.min("m").alias("min"), F.max("m").alias("max"), F.round(F.avg("m"), 2).alias("mean"), median.alias("median"), F.count_if(F.col("m") < 24).alias("under2"), F.count_if(F.col("m") < 60).alias("under5"),
                 F.count_if(F.col("m") >= 60).alias("over5"), F.count_if(F.col("m").isNull()).alias("missing"), F.count_if(F.col("m") < 0).alias("invalid"), F.count_if(F.col("d") > today).alias("future"))


ID_WORDS, DATE_WORDS = ("id", "ic", "mykid", "passport", "kp"), ("tarikh", "date", "dob")


def column_kinds(df: DataFrame, sample: int = 300) -> dict[str, str]:
    """identifier, date, categorical, numerical or text, by name first and then by a short sample and distinct counts."""
    import re

    named = {c: "identifier" if set(re.split(r"[^a-z]+", c.lower())) & set(ID_WORDS) else "date" if any(w in c.lower() for w in DATE_WORDS) else None for c in df.columns}
    open_ones = [c for c, k in named.items() if k is None]
    if not open_ones:
        return named
    from ..functions.values import parse_date

    few = df.select(*[text(F.col(f"`{c}`")).alias(c) for c in open_ones]).limit(sample)
    share = lambda c, ok: F.coalesce(F.avg(F.when(F.col(f"`{c}`").isNotNull(), ok.cast("int"))), F.lit(0.0))
    heads = few.agg(*[x for c in open_ones for x in (share(c, try_num(F.col(f"`{c}`")).isNotNull()).alias(f"{c}|n"), share(c, parse_date(F.col(f"`{c}`")).isNotNull()).alias(f"{c}|d"))]).first()
    sizes = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"{c}|u") for c in open_ones]).first()
    for c in open_ones:
        u = sizes[f"{c}|u"]
        if heads[f"{c}|n"] > 0.75:
            named[c] = "categorical" if u <= 20 else "numerical"
        elif heads[f"{c}|d"] > 0.7:
            named[c] = "date"
        else:
            named[c] = "categorical" if u <= 30 or (sizes["rows"] > 100 and u < 0.04 * sizes["rows"]) else "text"
    return named
