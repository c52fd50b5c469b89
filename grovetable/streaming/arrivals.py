"""The row-wise cleaning rules on a stream: an extension, since the plan is the same for files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.growth import bmi_of
from ..plans.ranges import cohort, merged
from ..plans.rules import Rule, codes, joined


def flag_arrivals(stream: DataFrame, weight: str, height: str) -> DataFrame:
    """Flag implausible measurements of a batch or streaming frame, without state."""
    p, w, h = cohort("infant"), F.col(weight), F.col(height)
    out = stream.withColumn("BMI", bmi_of(w, h))
    rules = [
        Rule("dropped_measurement_outlier", (w.isNotNull() & ~w.between(*p.weight)) | (h.isNotNull() & ~h.between(*p.height))), Rule("dropped_no_measurement", w.isNull() & h.isNull()),
        Rule("dropped_bmi_outlier", F.col("BMI") > merged()["bmi_max"]["value"]),
    ]
    return out.withColumn("drop_codes", codes(rules)).withColumn("analyzable", F.size("drop_codes") == 0).withColumn("exclude_reason", joined(F.col("drop_codes")))


def arrivals_per_window(stream: DataFrame, at: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, n, mean value) per window of event time, late rows up to the watermark included."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
