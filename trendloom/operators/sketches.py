"""Mergeable summaries: distinct counts and quantiles of any span of hours from one summary an hour.

A summary has a bounded size, whatever it has seen, and summaries of parts merge to that of the whole. So a table of hours,
appended to as rows come, answers every lookback without reading the rows again. The exact forms (narratives.author_counts,
reports.distribution, exact_lookback) stay for reports; these hold for windows that move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Binary logarithm of a distinct-count sketch's slots: a standard error of 1.04 / sqrt(4096), 1.6 %; exact for small sets.
SLOTS = 12
#: k of a quantile sketch: ranks are off by 1.33 % at most, with a probability of 99 % for each.
QUANTILE_K, RANK_ERROR = 200, 0.0133


def hourly(rows: DataFrame, by: list[str], ts: str, value: str, member: str) -> DataFrame:
    """(by, hour, n, members, values): a row an hour with sketches of who came and of the values seen; nulls aren't counted."""
    return rows.groupBy(*by, F.date_trunc("hour", ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(member, SLOTS).alias("members"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_K)).alias("values"))


def lookback(hours: DataFrame, by: list[str], span: int = 24) -> DataFrame:
    """(by, hour, n, members, values) where each hour's sketches are those of the span of hours that end with it."""
    at = F.unix_seconds(F.col("hour").cast("timestamp"))
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-(span - 1) * 3600, 0)
    return hours.select(*by, "hour", F.sum("n").over(w).alias("n"), F.hll_union_agg("members").over(w).alias("members"), F.kll_merge_agg_double("values").over(w).alias("values"))


def exact_lookback(rows: DataFrame, by: list[str], ts: str, member: str, span: int = 24) -> DataFrame:
    """(by, hour, n, distinct): what lookback estimates, exactly: rows and distinct members of the span of hours up to each hour.

    A member counts from an hour it came in until span hours later, or until it comes again if that is sooner. So it is one
    more in the first and one less in the second hour, and the running sum of these is the distinct count: each row is read
    once, and a window over hours holds a row an hour. Rows without a time are in no hour; null members are rows but no members.
    """
    at = F.floor(F.unix_seconds(F.col("hour").cast("timestamp")) / 3600).alias("_h")
    r = rows.select(*by, F.date_trunc("hour", ts).alias("hour"), F.col(member).alias("_m")).where("hour is not null")
    seen = r.where("_m is not null").select(*by, "_m", at).distinct()
    again = F.lead("_h").over(Window.partitionBy(*by, "_m").orderBy("_h"))
    step = lambda h, d: F.struct(h.alias("_h"), F.lit(d).cast("long").alias("_d"))
    steps = seen.withColumn("_until", F.least(F.col("_h") + span, again)).select(*by, F.inline(F.array(step(F.col("_h"), 1), step(F.col("_until"), -1))))
    hours = r.groupBy(*by, "hour").agg(F.count(F.lit(1)).alias("n")).withColumn("_h", at)
    both = steps.groupBy(*by, "_h").agg(F.sum("_d").alias("_d")).unionByName(hours, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_h")
    out = both.withColumns({"_n": F.sum("n").over(w.rangeBetween(-(span - 1), 0)), "distinct": F.coalesce(F.sum("_d").over(w.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0))})
    return out.where("n is not null").select(*by, "hour", F.col("_n").alias("n"), "distinct")


def merged(hours: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, members, values) over all hours of hours."""
    return hours.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("members").alias("members"), F.kll_merge_agg_double("values").alias("values"))


def estimates(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """sketches with distinct and, for each share, q<percent> in the place of the sketches."""
    cuts = {f"q{round(100 * s)}": F.kll_sketch_get_quantile_double("values", F.lit(float(s))) for s in shares}
    return sketches.withColumns({"distinct": F.hll_sketch_estimate("members"), **cuts}).drop("members", "values")
