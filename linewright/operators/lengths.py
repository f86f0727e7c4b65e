"""Exact ranks, quantiles and histograms.

Rows are first counted per distinct value, which partial aggregation does before any shuffle. Ranks then come from a
running sum over distinct values, never over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.text import round_n


def value_counts(rows: DataFrame, by: list[str], value: Column, weight: str | None = None) -> DataFrame:
    """Rows per distinct value; with `weight`, a column of how many rows a row stands for."""
    times = F.lit(1).cast("long") if weight is None else F.col(weight)
    counted = rows.select(*by, value.alias("value"), times.alias("n")).where("value is not null")
    return counted.groupBy(*by, "value").agg(F.sum("n").alias("n"))


def with_ranks(counts: DataFrame, by: list[str]) -> DataFrame:
    """Add `upto`, the rows of the group up to and with this value, and `total`."""
    return counts.withColumns(
        {
            "upto": F.sum("n").over(Window.partitionBy(*by).orderBy("value")),
            "total": F.sum("n").over(Window.partitionBy(*by)),
        }
    )


def at_rank(rank: Column) -> Column:
    """Value at a 0-based rank of the sorted rows: the smallest value that reaches beyond the rank."""
    return F.min(F.when(F.col("upto") > rank, F.col("value")))


def length_stats(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Count, min, max, mean, upper median and 95th percentile (`sorted[n//2]`, `sorted[int(0.95 n)]`)."""
    total = F.col("total")
    return with_ranks(value_counts(rows, by, value), by).groupBy(*by).agg(
        F.sum("n").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        round_n(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 2).alias("mean"),
        at_rank(F.floor(total / 2)).alias("median"),
        at_rank(F.floor(total * F.lit(0.95))).alias("p95"),
    )


def quantile_profile(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Min, true median, 90th, 95th and 99th percentile (`sorted[int(q (n-1))]`) and max, as doubles."""
    total = F.col("total")

    def at_fraction(q: float) -> Column:
        return at_rank(F.floor((total - 1) * F.lit(q))).cast("double")

    middle = (at_rank(F.floor((total - 1) / 2)) + at_rank(F.floor(total / 2))) / F.lit(2.0)
    return with_ranks(value_counts(rows, by, value), by).groupBy(*by).agg(
        F.min("value").cast("double").alias("min"),
        middle.alias("p50"),
        at_fraction(0.90).alias("p90"),
        at_fraction(0.95).alias("p95"),
        at_fraction(0.99).alias("p99"),
        F.max("value").cast("double").alias("max"),
    )


def length_histogram(rows: DataFrame, by: list[str], value: Column, bins: int = 30) -> DataFrame:
    """Rows per equal-width bin between the group's smallest and largest value; the last bin is closed."""
    w = Window.partitionBy(*by)
    low, high = F.col("low"), F.col("high")
    spread = value_counts(rows, by, value).withColumns({"low": F.min("value").over(w), "high": F.max("value").over(w)})
    place = F.least(F.width_bucket("value", low.cast("double"), high.cast("double"), F.lit(bins)), F.lit(bins))
    return spread.groupBy(*by, F.coalesce(place, F.lit(1)).alias("bin")).agg(F.sum("n").alias("n"))


def exact_median(rows: DataFrame, by: list[str], value: Column, grain: float = 1000.0, weight: str | None = None) -> DataFrame:
    """True median of a fractional value.

    Distinct fractions can be as many as rows, so the middle is found in two steps: a running sum over coarse steps of
    1/grain, then ranks among the distinct values of only the steps that hold the middle.
    """
    # The filter is what the join below implies for its left side; stated here, both sides share one exchange.
    step = F.floor(F.col("value") * grain)
    counts = value_counts(rows, by, value, weight).where(step.isNotNull()).withColumn("step", step)
    steps = with_ranks(
        counts.groupBy(*by, "step").agg(F.sum("n").alias("n")).withColumnRenamed("step", "value"), by
    ).withColumn("before", F.col("upto") - F.col("n"))
    lower, upper = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = steps.where((F.col("upto") > lower) & (F.col("before") <= upper)).select(
        *by, F.col("value").alias("step"), "before", "total"
    )
    inside = Window.partitionBy(*by, "step").orderBy("value")
    ranked = counts.join(middle, [*by, "step"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    return ranked.groupBy(*by).agg(((at_rank(lower) + at_rank(upper)) / F.lit(2.0)).alias("median"))


def zero_filled(profile: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """A profile with a row of zeros for every group that had no values."""
    return groups.select(*by).distinct().join(profile, by, "left").fillna(0.0)
