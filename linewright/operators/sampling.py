"""Caps and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 5  # hex digits of the sampling order that are counted: at most 1,048,576 counts


def first_rows(rows: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first n rows in file order; 0 or None keeps all."""
    return rows.orderBy(*order).limit(n) if n else rows


def sampling_order(seed: int, key: Column) -> Column:
    """A fixed pseudo-random order of rows: the digest of seed and key."""
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))


def n_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A seeded sample of min(n, rows) rows for review."""
    return rows.orderBy(sampling_order(seed, F.col(key)), key).limit(n)


def fraction_sample(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Exactly max(1, int(rows * fraction)) rows, without replacement, the same ones for the same seed.

    `key` identifies a row. The first k rows of the sampling order are found without sorting the rows: they are counted
    per leading digits of their digest, rows of all prefixes below the one in which k falls are kept, and only the
    rows of that prefix (about one in a million) are ranked.
    """
    placed = rows.withColumn("_place", sampling_order(seed, F.col(key))).withColumn(
        "_prefix", F.substring("_place", 1, PREFIX)
    )
    below = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_prefix").agg(F.count("*").alias("_n")).withColumns(
        {"_below": F.coalesce(F.sum("_n").over(below), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy())}
    )
    wanted = F.greatest(F.lit(1), F.floor(F.col("_all") * F.lit(fraction)))
    left = wanted - F.col("_below")
    cut = counts.where((left > 0) & (left <= F.col("_n"))).select(F.struct("_prefix", left.alias("left"))).scalar()
    whole = placed.where(F.col("_prefix") < cut["_prefix"])
    rank = F.row_number().over(Window.partitionBy("_prefix").orderBy("_place", key))
    edge = placed.where(F.col("_prefix") == cut["_prefix"]).withColumn("_rank", rank).where(F.col("_rank") <= cut["left"])
    return whole.select(*rows.columns).unionByName(edge.select(*rows.columns))


def review_sample(rows: DataFrame, key: str, n: int, seed: int, data_dir: str) -> DataFrame:
    """Sampled label rows with what a reviewer needs: both paths, text and its length."""
    return n_sample(rows, key, n, seed).select(
        F.col("rel_path").alias("relative_path"),
        F.concat(F.lit(data_dir.rstrip("/") + "/"), "rel_path").alias("absolute_path"),
        F.col("text").alias("gt"),
        F.length("text").alias("gt_char_len"),
    )
