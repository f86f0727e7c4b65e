"""Keep-one operators. Each filters on `row_number`, so Spark drops losers before the shuffle and a hot key stays small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def last_export_wins(accepted: DataFrame, order: list[str], key: str = "file_name") -> DataFrame:
    """Per file name the row of the highest export; among equals the first in reading order."""
    return first_by(accepted, [key], [F.desc("export_id"), *[F.asc(c) for c in order]])


def last_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of a log for each key."""
    return first_by(log, keys, [F.desc(c) for c in order])


def prefer_split(log: DataFrame, order: list[str]) -> DataFrame:
    """One row per model from a log: its last row of test, else val, else train, else of the split seen first."""
    preference = F.when(F.col("split") == "test", 0).when(F.col("split") == "val", 1).when(F.col("split") == "train", 2)
    place = F.struct(*order)
    kept = log.groupBy("model", "split").agg(
        F.min(place).alias("_seen"), F.max_by(F.struct(*log.columns), place).alias("_row")
    )
    ranked = kept.withColumn("_pref", F.coalesce(preference, F.lit(3)))
    chosen = first_by(ranked, ["model"], [F.asc("_pref"), F.asc("_seen")])
    return chosen.select("_row.*")


def latest_for(log: DataFrame, model: str, order: list[str]) -> DataFrame:
    """The last row of one model."""
    return log.where(F.col("model") == model).orderBy(*[F.desc(c) for c in order]).limit(1)


def recent_rows(log: DataFrame, model: str, columns: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The last n rows of one model, in log order, with those of the columns that exist."""
    present = [c for c in columns if c in log.columns]
    tail = log.where(F.col("model") == model).orderBy(*[F.desc(c) for c in order]).limit(n)
    return tail.orderBy(*order).select(*present)
