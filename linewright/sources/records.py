"""Metrics logs, scored rows and provenance sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.schema import SCORED_ROW, SIDECAR
from linewright.sources.lines import plain_path

_LOG_TYPES = {
    "n": "long",
    "cer": "double",
    "wer": "double",
    "der": "double",
    "der_n": "long",
    "der_insertion_rate": "double",
    "timestamp": "timestamp",
}


def read_metrics_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of a metrics log as strings, whatever its header, with `log_ord` as their order.

    Rows are ordered by their own `timestamp`, where the log has one, then by the number of their append; files that have
    none come before and are ordered by their modification time.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False, escape='"')
    stamp = F.col("timestamp").try_cast("timestamp") if "timestamp" in rows.columns else F.lit(None).cast("timestamp")
    return rows.select(
        "*",
        F.struct(
            stamp.alias("stamped"),
            F.regexp_extract(F.col("_metadata.file_name"), r"^append-(\d+)-\d+\.csv$", 1).try_cast("long").alias("append"),
            F.when(~F.col("_metadata.file_name").startswith("append-"), F.col("_metadata.file_modification_time")).alias("written"),
            plain_path(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("scan_id"),
        ).alias("log_ord"),
    )


def typed_metrics(rows: DataFrame) -> DataFrame:
    """Typed view of a metrics log; blank or unreadable values become NULL."""
    return rows.withColumns({c: F.col(c).try_cast(t) for c, t in _LOG_TYPES.items() if c in rows.columns})


def read_scored_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(SCORED_ROW).json(path)


def read_sidecars(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per sidecar file; an unreadable one has NULL fields and its text in `_corrupt`."""
    schema = SIDECAR.add("_corrupt", "string") if "_corrupt" not in SIDECAR.names else SIDECAR
    return (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
        .withColumn("meta_file", plain_path(F.col("_metadata.file_path")))
    )
