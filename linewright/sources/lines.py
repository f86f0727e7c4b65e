"""Text lines with their place in the file.

Files are read line by line and stay splittable. Within one block of one file `scan_id` grows with the line, whatever
the scan's partitioning, so (file_path, block_start, scan_id) orders the lines of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ("file_path", "block_start", "scan_id")


def plain_path(uri: Column) -> Column:
    """File path without scheme, with percent escapes resolved."""
    escaped = F.regexp_replace(uri, r"\+", "%2B")
    return F.regexp_replace(F.url_decode(escaped), r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)", "")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        "value",
        plain_path(F.col("_metadata.file_path")).alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("scan_id"),
    )


def number_lines(lines: DataFrame, within: str = "file_path") -> DataFrame:
    """Add the 1-based `line_no` within the file, or within all files of a `split`, in order of their names.

    Lines are ranked inside their block (a block is bounded by the scan's split size) and shifted by the number of
    lines in the earlier blocks; only that count, one row per block, is ever windowed over a whole file or split.
    """
    block = Window.partitionBy("file_path", "block_start").orderBy("scan_id")
    earlier = Window.partitionBy(within).orderBy("file_path", "block_start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        lines.groupBy(*dict.fromkeys([within, "file_path", "block_start"]))
        .agg(F.count("*").alias("n"))
        .select("file_path", "block_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    )
    return (
        lines.withColumn("rank", F.row_number().over(block))
        .join(shifts, ["file_path", "block_start"])
        .withColumn("line_no", F.col("rank") + F.col("shift"))
        .drop("rank", "shift")
    )
