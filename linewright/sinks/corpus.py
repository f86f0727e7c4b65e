"""Label files, dictionaries and chat samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions.text import forward_slashes, sample_id


def label_sink(accepted: DataFrame, data_dir: str) -> None:
    """Write `images/<split>/<file_name><TAB><text>` under `labels/split=<split>`, ordered by file name.

    Rows are range-partitioned, so the files of a split are in order one after the other.
    """
    line = F.concat(F.lit("images/"), "split", F.lit("/"), "file_name", F.lit("\t"), "text")
    (
        accepted.repartitionByRange("split", "file_name")
        .sortWithinPartitions("split", "file_name")
        .select("split", line.alias("value"))
        .write.mode("overwrite")
        .partitionBy("split")
        .text(f"{data_dir.rstrip('/')}/labels")
    )


def char_dict_sink(chars: DataFrame, path: str) -> None:
    """One character per line, in code point order. At most one row per assigned code point, so one file holds it."""
    chars.select(F.col("ch").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)


#: Scored rows of one file, which one task reads.
ROWS_A_FILE = 500_000


def scored_rows_sink(scored: DataFrame, path: str) -> None:
    """Scored rows as JSON lines in files packed by gzip: a reference and its prediction are nearly the same text."""
    rows = scored.select("pred", "gt", "cer", "wer", "der").write.mode("overwrite")
    rows.option("maxRecordsPerFile", ROWS_A_FILE).json(path, compression="gzip")


def report_sink(report: DataFrame, path: str) -> None:
    """A report frame (a few rows of counts and parameters) with the time of writing."""
    report.withColumn(
        "timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    ).write.mode("overwrite").json(path)


def chat_record(rel_path: Column, image: Column, text: Column, prompt: str) -> Column:
    """One chat sample as JSON. The user turn holds a list of parts, the assistant turn a plain string."""
    user = F.to_json(
        F.struct(
            F.lit("user").alias("role"),
            F.array(
                F.struct(F.lit("image").alias("type"), image.alias("image"), F.lit(None).cast("string").alias("text")),
                F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), F.lit(prompt).alias("text")),
            ).alias("content"),
        )
    )
    assistant = F.to_json(F.struct(F.lit("assistant").alias("role"), text.alias("content")))
    head = F.to_json(
        F.struct(
            sample_id(rel_path).alias("id"),
            forward_slashes(rel_path).alias("source_relative"),
            image.alias("source_image"),
        )
    )
    return F.concat(
        F.regexp_replace(head, r"\}\z", ""), F.lit(',"messages":['), user, F.lit(","), assistant, F.lit("]}")
    )


def chat_sink(samples: DataFrame, out_dir: str) -> None:
    """Write chat samples (`split`, `line_no`, `record`) as JSON lines per split, in line order."""
    (
        samples.repartitionByRange("split", "line_no")
        .sortWithinPartitions("split", "line_no")
        .select("split", F.col("record").alias("value"))
        .write.mode("overwrite")
        .partitionBy("split")
        .text(out_dir)
    )
