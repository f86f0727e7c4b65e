"""Metrics log and provenance sidecars."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.constants import METRICS_COLUMNS
from linewright.functions.text import phantom_flag
from linewright.sources import stores


def align_columns(rows: DataFrame, header: list[str]) -> DataFrame:
    """Rows under an existing header: absent columns become blank, columns the header lacks are left out."""
    return rows.select(
        *[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in header]
    )


#: Names beginning with an underscore are not read as rows of the log.
_HEADER, _NUMBERS = "_header", "_numbers"


def log_header(spark: SparkSession, path: str) -> list[str]:
    """Columns of a log. A log without files gets the full header; whoever settles it first, all writers use the same."""
    while (text := stores.small_text(spark, f"{path}/{_HEADER}")) is None:
        try:
            header = spark.read.csv(path, header=True, escape='"').columns
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            header = list(METRICS_COLUMNS)
        stores.claimed(spark, f"{path}/{_HEADER}", json.dumps(header))
    return json.loads(text)


def next_number(spark: SparkSession, path: str) -> int:
    """A number above those of all appends before, that no other append gets."""
    while True:
        taken = [int(n) for n in stores.names_in(spark, f"{path}/{_NUMBERS}") if n.isdigit()]
        number = max(taken, default=0) + 1
        if stores.claimed(spark, f"{path}/{_NUMBERS}/{number}", ""):
            return number


def metrics_append(rows: DataFrame, path: str) -> int:
    """Append metrics rows to a CSV log and return the number of the append, which orders the log's rows.

    A new log gets the full header; the header of an existing one is kept. Several writers may append at the same time,
    also to a new log. The rows are written aside first, then the append takes its number, and its files get names with it.
    """
    spark = rows.sparkSession
    path = path.rstrip("/")
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    align_columns(rows, log_header(spark, path)).write.csv(aside, header=True, emptyValue="", escape='"')
    number = next_number(spark, path)
    for part, name in enumerate(n for n in stores.names_in(spark, aside) if n.endswith(".csv")):
        stores.moved(spark, f"{aside}/{name}", f"{path}/append-{number:012d}-{part:06d}.csv")
    stores.dropped(spark, aside)
    return number


def with_digest(files: DataFrame) -> DataFrame:
    """Content digest of files read with `binaryFile`."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def sidecar_rows(metrics: DataFrame, provenance: DataFrame, digests: DataFrame) -> DataFrame:
    """One sidecar per (model, split): metrics, phantom flag, artifact paths and digests, provenance.

    `provenance` has `model`, `split` and the struct `provenance`; `digests` has `path`, `sha256` and `lines`.
    """

    def artifact(alias: str) -> DataFrame:
        return digests.select(
            F.col("path").alias(f"{alias}_path"), F.col("sha256").alias(f"{alias}_sha256"), F.col("lines").alias(f"{alias}_lines")
        )

    integrity = F.col("provenance.checkpoint_integrity")
    prefix = F.coalesce(integrity["ckpt_prefix"], F.col("provenance.ckpt_prefix"))
    rows = (
        metrics.join(provenance, ["model", "split"])
        .withColumn("ckpt", F.concat(prefix, F.lit(".pdparams")))
        .withColumn("phantom", provenance_flag(F.col("provenance")))
    )
    rows = (
        rows.join(artifact("ckpt"), F.col("ckpt") == F.col("ckpt_path"), "left")
        .join(artifact("dict"), F.col("provenance.dict_path") == F.col("dict_path"), "left")
        .join(artifact("config"), F.col("provenance.rec_config") == F.col("config_path"), "left")
    )
    return rows.select(
        "model",
        "split",
        "phantom",
        F.struct("n", "cer", "wer", "der", "der_n", "der_insertion_rate").alias("metrics"),
        F.struct(
            F.col("ckpt").alias("checkpoint_pdparams"),
            F.col("ckpt_sha256").alias("checkpoint_sha256"),
            F.col("provenance.dict_path").alias("dict_path"),
            F.col("dict_sha256"),
            F.col("dict_lines").alias("dict_size"),
            F.col("provenance.rec_config").alias("rec_config"),
            F.col("config_sha256").alias("rec_config_sha256"),
        ).alias("artifacts"),
        "provenance",
    )


def provenance_flag(provenance: Column) -> Column:
    integrity = provenance["checkpoint_integrity"]
    return phantom_flag(
        provenance.isNotNull(),
        provenance["model_kind"],
        integrity.isNotNull(),
        F.try_element_at(integrity["missing_by_component"], F.lit("head")),
        F.try_element_at(integrity["shape_mismatch_by_component"], F.lit("head")),
    )


def provenance_sink(sidecars: DataFrame, path: str) -> None:
    """Sidecars as JSON, one folder per (model, split). Only the folders of the runs given are replaced."""
    runs = sidecars.withColumn("run", F.concat_ws("_", "model", "split"))
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)
