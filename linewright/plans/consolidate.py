"""From annotation exports to one clean corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions.text import file_name
from linewright.operators.charset import char_dictionary
from linewright.operators.hygiene import Limits, drop_counts, split_counts, with_reason
from linewright.operators.keep import last_export_wins
from linewright.session import stage
from linewright.sinks.corpus import char_dict_sink, label_sink, report_sink
from linewright.sources.images import image_dims, tidy_path
from linewright.sources.labels import EXPORT_DIR, parse_labels, read_exports
from linewright.sources.lines import LINE_ORDER

READING_ORDER = ["dir_name", "split_ord", *LINE_ORDER]


@dataclass
class Corpus:
    judged: DataFrame  # every parsed label row with `reason`, NULL where accepted
    accepted: DataFrame  # one row per file name


def consolidate(labels: DataFrame, order: list[str], limits: Limits = Limits()) -> Corpus:
    """Filter first, then let the last export win, so an older valid row outlives a newer rejected one.

    `labels` has `file_name`, `text`, `split`, `export_id`, `has_image`, `height` and the columns of `order`.
    """
    judged = with_reason(labels, limits)
    return Corpus(judged, last_export_wins(judged.where("reason is null"), order))


def read_raw_labels(
    spark: SparkSession, raw_dir: str, export_dir: str = EXPORT_DIR, inventory: DataFrame | None = None
) -> DataFrame:
    """Label rows of all exports under a folder, joined to their images by path.

    `inventory` (`path`, `height`) names the images that exist; without it the files under the folder are listed.
    """
    rows = parse_labels(read_exports(spark, raw_dir, export_dir))
    image_path = F.concat(F.regexp_replace("file_path", r"/labels/[^/]*\.txt(?:/[^/]*)?$", "/"), "rel_path")
    images = image_dims(spark, raw_dir) if inventory is None else inventory.withColumn("path", tidy_path(F.col("path")))
    dims = images.groupBy("path").agg(F.max("height").alias("height"), F.lit(True).alias("has_image"))
    return (
        rows.withColumns({"path": tidy_path(image_path), "file_name": file_name(F.col("rel_path"))})
        .join(dims, "path", "left")
        .withColumn("has_image", F.coalesce("has_image", F.lit(False)))
    )


def report(corpus: Corpus, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row: exports, corpus size, split counts, dictionary size, limits and drop counts."""
    # one pass over the accepted rows; there are as many splits as label files of an export
    splits = split_counts(corpus.accepted).agg(
        F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("splits"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")
    ).select(F.struct("splits", "total"))
    drops = drop_counts(corpus.judged).agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))))
    exports = labels.agg(F.array_sort(F.collect_set("export_id")))
    chars = char_dictionary(corpus.accepted).agg(F.count("*"))
    base = corpus.judged.sparkSession.range(1)
    return base.select(
        F.lit("consolidate").alias("stage"),
        exports.scalar().alias("export_ids"),
        splits.scalar()["total"].alias("unique_images_total"),
        splits.scalar()["splits"].alias("split_counts"),
        chars.scalar().alias("char_dict_size"),
        F.struct(
            F.lit(limits.hygiene).alias("enabled"),
            F.lit(limits.min_len).alias("min_label_len"),
            F.lit(limits.max_len).alias("max_label_len"),
            F.lit(limits.max_height).alias("max_image_height"),
            F.lit(limits.strict_charset).alias("strict_charset"),
            drops.scalar().alias("drop_counts"),
        ).alias("hygiene"),
    )


def run(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    report_path: str,
    limits: Limits = Limits(),
    export_dir: str = EXPORT_DIR,
    inventory: DataFrame | None = None,
) -> None:
    """Consolidate a folder of exports: label files, dictionary and report.

    Judged and accepted rows are written once and read back, so the outputs do not scan the exports again each.
    """
    judged = stage(with_reason(read_raw_labels(spark, raw_dir, export_dir, inventory), limits), "judged")
    corpus = Corpus(judged, stage(last_export_wins(judged.where("reason is null"), READING_ORDER), "accepted"))
    label_sink(corpus.accepted, out_dir)
    char_dict_sink(char_dictionary(corpus.accepted), f"{out_dir.rstrip('/')}/dictionary")
    report_sink(report(corpus, judged, limits), report_path)
