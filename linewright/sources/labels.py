"""Annotation exports, label files, character dictionaries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.constants import SPLITS
from linewright.functions.text import strip
from linewright.functions.unicode import nfc
from linewright.sources.lines import read_lines

# An export folder is a name followed by `_<digits>` and anything else, e.g. `batch_00017 (copy)`.
EXPORT_DIR = r"[A-Za-z]+(?:_[A-Za-z]+)*_(\d+)[^/]*"


def export_fields(path: Column, export_dir: str = EXPORT_DIR) -> dict[str, Column]:
    """`dir_name`, `export_id` and `split` of a label file path `<dir>/labels/<split>.txt`."""
    layout = rf"(?:^|/)({export_dir})/labels/({'|'.join(SPLITS)})\.txt(?:/[^/]*)?$"
    return {
        "dir_name": F.nullif(F.regexp_extract(path, layout, 1), F.lit("")),
        "export_id": F.regexp_extract(path, layout, 2).try_cast("long"),
        "split": F.nullif(F.regexp_extract(path, layout, 3), F.lit("")),
    }


def split_rank(split: Column) -> Column:
    """Order in which the splits of one export are read."""
    return F.array_position(F.array(*[F.lit(s) for s in SPLITS]), split)


def export_scan(label_paths: DataFrame, export_dir: str = EXPORT_DIR) -> DataFrame:
    """Export folders among label file paths, ascending by id; folders of one id stay apart."""
    return (
        label_paths.withColumns(export_fields(F.col("path"), export_dir))
        .where("export_id is not null")
        .select("export_id", "dir_name")
        .distinct()
        .orderBy("export_id", "dir_name")
    )


def read_exports(spark: SparkSession, raw_dir: str, export_dir: str = EXPORT_DIR) -> DataFrame:
    """Lines of every label file of every export under a folder, with export, split and place in the file."""
    lines = read_lines(spark, f"{raw_dir.rstrip('/')}/*/labels/*.txt")
    return (
        lines.withColumns(export_fields(F.col("file_path"), export_dir))
        .where("export_id is not null")
        .withColumn("split_ord", split_rank(F.col("split")))
    )


def read_split_lines(spark: SparkSession, data_dir: str, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Lines of a consolidated set: `labels/<split>.txt` files, or the `split=` folders the label sink writes."""
    # only the files and folders of these splits are listed and read
    wanted = ",".join(f"split={s},{s}.txt" for s in splits)
    lines = read_lines(spark, f"{data_dir.rstrip('/')}/labels/{{{wanted}}}")
    found = F.regexp_extract("file_path", rf"/labels/(?:split=)?({'|'.join(SPLITS)})(?:\.txt)?(?:/[^/]*)?$", 1)
    return lines.withColumn("split", found).where(F.col("split").isin(*splits))


def line_parts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Split all lines, empty ones included, at the first tab."""
    return lines.withColumn("parts", F.split(F.col(value), "\t", 2))


def label_parts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Split non-empty lines at the first tab."""
    return line_parts(lines.where(F.col(value) != ""), value)


def parse_labels(lines: DataFrame, value: str = "value") -> DataFrame:
    """`rel_path` and composed `text` of the well-formed lines."""
    return (
        label_parts(lines, value)
        .where(F.size("parts") == 2)
        .withColumns({"rel_path": F.col("parts")[0], "text": nfc(F.col("parts")[1])})
        .drop("parts", value)
    )


def malformed_labels(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines `parse_labels` leaves out, cut for display."""
    return (
        label_parts(lines, value)
        .where(F.size("parts") != 2)
        .withColumn("excerpt", F.substring(value, 1, 80))
        .drop("parts", value)
    )


def label_count(lines: DataFrame, value: str = "value") -> DataFrame:
    """Number of non-blank lines."""
    return lines.agg(F.count_if(strip(F.col(value)) != "").alias("n"))


def label_count_or_default(spark: SparkSession, path: str, default: int = 500) -> DataFrame:
    """Number of non-blank lines of a label file, or a default where there is no such file."""
    try:
        return label_count(spark.read.text(path))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(1).select(F.lit(default).cast("long").alias("n"))


def read_char_dict(spark: SparkSession, path: str) -> DataFrame:
    """Distinct entries of a character dictionary; a line holding one space is an entry, an empty line is not."""
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("ch")).distinct()
