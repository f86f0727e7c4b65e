"""Label hygiene: first failing check per row, drop accounting, would-drop accounting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.constants import DROP_REASONS, SPLITS
from linewright.functions.text import is_valid_text, offenders, only_whitelisted, preview, too_tall


@dataclass(frozen=True)
class Limits:
    min_len: int = 3
    max_len: int = 100
    max_height: int = 180
    hygiene: bool = True
    strict_charset: bool = True


def reject_reason(text: Column, has_image: Column, height: Column, limits: Limits = Limits()) -> Column:
    """Name of the first failing check, NULL for an accepted row. Text validity holds with hygiene off as well."""
    reason = F.when(~has_image, "missing_image").when(~is_valid_text(text), "invalid_yoruba")
    if limits.hygiene:
        reason = reason.when(F.length(text) < limits.min_len, "label_too_short").when(
            F.length(text) > limits.max_len, "label_too_long"
        )
        if limits.strict_charset:
            reason = reason.when(~only_whitelisted(text), "non_whitelisted_codepoint")
        reason = reason.when(too_tall(height, limits.max_height), "image_too_tall")
    return reason


def with_reason(labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return labels.withColumn("reason", reject_reason(F.col("text"), F.col("has_image"), F.col("height"), limits))


def drop_counts(judged: DataFrame) -> DataFrame:
    """Rows per reason before duplicates are removed; reasons that never occur have 0. One row per reason."""
    counted = judged.agg(*[F.count_if(F.col("reason") == r).alias(r) for r in DROP_REASONS])
    return counted.unpivot([], list(DROP_REASONS), "reason", "n")


def height_unknown(labels: DataFrame) -> DataFrame:
    """Rows kept by the height check only because their image could not be read."""
    return labels.agg(F.count_if(F.col("has_image") & F.col("height").isNull()).alias("height_unknown"))


def split_counts(rows: DataFrame) -> DataFrame:
    """Rows per split, every split listed."""
    counted = rows.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    return counted.unpivot([], list(SPLITS), "split", "n")


def _rules(limits: Limits) -> dict[str, Column]:
    return {
        "label_too_short": F.length("text") < limits.min_len,
        "label_too_long": F.length("text") > limits.max_len,
        "image_too_tall": too_tall(F.col("height"), limits.max_height),
        "non_yoruba_codepoint": ~only_whitelisted(F.col("text")),
    }


def would_drop(labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows per split that each rule would drop on its own; a row may count under several rules."""
    rules = _rules(limits)
    counted = labels.groupBy("split").agg(
        F.count("*").alias("n"), *[F.count_if(cond).alias(rule) for rule, cond in rules.items()]
    )
    return counted.unpivot(["split", "n"], list(rules), "rule", "would_drop")


def audit_totals(labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Would-drop counts per rule over all splits."""
    return would_drop(labels, limits).groupBy("rule").agg(F.sum("would_drop").alias("would_drop"))


EXAMPLES = {"label_too_short": 5, "label_too_long": 5, "image_too_tall": 10, "non_yoruba_codepoint": 20}


def example_rows(labels: DataFrame, order: list[str], limits: Limits = Limits()) -> DataFrame:
    """The first examples per split and rule, in file order: 5 short texts, 5 long texts cut to 80 characters,
    10 heights, 20 texts with their offending characters.

    Each row becomes one row per rule it breaks, so the labels are read once; only the first few per task are shuffled.
    """
    shown = {
        "label_too_short": F.col("text"),
        "label_too_long": preview(F.col("text")),
        "image_too_tall": F.col("height").cast("string"),
        "non_yoruba_codepoint": F.col("text"),
    }
    broken = F.array_compact(
        F.array(
            *[
                F.when(condition, F.struct(F.lit(rule).alias("rule"), shown[rule].alias("shown")))
                for rule, condition in _rules(limits).items()
            ]
        )
    )
    allowed = F.lit(0)
    for rule, n in EXAMPLES.items():
        allowed = F.when(F.col("rule") == rule, n).otherwise(allowed)
    w = Window.partitionBy("rule", "split").orderBy(*order)
    return (
        labels.select("split", *order, F.explode(broken).alias("_b"))
        .select("split", *order, "_b.rule", "_b.shown")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= max(EXAMPLES.values()))
        .where(F.col("rank") <= allowed)
        .withColumn("offenders", F.when(F.col("rule") == "non_yoruba_codepoint", offenders(F.col("shown"))))
        .select("rule", "split", "rank", "shown", "offenders")
    )
