"""Compiling a metrics log into comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions.text import pct


def in_display_order(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Rows of the listed models with `ord` and `display_name`, which falls back to the model's own name.

    `order` is the report's own list: `model`, `ord` and, where given, `display`.
    """
    named = order.select("model", "ord", F.coalesce("display", "model").alias("display_name"))
    return rows.join(named, "model")


def missing_models(order: DataFrame, rows: DataFrame) -> DataFrame:
    """Listed models without a metrics row."""
    return order.select("model", "ord").join(rows.select("model"), "model", "left_anti")


def best_per_column(ordered: DataFrame, metrics: tuple[str, ...] = ("cer", "wer", "der")) -> DataFrame:
    """Per metric the model with the lowest value; blanks do not compete, the earlier of equals wins."""
    values = {m: F.col(m).try_cast("double") for m in metrics}
    best = ordered.agg(
        *[
            F.min_by(
                F.when(v.isNotNull(), F.struct("model", v.alias("value"))),
                F.when(v.isNotNull(), F.struct(v, "ord")),
            ).alias(m)
            for m, v in values.items()
        ]
    )
    wide = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("best")) for m in metrics])).alias("r")
    return best.select(wide).select("r.metric", "r.best.model", "r.best.value")


def compiled_table(ordered: DataFrame) -> DataFrame:
    """The published columns, in display order."""
    return ordered.orderBy("ord").select(
        F.col("model").alias("model_label"),
        "display_name",
        pct(F.col("cer")).alias("cer_pct"),
        pct(F.col("wer")).alias("wer_pct"),
        pct(F.col("der")).alias("der_pct"),
        F.col("n"),
    )


def compiled_csv(ordered: DataFrame, path: str, alias: str | None = None) -> None:
    """Write the published table (one row per listed model, so one file), and a copy under a second name."""
    table = compiled_table(ordered).coalesce(1)
    for target in [path] + ([alias] if alias else []):
        table.write.mode("overwrite").csv(target, header=True)


def best_row(table: DataFrame, column: str) -> DataFrame:
    """The row with the lowest value of a column."""
    value = F.col(column).try_cast("double")
    return table.agg(F.min_by(F.struct(*table.columns), value).alias("r")).select("r.*")


def phantom_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.lower("phantom") == "true")


def phantom_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.lower("phantom") == "true").alias("n_phantom"))
