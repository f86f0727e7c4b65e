"""From a metrics log to the published table and its best entries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linewright.operators.keep import prefer_split
from linewright.operators.runs import best_per_column, compiled_table, in_display_order, missing_models


def compile_tables(log: DataFrame, order: DataFrame, log_order: list[str]) -> dict[str, DataFrame]:
    """`order` lists the models of one table: `model`, `ord`, `display`."""
    rows = prefer_split(log, log_order)
    ordered = in_display_order(rows, order)
    return {
        "table": compiled_table(ordered),
        "best": best_per_column(ordered),
        "missing": missing_models(order, rows),
    }
