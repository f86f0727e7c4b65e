"""From label rows and a recogniser to a metrics row, stored rows and a sidecar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions.text import utc_timestamp
from linewright.operators.predict import Recogniser, batch_predict
from linewright.operators.scoring import aggregate_scores, score_rows
from linewright.session import stage
from linewright.sinks.corpus import scored_rows_sink
from linewright.sinks.runs import metrics_append, provenance_flag, provenance_sink, sidecar_rows


def evaluate(rows: DataFrame, recognise: Recogniser | None = None, source: str = "path", **how) -> DataFrame:
    """Scored rows of one recogniser; `how` are further arguments of `batch_predict`."""
    return score_rows(batch_predict(rows, recognise, source, **how))


def record(
    scored: DataFrame,
    model: str,
    split: str,
    rows_path: str,
    log_path: str,
    provenance: DataFrame | None = None,
    meta_dir: str | None = None,
    digests: DataFrame | None = None,
) -> DataFrame:
    """Store scored rows, write the sidecar and append the metrics row. The rows are written first and the rest taken from them.

    `provenance` is one row with the struct `provenance`, as `schema.SIDECAR` has it; with it, `meta_dir` is the folder that
    the sidecar goes to and that the metrics row names. `digests` (`path`, `sha256`, `lines`) are those of the artifacts.
    """
    if provenance is not None and meta_dir is None:
        raise ValueError("a run with provenance needs a folder for its sidecar")
    kept = scored.select("pred", "gt", "cer", "wer", "der", "mark_edits", "gt_marks", "pred_marks")
    stored = stage(kept, "scored")
    scored_rows_sink(stored, rows_path)
    flag = provenance.select(provenance_flag(F.col("provenance"))).scalar() if provenance is not None else None
    metrics = aggregate_scores(stored, []).select(
        F.lit(model).alias("model"),
        F.lit(split).alias("split"),
        "n",
        "cer",
        "wer",
        "der",
        "der_n",
        "der_insertion_rate",
        (F.coalesce(flag, F.lit("unknown")) if flag is not None else F.lit("unknown")).alias("phantom"),
        F.lit(f"{meta_dir.rstrip('/')}/run={model}_{split}" if provenance is not None else "").alias("meta_path"),
        utc_timestamp().alias("timestamp"),
    )
    metrics = stage(metrics, "metrics")
    if provenance is not None:
        if digests is None:
            digests = stored.sparkSession.createDataFrame([], "path string, sha256 string, lines long")
        named = provenance.select(F.lit(model).alias("model"), F.lit(split).alias("split"), "provenance")
        provenance_sink(sidecar_rows(metrics.drop("phantom"), named, digests), meta_dir)
    metrics_append(metrics, log_path)
    return metrics
