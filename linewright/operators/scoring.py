"""Character, word and diacritic error rates per row, per model and across models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions.distance import char_limits, pair_rates
from linewright.functions.text import round_n
from linewright.operators.lengths import exact_median
from linewright.operators.pairs import pair_counts


def with_char_errors(pairs: DataFrame) -> DataFrame:
    """Add `cer` to rows of (`pred`, `gt`)."""
    return _with_rates(pairs, "char")


def with_word_errors(pairs: DataFrame) -> DataFrame:
    """Add `wer` to rows of (`pred`, `gt`)."""
    return _with_rates(pairs, "word")


def with_mark_errors(pairs: DataFrame) -> DataFrame:
    """Add `der` and what its aggregates need: `mark_edits`, `gt_marks`, `pred_marks`."""
    return _with_rates(pairs, "mark")


def score_rows(pairs: DataFrame) -> DataFrame:
    """All three rates per row."""
    return _with_rates(pairs, "char", "word", "mark")


def _with_rates(pairs: DataFrame, *kinds: str) -> DataFrame:
    # a lost prediction is an empty one, and counts
    pairs = pairs.withColumn("pred", F.coalesce("pred", F.lit("")))
    # a column of its own, so that it is computed once
    counted = pairs.withColumn("_rates", pair_rates(F.col("pred"), F.col("gt"), kinds))
    names = counted.schema["_rates"].dataType.names
    return counted.withColumns({m: F.col(f"_rates.{m}") for m in names}).drop("_rates")


def distinct_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Each (`pred`, `gt`) of a group once, with `weight`, the rows that have it.

    Scoring costs the product of two lengths, counting costs their sum: blank lines, headers and boilerplate, which may be
    a third of all rows, are combined before the shuffle and scored once. Give `weight` to the aggregates.
    """
    return pair_counts(pairs.select(*by, F.coalesce("pred", F.lit("")).alias("pred"), "gt"), "weight")


def _rows(weight: str | None, condition: Column | None = None) -> Column:
    """Rows, of those where a condition holds."""
    if weight is None:
        return F.count("*") if condition is None else F.count_if(condition)
    counted = F.col(weight) if condition is None else F.when(condition, F.col(weight))
    return F.coalesce(F.sum(counted), F.lit(0).cast("long"))


def _times(value: Column, weight: str | None) -> Column:
    return value if weight is None else value * F.col(weight)


def _mean(name: str, weight: str | None) -> Column:
    if weight is None:
        return F.avg(name)
    return F.sum(F.col(name) * F.col(weight)) / F.sum(F.when(F.col(name).isNotNull(), F.col(weight)))


def micro_der(weight: str | None = None) -> Column:
    """Mark edits over reference marks, over rows that have reference marks; NULL without any."""
    has = F.col("gt_marks") > 0
    edits, marks = (F.sum(F.when(has, _times(F.col(c), weight))) for c in ("mark_edits", "gt_marks"))
    return edits / F.nullif(marks, F.lit(0))


def der_insertion_rate(weight: str | None = None) -> Column:
    """Marks produced per reference character, over rows without reference marks."""
    none = F.col("gt_marks") == 0
    chars = F.sum(F.when(none, _times(F.length("gt"), weight)))
    return F.coalesce(F.sum(F.when(none, _times(F.col("pred_marks"), weight))), F.lit(0)) / F.nullif(chars, F.lit(0))


def macro_rates(scored: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Rows and mean character and word error rates; every row weighs the same."""
    means = [round_n(_mean(m, weight), 4).alias(m) for m in ("cer", "wer")]
    return scored.groupBy(*by).agg(_rows(weight).alias("n"), *means)


def aggregate_scores(scored: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """One metrics row per group, in one pass; without groups also for no rows at all."""
    return scored.groupBy(*by).agg(*metric_columns(weight))


def metric_columns(weight: str | None = None) -> list[Column]:
    return [
        _rows(weight).alias("n"),
        round_n(_mean("cer", weight), 4).alias("cer"),
        round_n(_mean("wer", weight), 4).alias("wer"),
        round_n(micro_der(weight), 4).alias("der"),
        _rows(weight, F.col("gt_marks") > 0).alias("der_n"),
        round_n(der_insertion_rate(weight), 4).alias("der_insertion_rate"),
    ]


def macro_der(scored: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Mean of the per-row rates. Not the corpus rate `der`, hence its own name."""
    return scored.groupBy(*by).agg(round_n(_mean("der", weight), 4).alias("der_macro"))


def perfect_counts(scored: DataFrame, by: list[str], threshold: float = 0.1) -> DataFrame:
    """Rows without any character error, below a character error threshold, and without any mark error."""
    return scored.groupBy(*by).agg(
        F.count_if(F.col("cer") == 0).alias("cer_perfect"),
        F.count_if(F.col("cer") < threshold).alias("cer_below"),
        F.count_if(F.col("der") == 0).alias("der_perfect"),
    )


def limit_counts(pairs: DataFrame, by: list[str], threshold: float = 0.1, weight: str | None = None) -> DataFrame:
    """The counts of `perfect_counts` from pairs that have not been scored: no distance is followed beyond its limit.

    No mark error means equal marks, which needs no distance at all.
    """
    pairs = pairs.withColumn("pred", F.coalesce("pred", F.lit("")))
    limits = char_limits(F.col("pred"), F.col("gt"), threshold)
    kept = by if weight is None else [*by, weight]
    judged = pairs.select(*kept, limits.alias("_limits"))
    return judged.groupBy(*by).agg(
        _rows(weight, F.col("_limits.perfect")).alias("cer_perfect"),
        _rows(weight, F.col("_limits.below")).alias("cer_below"),
        _rows(weight, F.col("_limits.same_marks")).alias("der_perfect"),
    )


def median_errors(scored: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Median character and mark error rates. Both are ranked in one pass over the rows."""
    each = F.explode(F.create_map(F.lit("cer"), F.col("cer"), F.lit("der"), F.col("der"))).alias("metric", "rate")
    kept = by if weight is None else [*by, weight]
    medians = exact_median(scored.select(*kept, each), [*by, "metric"], F.col("rate"), weight=weight)
    return medians.groupBy(*by).agg(
        F.max(F.when(F.col("metric") == "cer", F.col("median"))).alias("cer_median"),
        F.max(F.when(F.col("metric") == "der", F.col("median"))).alias("der_median"),
    )


METRICS = ("cer", "wer", "der")


def relative_reduction(metrics: DataFrame, tuned: str, zero_shot: str) -> DataFrame:
    """(base - tuned) / base per metric, against the zero-shot system and against the best system that is not tuned.

    `metrics` has one row per model. One pass: each needed value is picked by a conditional aggregate.
    """
    model = F.col("model")

    def picked(name: str) -> list[Column]:
        value = F.col(name)
        return [
            F.max(F.when(model == tuned, value)).alias(f"{name}_new"),
            F.max(F.when(model == zero_shot, value)).alias(f"{name}_zero_shot"),
            F.min(F.when(model != tuned, value)).alias(f"{name}_best_other"),
        ]

    wide = metrics.agg(*[c for m in METRICS for c in picked(m)])
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("metric"),
                    F.col(f"{m}_new").alias("new"),
                    F.col(f"{m}_zero_shot").alias("zero_shot"),
                    F.col(f"{m}_best_other").alias("best_other"),
                )
                for m in METRICS
            ]
        )
    ).alias("r")

    def reduction(base: Column) -> Column:
        return (base - F.col("new")) / F.nullif(base, F.lit(0.0))

    return wide.select(rows).select("r.*").select(
        "metric",
        round_n(reduction(F.col("zero_shot")), 4).alias("vs_zero_shot"),
        round_n(reduction(F.col("best_other")), 4).alias("vs_best_other"),
    )


def metric_correlation(rated: DataFrame, rating: str) -> DataFrame:
    """Pearson correlation of the row rates with a human rating."""
    return rated.agg(
        round_n(F.corr("der", rating), 4).alias("der_r"), round_n(F.corr("cer", rating), 4).alias("cer_r")
    )


def identity_check(labels: DataFrame, by: list[str]) -> DataFrame:
    """Aggregates of the reference texts scored against themselves, and the rows that are not error-free."""
    scored = score_rows(labels.withColumns({"pred": F.col("gt")}))
    bad = (F.col("cer") > 1e-9) | (F.col("wer") > 1e-9) | (F.col("der") > 1e-9)
    return scored.groupBy(*by).agg(*metric_columns(), F.count_if(bad).alias("bad_rows"))


def require_identity(labels: DataFrame) -> None:
    """Raise unless there are rows and all score zero against themselves."""
    scored = score_rows(labels.withColumn("pred", F.col("gt")))
    bad = (F.col("cer") > 1e-9) | (F.col("wer") > 1e-9) | (F.col("der") > 1e-9)
    row = scored.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if row["n"] == 0:
        raise ValueError("identity check: no rows")
    if row["bad"]:
        raise ValueError(f"identity check: {row['bad']} rows differ from themselves")


def replay(stored: DataFrame) -> DataFrame:
    """Stored rates beside recomputed ones."""
    renamed = stored.withColumnsRenamed({m: f"stored_{m}" for m in METRICS})
    return score_rows(renamed)


def replay_mismatches(stored: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Stored rows, and per metric the rows whose stored value is off by more than the tolerance."""
    again = replay(stored)
    off = {m: F.abs(F.col(m) - F.col(f"stored_{m}")) > tolerance for m in METRICS}
    counted = again.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"{m}_mismatches") for m, c in off.items()])
    return counted.withColumn("mismatches", sum((F.col(f"{m}_mismatches") for m in METRICS), F.lit(0)))


def require_replay(stored: DataFrame, tolerance: float = 1e-6) -> None:
    row = replay_mismatches(stored, tolerance).first()
    if row["n"] == 0:
        raise ValueError("replay check: no rows")
    if row["mismatches"]:
        raise ValueError(f"replay check: {row['mismatches']} metric mismatches")
