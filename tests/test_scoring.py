import pytest
from pyspark.sql import functions as F

from linewright.operators import scoring

# Rows as they were stored by an evaluation run, with their rates.
STORED = [
    ("  í.", "Àkíyèsí: Kí olùkọ́ darí àwọn akẹ́kọ̀ọ́ láti kọ àwọn orin náà léraléra.", 0.9428571428571428, 1.0, 0.96),
    ("    í.", "Iṣẹ́ Ṣíṣe", 0.7777777777777778, 1.0, 0.8333333333333334),
    ("  í.", "Dáhùn àwọn ìbéèrè wọ̀nyí ní ìbámu pẹ̀lú ẹ̀kọ́ yìí.", 0.92, 1.0, 0.9565217391304348),
]
SCHEMA = "pred string, gt string, cer double, wer double, der double"


def test_stored_rows_replay(spark):
    stored = spark.createDataFrame(STORED, SCHEMA)
    assert scoring.replay_mismatches(stored).first().asDict() == {
        "n": 3, "cer_mismatches": 0, "wer_mismatches": 0, "der_mismatches": 0, "mismatches": 0
    }
    scoring.require_replay(stored)
    with pytest.raises(ValueError, match="1 metric"):
        scoring.require_replay(stored.withColumn("cer", F.when(F.col("cer") > 0.94, 0.5).otherwise(F.col("cer"))))
    with pytest.raises(ValueError, match="no rows"):
        scoring.require_replay(stored.limit(0))


def test_aggregates(spark):
    rows = [("m", "e", "é"), ("m", "á b", "a b"), ("m", "ab", "ab"), ("m", "x", "")]
    scored = scoring.score_rows(spark.createDataFrame(rows, "model string, pred string, gt string"))
    got = scoring.aggregate_scores(scored, ["model"]).first()
    assert (got["n"], got["cer"], got["wer"]) == (4, round((1 + 1 / 3 + 0 + 1) / 4, 4), round((1 + 0.5 + 0 + 1) / 4, 4))
    # Micro rate over the one row with a reference mark; one mark inserted per 5 reference characters elsewhere.
    assert (got["der"], got["der_n"], got["der_insertion_rate"]) == (1.0, 1, 0.2)
    assert scoring.macro_der(scored, ["model"]).first()["der_macro"] == 0.5


def test_no_rows_and_no_marks(spark):
    empty = scoring.score_rows(spark.createDataFrame([], "pred string, gt string"))
    got = scoring.aggregate_scores(empty, []).first()
    assert got["n"] == 0 and got["cer"] is None and got["der"] is None and got["der_insertion_rate"] is None
    plain = scoring.score_rows(spark.createDataFrame([("a", "b")], "pred string, gt string"))
    got = scoring.aggregate_scores(plain, []).first()
    assert got["der"] is None and got["der_n"] == 0 and got["der_insertion_rate"] == 0.0
    marked = scoring.score_rows(spark.createDataFrame([("a", "á")], "pred string, gt string"))
    assert scoring.aggregate_scores(marked, []).first()["der_insertion_rate"] is None


def test_identity(spark):
    labels = spark.createDataFrame([("ẹ̀kọ́",), ("é",), ("",)], "gt string")
    scoring.require_identity(labels)
    with pytest.raises(ValueError):
        scoring.require_identity(labels.limit(0))


def test_relative_reduction_and_median(spark):
    metrics = spark.createDataFrame(
        [("new", 0.9, 1.0, 0.6), ("zero", 1.8, 2.0, 1.2), ("other", 1.2, 0.5, None)],
        "model string, cer double, wer double, der double",
    )
    got = {r["metric"]: (r["vs_zero_shot"], r["vs_best_other"]) for r in scoring.relative_reduction(metrics, "new", "zero").collect()}
    assert got == {"cer": (0.5, 0.25), "wer": (0.5, -1.0), "der": (0.5, 0.5)}
    rates = spark.createDataFrame(
        [("a", 0.1, 0.5), ("a", 0.3, 0.25), ("a", 0.9, 1.0), ("a", 1.7, 1.0), ("b", 0.2, 0.0)], "model string, cer double, der double"
    )
    got = {r["model"]: (r["cer_median"], r["der_median"]) for r in scoring.median_errors(rates, ["model"]).collect()}
    assert got == {"a": (0.6, 0.75), "b": (0.2, 0.0)}
    assert scoring.perfect_counts(rates, []).first().asDict() == {"cer_perfect": 0, "cer_below": 0, "der_perfect": 1}
    rated = rates.withColumn("rating", 1 - F.col("der"))
    assert scoring.metric_correlation(rated, "rating").first()["der_r"] == -1.0
