"""Queries on error rates: per row, per model, across models, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import PAIRS, SCORED, labels, pairs, rounded, sql
from linewright.functions.distance import char_errors, word_errors
from linewright.functions.text import round_n
from linewright.operators import predict, runs, scoring
from linewright.operators.scoring import METRICS


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_rows(pairs(spark, sf_dir))


BY = ["model", "split"]


def distinct(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    """Every distinct pair of a group with its number of rows as `weight`."""
    return scoring.distinct_pairs(pairs(spark, sf_dir), by)


def scored_distinct(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    return scoring.score_rows(distinct(spark, sf_dir, by))


@query("i01_cer", sql("select model, line_no, cer from scored", SCORED))
def i01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_char_errors(pairs(spark, sf_dir)).select("model", "line_no", "cer")


@query("i02_wer", sql("select model, line_no, wer from scored", SCORED))
def i02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_word_errors(pairs(spark, sf_dir)).select("model", "line_no", "wer")


@query("i03_der", sql("select model, line_no, der, gt_marks::int as gt_marks, pred_marks::int as pred_marks from scored", SCORED))
def i03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_mark_errors(pairs(spark, sf_dir)).select("model", "line_no", "der", "gt_marks", "pred_marks")


@query(
    "i08_edit_distance",
    sql("select model, sum(char_edits)::bigint as char_edits, sum(word_edits)::bigint as word_edits from scored group by model", SCORED),
)
def i08(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = F.col("pred"), F.col("gt")
    rows = pairs(spark, sf_dir).withColumns({"c": char_errors(p, g), "w": word_errors(p, g)})
    return rows.groupBy("model").agg(F.sum("c.edits").alias("char_edits"), F.sum("w.edits").alias("word_edits"))


_AGGREGATES = f"""
  count(*) as n, {rounded('avg(cer)', 4)} as cer, {rounded('avg(wer)', 4)} as wer,
  case when sum(gt_marks) > 0 then {rounded('sum(mark_edits) filter (gt_marks > 0) / sum(gt_marks)::double', 4)} end as der,
  count(*) filter (gt_marks > 0) as der_n,
  case when sum(gt_chars) filter (gt_marks = 0) > 0 then
    {rounded('sum(pred_marks) filter (gt_marks = 0) / (sum(gt_chars) filter (gt_marks = 0))::double', 4)} end as der_insertion_rate"""


@query(
    "d12_macro_error_rates",
    sql(
        f"""
select model, split, count(*) as n, {rounded('avg(cer)', 4)} as cer, {rounded('avg(wer)', 4)} as wer
from scored group by model, split""",
        SCORED,
    ),
)
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = scoring.with_word_errors(scoring.with_char_errors(distinct(spark, sf_dir, BY)))
    return scoring.macro_rates(both, BY, "weight")


@query("d12_metrics_by_split", sql(f"select model, split, {_AGGREGATES} from scored group by model, split", SCORED))
def d12_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.aggregate_scores(scored_distinct(spark, sf_dir, BY), BY, "weight")


@query("d12_metrics_by_lang", sql(f"select model, lang, {_AGGREGATES} from scored group by model, lang", SCORED))
def d12_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["model", "lang"]
    return scoring.aggregate_scores(scored_distinct(spark, sf_dir, by), by, "weight")


@query(
    "d13_micro_der",
    sql(
        f"""
select model, lang, {rounded('sum(mark_edits) filter (gt_marks > 0) / nullif(sum(gt_marks), 0)::double', 6)} as der
from scored group by model, lang""",
        SCORED,
    ),
)
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["model", "lang"]
    marked = scoring.with_mark_errors(distinct(spark, sf_dir, by))
    return marked.groupBy(*by).agg(round_n(scoring.micro_der("weight"), 6).alias("der"))


@query("d14_der_n", sql("select model, split, count(*) filter (gt_marks > 0) as der_n from scored group by model, split", SCORED))
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = scoring.with_mark_errors(distinct(spark, sf_dir, BY))
    return marked.groupBy(*BY).agg(F.sum(F.when(F.col("gt_marks") > 0, F.col("weight")).otherwise(0)).alias("der_n"))


@query(
    "d15_der_insertion_rate",
    sql(
        f"""
select model, split, {rounded('sum(pred_marks) filter (gt_marks = 0) / nullif(sum(gt_chars) filter (gt_marks = 0), 0)::double', 6)}
  as der_insertion_rate
from scored group by model, split""",
        SCORED,
    ),
)
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = scoring.with_mark_errors(distinct(spark, sf_dir, BY))
    return marked.groupBy(*BY).agg(round_n(scoring.der_insertion_rate("weight"), 6).alias("der_insertion_rate"))


@query(
    "d25_perfect_and_threshold_counts",
    sql(
        """
select model, count(*) filter (cer = 0) as cer_perfect, count(*) filter (cer < 0.1::double) as cer_below,
  count(*) filter (der = 0) as der_perfect
from scored group by model""",
        SCORED,
    ),
)
def d25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.limit_counts(distinct(spark, sf_dir, ["model"]), ["model"], weight="weight")


@query("d26_median_error", sql("select model, median(cer) as cer_median, median(der) as der_median from scored group by model", SCORED))
def d26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.median_errors(scored_distinct(spark, sf_dir, ["model"]), ["model"], "weight")


_BY_MODEL = SCORED + f""",
per_model as (select model, {_AGGREGATES} from scored group by model),
reported as (select * from per_model)"""
_REPORTED = ("spurious", "noisy", "fold", "empty")


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.aggregate_scores(scored_distinct(spark, sf_dir, ["model"]), ["model"], "weight")


@query(
    "d27_relative_reduction",
    sql(
        " union all ".join(
            f"""
select '{m}' as metric, {rounded('(z - x) / nullif(z, 0)', 4)} as vs_zero_shot, {rounded('(b - x) / nullif(b, 0)', 4)} as vs_best_other
from (select max({m}) filter (model = 'fold') as x, max({m}) filter (model = 'spurious') as z,
  min({m}) filter (model <> 'fold') as b from reported)"""
            for m in METRICS
        ),
        _BY_MODEL,
    ),
)
def d27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.relative_reduction(reported(spark, sf_dir), "fold", "spurious")


@query(
    "d28_metric_correlation",
    sql(
        f"""
select {rounded('corr(der, rating)', 4)} as der_r, {rounded('corr(cer, rating)', 4)} as cer_r
from (select der, cer, (line_no * 7 + gt_chars) % 5 + 1 as rating from scored)""",
        SCORED,
    ),
)
def d28(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = scored(spark, sf_dir).withColumn("rating", (F.col("line_no") * 7 + F.length("gt")) % 5 + 1)
    return scoring.metric_correlation(rated, "rating")


@query("d29_macro_der", sql(f"select model, split, {rounded('avg(der)', 4)} as der_macro from scored group by model, split", SCORED))
def d29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.macro_der(scoring.with_mark_errors(distinct(spark, sf_dir, BY)), BY, "weight")


@query(
    "e09_config_cross_pairs",
    sql(
        f"""
select config, count(*) as n, {rounded('avg(cer)', 4)} as cer from (
  select 'eng' as config, levenshtein(translate(replace(text, 'é', 'e'), src, dst), translate(text, src, dst)) / length(text)::double as cer
  from labels, (select 'éóèñçêüäöíÉÈÑÓÇÄÊÜÖÍß' as src, array_to_string([chr(x::int) for x in range(1, 22)], '') as dst)
  union all select 'deu', 0.0 from labels)
group by config"""
    ),
)
def e09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predict.with_configs(labels(spark, sf_dir).select("line_no", F.col("text").alias("gt")), ["eng", "deu", "yor", "eng+yor"], "yor")
    rows = rows.withColumn("pred", F.when(F.col("config") == "eng", F.replace("gt", F.lit("é"), F.lit("e"))).otherwise(F.col("gt")))
    return scoring.macro_rates(scoring.with_char_errors(rows).withColumn("wer", F.lit(0.0)), ["config"]).select("config", "n", "cer")


def _recognise(value: str) -> str:
    if "=" in value or "@" in value:
        raise ValueError("unreadable")
    return value.replace("é", "e").replace("the ", "te ")


@query(
    "k02_batch_predict",
    sql("""
select line_no as id, text as gt, contains(text, '=') or contains(text, '@') as failed,
  case when contains(text, '=') or contains(text, '@') then '' else replace(replace(text, 'é', 'e'), 'the ', 'te ') end as pred
from labels"""),
)
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels(spark, sf_dir).select(F.col("line_no").alias("id"), F.col("text").alias("gt"), F.col("text").alias("image"))
    return predict.batch_predict(rows, _recognise, source="image").select("id", "gt", "pred", "failed")


@query(
    "j02_identity_check",
    sql(
        f"""
select split, {_AGGREGATES}, count(*) filter (cer > 0 or wer > 0 or der > 0) as bad_rows
from scored where model = 'identity' group by split""",
        SCORED,
    ),
)
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.identity_check(labels(spark, sf_dir).withColumnRenamed("text", "gt"), ["split"])


# Stored rates: every 11th row of the log drifted by 0.001 in `cer`, every 13th by less than the tolerance.
def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = scored(spark, sf_dir).select("model", "line_no", "pred", "gt", "cer", "wer", "der")
    return stored.withColumn(
        "cer", F.col("cer") + F.expr("case when line_no % 11 = 0 then 0.001D when line_no % 13 = 0 then 0.0000001D else 0D end")
    )


@query(
    "d22_replay_mismatch_count",
    sql(
        """
select count(*) as n, count(*) filter (line_no % 11 = 0) as cer_mismatches, 0::bigint as wer_mismatches,
  0::bigint as der_mismatches, count(*) filter (line_no % 11 = 0) as mismatches
from pairs""",
        PAIRS,
    ),
)
def d22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.replay_mismatches(_drift(spark, sf_dir))


@query("j03_replay_check", sql("select model, line_no from pairs where line_no % 11 = 0", PAIRS))
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = scoring.replay(_drift(spark, sf_dir))
    off = F.lit(False)
    for m in METRICS:
        off = off | (F.abs(F.col(m) - F.col(f"stored_{m}")) > 1e-6)
    return again.where(off).select("model", "line_no")


# --- comparison tables ----------------------------------------------------------------------------------------

_ORDER = [("spurious", 1, "Spurious marks"), ("noisy", 2, None), ("fold", 3, "Folded accents"), ("absent", 4, "Never run"), ("empty", 5, "Nothing")]
ORDERED = _BY_MODEL + """,
listed as (select * from (values ('spurious', 1, 'Spurious marks'), ('noisy', 2, null), ('fold', 3, 'Folded accents'),
  ('absent', 4, 'Never run'), ('empty', 5, 'Nothing')) as o(model, ord, display)),
ordered as (select r.*, ord, coalesce(display, l.model) as display_name from reported r join listed l on l.model = r.model)"""


def listed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ORDER, "model string, ord int, display string")


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.in_display_order(reported(spark, sf_dir), listed(spark))


@query("e05_display_order_join", sql("select model, ord, display_name, n from ordered", ORDERED))
def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(spark, sf_dir).select("model", "ord", "display_name", "n")


@query("e06_missing_models", sql("select model, ord from listed where model not in (select model from reported)", ORDERED))
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.missing_models(listed(spark), reported(spark, sf_dir))


@query(
    "f04_best_per_column",
    sql(
        " union all ".join(
            f"select * from (select '{m}' as metric, model, {m} as value from ordered where {m} is not null order by {m}, ord limit 1)"
            for m in METRICS
        ),
        ORDERED,
    ),
)
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.best_per_column(ordered(spark, sf_dir))


def _pct(m: str) -> str:
    return f"coalesce(format('{{:.1f}}', {m} * 100), '—') as {m}_pct"


_TABLE = f"select model as model_label, display_name, {_pct('cer')}, {_pct('wer')}, {_pct('der')}, n from ordered"


@query("c12_pct_format", sql(_TABLE, ORDERED))
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.compiled_table(ordered(spark, sf_dir))


@query("g07_best_row", sql(f"select * from ({_TABLE}) order by cast(cer_pct as double) limit 1", ORDERED))
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.best_row(runs.compiled_table(ordered(spark, sf_dir)), "cer_pct")
