"""A quality classifier made of sparse rules over text statistics.

1. Statistics of every text, by column expressions, written once to the shared folder.
2. A forest of shallow trees on a bounded sample of labelled rows; every path from a root is a conjunctive rule such as
   `share_symbols > 0.1 AND n_words <= 900`.
3. A logistic regression with lasso penalty over all distinct rules; most weights become zero.
4. The remaining rules, compiled into one column expression that scores all rows inside the JVM.

Trees and lasso see a sample (`SAMPLE` labelled rows of each class at most, those with the lowest hash of their id), written
to the shared folder and read from there; with fewer labelled rows all are used. Labels are never inputs of a score; nor are language, source or id. As the sample is not
drawn at the classes' own shares, the intercept is corrected for these.

Defined results: a null or empty text has zero statistics and is scored like any other; null labels are left out of
training, repeated labels count each; without labelled rows of both classes, or without any rule, the score is the share of
label 1 (0.5 without labels); a null id counts as the empty text in `held_out`; repeated rows are scored each; an empty
table gives an empty result; columns besides doc_id and text are left out, whatever their names. Texts are measured whole.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm import trees
from linewright.llm.quality_rules import measures
from linewright.llm.registry import query
from linewright.llm.shared import SPACES, fold_of, staged

SAMPLE = 8_000
PENALTY = 0.001

STATISTICS = ("log_words", "word_length", "distinct_words", "symbols", "repeated", "dup_lines", "line_words", "upper", "digits", "exclamations", "bars", "stops", "endings")


def statistics(text: Column) -> Column:
    """Struct of STATISTICS (doubles) of a text."""
    text = F.coalesce(text, F.lit(""))
    distinct = F.size(F.array_distinct(F.filter(F.split(text, SPACES), lambda w: w != "")))

    def fields(m: Column) -> Column:
        words = F.greatest(m["n_words"], F.lit(1))
        chars = F.greatest(m["word_chars"], F.lit(1))

        def rate(pattern: str, of: Column) -> Column:
            return F.regexp_count(text, F.lit(pattern)) / of

        found = {
            "log_words": F.log1p(m["n_words"]),
            "word_length": m["word_chars"] / words,
            "distinct_words": distinct / words,
            "symbols": m["n_symbols"] / words,
            "repeated": m["n_repeat_words"] / words,
            "dup_lines": m["lines"]["dup"] / F.greatest(m["lines"]["n"], F.lit(1)),
            "line_words": m["n_words"] / F.greatest(m["lines"]["n"], F.lit(1)),
            "upper": rate("[A-Z]", chars),
            "digits": rate("[0-9]", chars),
            "exclamations": rate("!", words),
            "bars": rate(r"\|", words),
            "stops": rate(r"[.?](?=\s|$)", words),
            "endings": rate(r"[,;:](?=\s|$)", words),
        }
        return F.struct(*(found[name].cast("double").alias(name) for name in STATISTICS))

    return F.transform(F.array(measures(text)), fields)[0]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    #: Path (tuple of feature, is_above, threshold) -> weight.
    rules: dict[tuple, float] = field(default_factory=dict)

    def score(self, values: list[Column]) -> Column:
        total = F.lit(self.intercept)
        for path, weight in self.rules.items():
            total = total + F.when(holds(path, values), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(path: tuple, values: list[Column]) -> Column:
    condition = F.lit(True)
    for feature, is_above, threshold in path:
        condition = condition & (values[feature] > threshold if is_above else values[feature] <= threshold)
    return condition


def sample_of(rows: DataFrame, label: str, most: int, key: str = "doc_id") -> DataFrame:
    """At most so many rows of each class, those with the lowest hash of the key."""
    ordered = [F.xxhash64(key), *sorted(rows.columns)]
    own = [rows.where(F.col(label) == value).orderBy(*ordered).limit(most) for value in (0, 1)]
    return own[0].unionByName(own[1])


def marks(rules: list[tuple], values: list[Column]) -> Column:
    """array<double>: 1 for each rule that holds, else 0.

    The rules share few conditions. These are evaluated once, and the rules are lists of their places in one literal, so the
    expression does not grow with the number of rules.
    """
    conditions = {c: k for k, c in enumerate(dict.fromkeys(c for path in rules for c in path))}
    held = F.array(*(holds((c,), values) for c in conditions))
    places = F.from_json(F.lit(json.dumps([[conditions[c] for c in path] for path in rules])), "array<array<int>>")
    return F.transform(F.array(held), lambda h: F.transform(places, lambda r: F.forall(r, lambda k: F.get(h, k)).cast("double")))[0]


def fit(rows: DataFrame, seed: int = 11) -> RuleModel:
    """rows: doc_id, label, STATISTICS, one row per labelled document. The sample is trained from files; none of it is gathered."""
    totals = {r.label: r.n for r in rows.where("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return RuleModel(30.0 if n1 else -30.0 if n0 else 0.0)
    sample = staged(sample_of(rows.select("doc_id", "label", *STATISTICS), "label", SAMPLE).withColumn("label", F.col("label").cast("double")), "quality-sample")
    shift = math.log(n1 / n0) - math.log(min(n1, SAMPLE) / min(n0, SAMPLE))
    values = [F.col(n) for n in STATISTICS]
    forest = RandomForestClassifier(numTrees=24, maxDepth=3, seed=seed, featuresCol="x", featureSubsetStrategy="onethird").fit(sample.select("label", array_to_vector(F.array(*STATISTICS)).alias("x")))
    rules = list(dict.fromkeys(path for tree in trees.forest(forest) for path in trees.paths(tree)))
    if not rules:
        return RuleModel(math.log(n1 / n0))
    marked = staged(sample.select("label", marks(rules, values).alias("marks")), "quality-marks")
    lasso = LogisticRegression(maxIter=60, regParam=PENALTY, elasticNetParam=1.0, standardization=False, featuresCol="x").fit(marked.select("label", array_to_vector("marks").alias("x")))
    weights = {path: float(w) for path, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-9}
    return RuleModel(float(lasso.intercept) + shift, weights)


def classified(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, least: float) -> DataFrame:
    """docs: doc_id, text; labels: doc_id and a label. Returns doc_id, held_out, score, predicted; labels of the held-out fold are not used."""
    measured = docs.select("doc_id", statistics(F.col("text")).alias("s")).select("doc_id", "s.*")
    measured = staged(measured.withColumn("held_out", fold_of(F.col("doc_id"), folds) == held_out), "statistics")
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label IS NOT NULL")
    model = fit(measured.where("NOT held_out").join(known, "doc_id"))
    return measured.select("doc_id", "held_out", model.score([F.col(n) for n in STATISTICS]).alias("score")).withColumn("predicted", (F.col("score") >= least).cast("int"))


@query("op5_quality_classifier")
def op5_quality_classifier(spark, sf_dir):
    """Quality score of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classified(docs, labels, "quality", 5, 0, 0.3)
