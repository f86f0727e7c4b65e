"""Repeated pairs combined with little to shuffle."""

import random
from collections import Counter

from linewright.operators import scoring
from linewright.operators.pairs import pair_counts
from pyspark.sql import functions as F

SCHEMA = "cer double, pred string, gt string, model string"


def rows_of(rng, n):
    words = ["", " ", "é", "x", "the line", "a longer line of some words", "another line that is long enough"]
    return [(rng.choice([0.0, 0.5, None]), rng.choice([g := rng.choice([*words, None]), "", g and g + "!", None]), g, rng.choice("mn")) for _ in range(n)]


def test_every_distinct_pair_once(spark):
    """Nulls, blanks, and references whose rows lie in many batches; the columns keep their order."""
    rows = rows_of(random.Random(2), 9000)
    long = [" ".join(f"wörd{k * j % 97}" for j in range(k % 30)) for k in range(4000)]
    rows += [(0.0, p, g, "m") for g in long for p in (g, g.replace("ö", "o"), "", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = [tuple(r) for r in pair_counts(spark.createDataFrame(rows, SCHEMA).repartition(5), "n").collect()]
        none = pair_counts(spark.createDataFrame([], SCHEMA), "n")
        assert none.collect() == [] and none.columns == ["cer", "pred", "gt", "model", "n"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = Counter(rows)
    assert len(got) == len(want) and {r[:-1]: r[-1] for r in got} == dict(want)


def test_references_travel_once(spark):
    """Five recognisers of the same lines: rows are dealt by reference, and packed before."""
    gt = F.concat_ws(" ", *[F.sha2((F.col("id") * k).cast("string"), 256) for k in range(1, 4)])
    pairs = spark.range(1000).select(gt.alias("gt")).select(
        "gt", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("pred")) for m, p in {"a": F.col("gt"), "b": F.replace("gt", F.lit("a"), F.lit("b")), "c": F.lit("")}.items()])).alias("s")
    ).select("s.model", "s.pred", "gt")
    out = scoring.distinct_pairs(pairs, ["model"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("hashpartitioning(_lot") :]
    assert "partial_count" in below and "HashAggregate" not in plan
    assert out.count() == 3000 and out.where("weight <> 1").count() == 0
