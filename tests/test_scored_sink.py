"""Scored rows that take little disk."""

import os

from linewright.operators import scoring
from linewright.sinks.corpus import scored_rows_sink
from linewright.sources.records import read_scored_rows
from pyspark.sql import functions as F


def test_scored_rows_are_packed(spark, tmp_path):
    """Ten copies of a text on disk cost little more than one, and no file holds more rows than one task may read."""
    gt = F.concat_ws(" ", *[F.sha2((F.col("id") * k).cast("string"), 256) for k in range(1, 4)])
    rows = spark.range(3000).select(gt.alias("gt")).select(F.explode(F.array(*[F.concat("gt", F.lit(c)) for c in "abcde"])).alias("pred"), "gt")
    scored = scoring.score_rows(rows)
    path = str(tmp_path / "rows")
    scored_rows_sink(scored, path)
    size = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path))
    assert size < 15000 * 2 * 194 / 5
    back = read_scored_rows(spark, path)
    assert back.exceptAll(scored.select(*back.columns)).count() == 0 and back.count() == 15000
