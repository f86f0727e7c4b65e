"""Running a recogniser over label rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions.workers import kept_per_worker
from linewright.sources.stores import content

Source = str | bytes
Recogniser = Callable[[Source], str | None] | Callable[[list[Source]], Sequence[str | None]]

#: Rows that a batched recogniser gets at once, and files that are held at once.
BATCH = 64


def batch_predict(
    rows: DataFrame,
    recognise: Recogniser | None = None,
    source: str = "path",
    batched: bool = False,
    factory: Callable[[], Recogniser] | None = None,
    read: bool = False,
    resources: ResourceProfile | None = None,
    batch: int = BATCH,
) -> DataFrame:
    """Apply a recogniser to one column and keep the reference text; a row it fails on gets "" and `failed`.

    The recogniser is given, or made by `factory` once per Python worker (a model is loaded there, not pickled and not
    loaded per task; if that fails, so does the job). It gets the value of the source column: text or, from a binary
    column, bytes. With `read` the column holds addresses of files and the recogniser gets their bytes, read in the task
    that uses them, `batch` files at a time; a file that cannot be read is a failure.

    A `batched` recogniser takes a list of up to `batch` sources and returns as many answers. Only if it fails on a batch,
    or returns another number, are the rows of that batch given to it one by one. An answer of None is a failure.

    `resources` asks for executors with, say, a GPU per task. `rows` has `id`, `gt`, the source column and any columns to
    carry along.
    """
    if (recognise is None) == (factory is None):
        raise ValueError("give a recogniser or a factory of one")
    carried = [c for c in rows.columns if c not in ("pred", "failed")]
    name = uuid.uuid4().hex

    def settled(answer: str | None) -> tuple[str, bool]:
        return ("", True) if answer is None else (answer, False)

    def attempt(own: Recogniser, value: Source | None) -> tuple[str, bool]:
        try:
            return settled(own([value])[0] if batched else own(value))
        except Exception:
            return "", True

    def attempt_all(own: Recogniser, values: list[Source]) -> list[tuple[str, bool]]:
        if batched and values:
            try:
                answers = own(values)
                if len(answers) == len(values):
                    return [settled(a) for a in answers]
            except Exception:
                pass
        return [attempt(own, v) for v in values]

    def attempt_files(own: Recogniser, uris: list[str | None]) -> list[tuple[str, bool]]:
        values = [None if uri is None else content(uri) for uri in uris]
        answers = iter(attempt_all(own, [v for v in values if v is not None]))
        return [("", True) if v is None else next(answers) for v in values]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = recognise if factory is None else kept_per_worker("recogniser", name, factory)
        for frame in frames:
            values = frame[source].tolist()
            answers = []
            for start in range(0, len(values), batch):
                answers += (attempt_files if read else attempt_all)(own, values[start : start + batch])
            yield frame.assign(pred=[a[0] for a in answers], failed=[a[1] for a in answers])

    schema = rows.select(*carried, F.lit("").alias("pred"), F.lit(False).alias("failed")).schema
    return rows.select(*carried).mapInPandas(run, schema, profile=resources)


def failure_counts(predicted: DataFrame, by: list[str]) -> DataFrame:
    return predicted.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))


def with_configs(rows: DataFrame, configs: list[str], unavailable: str | None = None) -> DataFrame:
    """Every row once per configuration; configurations that name an unavailable pack are left out first.

    The configurations are a short literal list, so rows are multiplied in place and nothing is joined.
    """
    usable = [c for c in configs if not unavailable or unavailable not in c]
    return rows.withColumn("config", F.explode(F.array(*[F.lit(c) for c in usable])))
