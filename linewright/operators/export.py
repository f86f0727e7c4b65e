"""Chat sample export: records, skipped lines, manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.functions.text import forward_slashes, portable_path, sample_id
from linewright.sinks.corpus import chat_record


def with_skip_reason(lines: DataFrame) -> DataFrame:
    """`lines` has `rel_path`, `text` (NULL where the line has no tab) and `has_image`."""
    reason = F.when(F.col("text").isNull(), "not_two_tab_fields").when(~F.col("has_image"), "missing_image")
    return lines.withColumn("reason", reason)


def chat_samples(lines: DataFrame, data_dir: str, repo_root: str, prompt: str) -> DataFrame:
    """One chat record per usable line."""
    usable = with_skip_reason(lines).where("reason is null")
    image = portable_path(F.concat(F.lit(data_dir.rstrip("/") + "/"), "rel_path"), repo_root)
    return usable.select(
        "split",
        "line_no",
        sample_id(F.col("rel_path")).alias("id"),
        forward_slashes(F.col("rel_path")).alias("source_relative"),
        image.alias("source_image"),
        F.col("text").alias("gt"),
        chat_record(F.col("rel_path"), image, F.col("text"), prompt).alias("record"),
    )


def skipped_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not exported, with the reason; the path where one could be read."""
    path = F.when(F.col("reason") == "missing_image", F.col("rel_path"))
    return with_skip_reason(lines).where("reason is not null").select(
        "split", F.col("line_no").alias("line"), "reason", path.alias("path")
    )


FAN_IN = 4096
LEVELS = 5  # 4096 ** 5 is above every line number
#: A limit that `export_manifest` may be given for the flat digest.
FLAT = 100_000

_SPLIT, _IDS, _ROWS = 0, 3, 6  # columns of the chunks


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of a sorted batch, joined per split; a chunk has its first and last place, and is NULL without ids."""
    for batch in batches:
        splits, ids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        cuts = [0, *(k for k in range(1, len(splits)) if splits[k] != splits[k - 1]), len(splits)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            some = [i for i in ids[start:end] if i is not None]
            first, last = ([c.slice(k, 1) for c in batch.columns] for k in (start, end - 1))
            text = pa.array(["\n".join(some) if some else None], pa.string())
            rows = pa.array([end - start], pa.int64())
            names = ["split", "line_no", "id", "ids", "last_no", "last_id", "rows"]
            yield pa.RecordBatch.from_arrays([*first, text, *last[1:], rows], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each split from its chunks in order; what is held is one batch of chunks and the state of one hash."""
    split, rows, digest, kind = None, 0, None, None

    def done() -> pa.RecordBatch:
        columns = [pa.array([split], kind), pa.array([digest.hexdigest()], pa.string()), pa.array([rows], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["split", "ids_sha256", "rows"])

    for batch in batches:
        kind = batch.column(_SPLIT).type
        for here, text, n in zip(*(batch.column(k).to_pylist() for k in (_SPLIT, _IDS, _ROWS))):
            if digest is None or here != split:
                if digest is not None:
                    yield done()
                split, rows, begun, digest = here, 0, False, hashlib.sha256()
            rows += n
            if text is not None:
                digest.update(("\n" + text if begun else text).encode())
                begun = True
    if digest is not None:
        yield done()


def ids_digest(ids: DataFrame, most: int | None = None) -> DataFrame:
    """`ids_sha256` per split: SHA-256 of the newline-joined ids in line order, for splits of any size.

    All tasks sort the ids and join those of a batch to one chunk. The hash itself can only be computed from the first id to
    the last, so one task per split goes through the split's chunks, a few at a time. With `most`, splits of more ids get NULL.
    """
    key = ["split", "line_no", "id"]
    rows = ids.select("split", "line_no", F.col("id").cast("string").alias("id"))
    of = {c: rows.schema[c].dataType for c in key}
    kinds = {**of, "ids": T.StringType(), "last_no": of["line_no"], "last_id": of["id"], "rows": T.LongType()}
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    chunks = ordered.mapInArrow(_joined, T.StructType([T.StructField(c, kind) for c, kind in kinds.items()]))
    # equal places may fill a whole chunk, so its last one counts as well
    dealt = chunks.repartition("split").sortWithinPartitions(*key, "last_no", "last_id")
    results = {"split": of["split"], "ids_sha256": T.StringType(), "rows": T.LongType()}
    hashed = dealt.mapInArrow(_digests, T.StructType([T.StructField(c, kind) for c, kind in results.items()]))
    value = F.col("ids_sha256") if most is None else F.when(F.col("rows") <= most, F.col("ids_sha256"))
    return hashed.select("split", value.alias("ids_sha256"))


def ids_tree_digest(ids: DataFrame, name: str = "ids_tree_sha256") -> DataFrame:
    """An order-sensitive digest of the ids of each split, by a tree that no task sees more than `FAN_IN` children of.

    SHA-256 of the newline-joined ids of each run of FAN_IN line numbers, then of the digests of each FAN_IN runs, and so
    on. `line_no` is unique within a split; gaps in the numbers leave runs out and gather nothing more in the others.
    """
    level = ids.select("split", F.col("line_no").alias("no"), F.col("id").alias("part"))
    for _ in range(LEVELS):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", "part"))), lambda x: x["part"])
        run = F.expr(f"no div {FAN_IN}").alias("run")
        level = level.groupBy("split", run).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("part")).withColumnRenamed("run", "no")
    return level.select("split", F.col("part").alias(name))


def export_manifest(lines: DataFrame, samples: DataFrame, most: int | None = None) -> DataFrame:
    """Per split: exported samples, skipped lines by reason, both id digests. The skipped lines themselves are a table."""
    counted = with_skip_reason(lines).groupBy("split").agg(
        F.count_if(F.col("reason").isNull()).alias("exported"),
        F.count_if(F.col("reason") == "not_two_tab_fields").alias("skipped_malformed"),
        F.count_if(F.col("reason") == "missing_image").alias("skipped_missing_image"),
    )
    nothing = F.when(F.col("exported") == 0, F.sha2(F.lit("").cast("binary"), 256))
    digests = {name: F.coalesce(name, nothing) for name in ("ids_sha256", "ids_tree_sha256")}
    return counted.join(ids_digest(samples, most), "split", "left").join(ids_tree_digest(samples), "split", "left").withColumns(digests)
