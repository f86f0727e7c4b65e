"""Repeated (prediction, reference) pairs combined, with little to shuffle.

A reference stands in the pairs of all recognisers, and predictions are nearly the same text. So pairs are combined some
batches at a time first, become one row per reference with the list of its predictions, where one that equals the reference
is left out, and travel in compressed lots. They are sorted and combined again where all rows of a reference have met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a reference below which its predictions are dealt to several tasks: blank lines may have very many.
SHORT = 16
_PARTS = 1024
#: Lots that references are dealt to, and bytes of pairs that a task combines and packs at once, about.
LOTS = 512
AT_ONCE = 64 << 20


def _combined(rows: pa.Table, keys: list[str], counts: list[tuple]) -> pa.Table:
    return rows.group_by(keys, use_threads=False).aggregate(counts).rename_columns([*keys, "_n"])


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= AT_ONCE:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per lot the references with lists of their distinct rows and of how many there are of each, compressed."""
    zstd = pa.Codec("zstd", compression_level=3)
    for rows in _collected(batches):
        rows = _combined(rows, rows.column_names, [([], "count_all")])
        same = pc.fill_null(pc.equal(rows["pred"], rows["gt"]), False)
        left = pa.array(np.arange(len(same)), mask=same.to_numpy())
        rows = rows.set_column(rows.schema.get_field_index("pred"), "pred", rows["pred"].take(left)).append_column("_same", same)
        keys = ["_lot", "gt", "_part"]
        listed = [c for c in rows.column_names if c not in keys]
        nested = rows.group_by(keys, use_threads=False).aggregate([(c, "list") for c in listed]).rename_columns([*keys, *listed])
        nested = nested.take(pc.sort_indices(nested["_lot"])).combine_chunks()
        lots, nested = nested["_lot"].to_numpy(), nested.drop_columns("_lot")
        cuts = [0, *(np.flatnonzero(np.diff(lots)) + 1).tolist(), len(lots)]
        for start, end in zip(cuts, cuts[1:]):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, nested.schema) as stream:
                stream.write_table(nested.slice(start, end - start))
            plain = out.getvalue()
            columns = [pa.array([int(lots[start])], pa.int32()), pa.array([plain.size], pa.int64()), pa.array([zstd.compress(plain, asbytes=True)])]
            yield pa.RecordBatch.from_arrays(columns, names=["_lot", "size", "packed"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for size, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            yield from pa.ipc.open_stream(pa.decompress(packed, size, "zstd"))


def whole_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct rows of packed batches sorted by reference and part; those of the last one of a batch wait for the next."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [c for c in batch.schema.names if c not in ("gt", "_part")]
        parent = pc.list_parent_indices(batch.column(batch.schema.get_field_index(names[0])))
        flat = {c: batch.column(batch.schema.get_field_index(c)).flatten() for c in names}
        flat |= {c: batch.column(batch.schema.get_field_index(c)).take(parent) for c in ("gt", "_part")}
        same, place = flat.pop("_same").to_numpy(zero_copy_only=False), np.arange(len(parent))
        flat["pred"] = pa.concat_arrays([flat["pred"], flat["gt"]]).take(pa.array(place + np.where(same, len(place), 0)))
        rows = pa.table(flat)
        rows = rows if waiting is None else pa.concat_tables([waiting.select(rows.column_names), rows])
        rows = _combined(rows, [c for c in rows.column_names if c != "_n"], [("_n", "sum")])
        end = {c: batch.column(batch.schema.get_field_index(c))[batch.num_rows - 1] for c in ("gt", "_part")}
        last = None
        for c, value in end.items():
            here = pc.is_null(rows[c]) if not value.is_valid else pc.fill_null(pc.equal(rows[c], value), False)
            last = here if last is None else pc.and_(last, here)
        waiting = rows.filter(last)
        yield from rows.filter(pc.invert(last)).drop_columns("_part").combine_chunks().to_batches()
    if waiting is not None:
        yield from waiting.drop_columns("_part").combine_chunks().to_batches()


def pair_counts(rows: DataFrame, name: str) -> DataFrame:
    """Each distinct row once, with the number of rows as `name`. Columns: `pred`, `gt` and any others of plain types."""
    order = rows.columns
    rows = rows.select(*(c for c in order if c != "gt"), "gt")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    part = F.when(F.length("gt") >= SHORT, F.lit(0)).otherwise(F.pmod(F.hash("pred"), F.lit(_PARTS)))
    dealt = rows.withColumn("_part", part).withColumn("_lot", F.pmod(F.hash("gt", "_part"), F.lit(LOTS)))
    near = dealt.mapInArrow(partial_counts, "_lot int, size long, packed binary").repartition("_lot")
    listed = {c: kind for c, kind in kinds.items() if c != "gt"} | {"_n": T.LongType(), "_same": T.BooleanType()}
    nested = T.StructType([T.StructField("gt", kinds["gt"]), T.StructField("_part", T.IntegerType())])
    for c, kind in listed.items():
        nested = nested.add(c, T.ArrayType(kind))
    whole = T.StructType([T.StructField(c, kind) for c, kind in kinds.items()] + [T.StructField("_n", T.LongType())])
    counted = near.mapInArrow(unpacked, nested).sortWithinPartitions("gt", "_part").mapInArrow(whole_counts, whole)
    return counted.select(*order, F.col("_n").alias(name))
