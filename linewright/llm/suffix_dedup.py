"""Passages of `LENGTH` words or more that stand in several documents, by sparse suffix arrays.

1. Of all suffixes of a text (at word starts), those are retained whose first `SEED` words have the smallest hash among
   the neighbouring `LENGTH - SEED + 1`. The choice depends on the words alone, so copies of a passage retain the same
   places, and every passage of LENGTH words holds one that has SEED words to its right inside the passage.
2. The retained suffixes are sorted by these words (by their hash: the order of words does not matter, only that equal
   ones meet) and neighbours compared. Those that stand in one document only are dropped, which is nearly all text.
3. Around each that is left, matches are extended left and right: all windows of LENGTH words that hold its SEED words are
   sorted and compared the same way. A word belongs to a repeated passage if one of its windows stands in two documents,
   so the union of these windows is the longest extension of every match, whichever documents share it and how far.

Sorting is by range partitions over (key, id, place): a passage in a third of all documents is spread over many tasks, and
equal keys that lie on both sides of a border are settled by a table of the borders, two keys for each partition. No group
is gathered and no pairs are made. Hashes have 64 bits.

Defined results: a null text, or one of fewer than LENGTH words, has no passage; rows without an id are left out, as they
cannot be named; rows repeated with one id are one document, so they do not repeat each other; repeats inside one document
only do not count; equal keys are in the order of id and place; an empty table gives an empty result; columns besides
doc_id and text are left out, whatever their names. Very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm import words
from linewright.llm.registry import query
from linewright.llm.shared import staged

LENGTH, SEED = 50, 25
#: Positions that are sent to all tasks, at most; above it, the join shuffles.
MOST_SENT = 100_000

KEYED = "key long, doc_id long, pos int"


def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and the hashes of all words."""
    counts, flat = words.split(batch.column(1), lower=False)
    codes, distinct = words.coded(flat)
    return counts, words.hashes(distinct)[codes]


MULTIPLIER = 0x9E3779B97F4A7C15


def window_hashes(keys: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n keys: differences of running sums of keys times powers, modulo 2^64."""
    if len(keys) < n:
        return np.empty(0, np.uint64)
    down = np.full(len(keys), pow(MULTIPLIER, -1, 1 << 64), np.uint64)
    up = np.full(len(keys), MULTIPLIER, np.uint64)
    down[0] = up[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(keys * np.cumprod(down))])
    return words.mixed((sums[n:] - sums[:-n]) * np.cumprod(up)[: len(keys) - n + 1])


def retained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest hash of some run of `width` neighbours (of all of them if there are fewer)."""
    if not len(hashes):
        return np.empty(0, np.int64)
    width = min(width, len(hashes))
    least = np.lib.stride_tricks.sliding_window_view(hashes, width).min(axis=1)
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(np.lib.stride_tricks.sliding_window_view(around, width).max(axis=1) == hashes)


def keyed_rows(length: int, seed: int, around: bool):
    """mapInArrow function: doc_id, text -> KEYED.

    The retained suffixes, or, with a third column `places` of those to look at, all windows that hold them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", words.SLICE_BYTES // 2):
            counts, keys = keys_of(batch)
            ends = np.cumsum(counts)
            places = batch.column(2).to_pylist() if around else None
            found, at, many = [], [], []
            for k, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
                place = np.empty(0, np.int64)
                if b - a >= length:
                    if around:
                        starts = (np.unique(places[k])[:, None] - np.arange(length - seed + 1)[None, :]).ravel()
                        place = np.unique(starts[(starts >= 0) & (starts <= b - a - length)])
                        found.append(window_hashes(keys[a:b], length)[place])
                    else:
                        hashes = window_hashes(keys[a:b], seed)
                        place = retained(hashes, length - seed + 1)
                        found.append(hashes[place])
                    at.append(place)
                many.append(len(place))
            if found:
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), many)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(ids, pa.int64()), pa.array(np.concatenate(at), pa.int32())], names=["key", "doc_id", "pos"])

    return run


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function on rows sorted by key, doc_id, pos: KEYED -> key, doc_id, pos, state.

    state 1: the key stands in several documents. state 2: it stands in one document here, but at a border of the
    partition. state 3: the lowest and highest id of a key at a border (no place of its own).
    """

    def out(keys, ids, places, state: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(np.full(len(keys), state), pa.int32())], names=["key", "doc_id", "pos", "state"])

    open_run = None  # key, lowest id, highest id, waiting rows (while there is one id), whether it is the partition's first
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids, places = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        ends = np.concatenate([starts[1:], [len(keys)]])
        several = ids[starts] != ids[ends - 1]
        first = 0
        if open_run is not None and open_run[0] != keys[0]:
            yield from closed(open_run, out, False)
            is_first = False
        elif open_run is not None:
            # the open run goes on: its rows are settled or wait with those of this batch
            key, low, _, waiting, is_first = open_run
            high, many = ids[ends[0] - 1], ends[0]
            if low != high:
                for w_ids, w_places in waiting:
                    yield out(np.full(len(w_ids), key), w_ids, w_places, 1)
                yield out(keys[:many], ids[:many], places[:many], 1)
                waiting = []
            else:
                waiting = [*waiting, (ids[:many], places[:many])]
            open_run = (key, low, high, waiting, is_first)
            if len(starts) == 1:
                continue
            yield from closed(open_run, out, False)
            first, is_first = 1, False
        else:
            is_first = True
        last = len(starts) - 1
        inner = np.arange(len(starts))
        done = several & (inner >= first)
        rows = np.repeat(done, ends - starts)
        if rows.any():
            yield out(keys[rows], ids[rows], places[rows], 1)
        if is_first and last > first:
            a, b = starts[first], ends[first]
            yield from closed((keys[a], ids[a], ids[b - 1], [] if several[first] else [(ids[a:b], places[a:b])], True), out, False)
            is_first = False
        a, b = starts[last], ends[last]
        open_run = (keys[a], ids[a], ids[b - 1], [] if several[last] else [(ids[a:b], places[a:b])], is_first)
    if open_run is not None:
        yield from closed(open_run, out, True)


def closed(run: tuple, out, is_last: bool) -> Iterator[pa.RecordBatch]:
    """Rows for a run that has ended: only at a border of the partition is anything left to say."""
    key, low, high, waiting, is_first = run
    if is_first or is_last:
        yield out([key, key], [low, high], [-1, -1], 3)
        for ids, places in waiting:
            yield out(np.full(len(ids), key), ids, places, 2)


def in_several_documents(rows: DataFrame, name: str) -> DataFrame:
    """doc_id, pos of the rows (KEYED) whose key stands in several documents, as a written table."""
    ordered = rows.repartitionByRange("key", "doc_id", "pos").sortWithinPartitions("key", "doc_id", "pos")
    compared = staged(ordered.mapInArrow(neighbours, KEYED + ", state int"), name)
    # two keys for each partition, whatever the rows
    borders = compared.where("state = 3").groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("key")
    return compared.where("state = 1").select("doc_id", "pos").unionByName(compared.where("state = 2").join(borders, "key", "left_semi").select("doc_id", "pos"))


def repeated_passages(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, start, n_words: the longest runs of words of a document that lie in repeated passages."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    suffixes = staged(docs.mapInArrow(keyed_rows(length, seed, False), KEYED), "suffixes")
    shared = in_several_documents(suffixes, "shared-suffixes")
    places = staged(shared.groupBy("doc_id").agg(F.array_distinct(F.collect_list("pos")).alias("places")), "places")
    small = (places.agg(F.sum(F.size("places"))).first()[0] or 0) <= MOST_SENT
    looked_at = docs.join(F.broadcast(places) if small else places, "doc_id")
    windows = staged(looked_at.select("doc_id", "text", "places").mapInArrow(keyed_rows(length, seed, True), KEYED), "windows")
    repeated = in_several_documents(windows, "shared-windows")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts = np.unique(starts)
                cuts = np.flatnonzero(np.diff(starts) > length) + 1
                for part in np.split(starts, cuts):
                    rows.append((doc_id, int(part[0]), int(part[-1] - part[0]) + length))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_words"])

    return repeated.groupBy("doc_id").agg(F.collect_list("pos").alias("starts")).mapInArrow(spans, "doc_id long, start long, n_words long")


def passage_texts(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The passages with their text: its words with one blank between them. Joins the documents by id."""
    parts = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    joined = passages.join(docs.select("doc_id", "text"), "doc_id")
    return joined.select("doc_id", "start", "n_words", F.array_join(F.slice(parts, F.col("start").cast("int") + 1, F.col("n_words").cast("int")), " ").alias("passage"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf_dir):
    """Word ranges of every document that stand in another document as well."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
