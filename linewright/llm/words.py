"""Words of Arrow text columns as numpy arrays, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are taken apart at once; a single longer text is a slice of its own.
SLICE_BYTES = 6 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches whose texts have at most so many bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def plain(text: pa.Array) -> pa.Array:
    """Texts without nulls, copied so that they start at their buffers' start: `ascii_lower` misreads arrays that do not."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    return text.take(pa.array(np.arange(len(text))))


def split(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and all words in order. Words: runs of anything but ASCII white space; null: none."""
    text = plain(text)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    words = lists.flatten()
    filled = pc.not_equal(words, "")
    ends = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False), dtype=np.int64)])
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return ends[bounds[1:]] - ends[bounds[:-1]], words.filter(filled)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of each word and the distinct words the codes stand for."""
    both = words.dictionary_encode()
    return both.indices.to_numpy(zero_copy_only=False), both.dictionary


def hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(keys: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words, texts one after the other, and how many each text has.

    A text with fewer words, but not none, has one window: its whole sequence.
    """
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    longest = np.repeat(np.minimum(counts, n), many)
    out = longest.astype(np.uint64)
    for i in range(n):
        inside = longest > i
        nxt = mixed(out * np.uint64(0x9E3779B97F4A7C15) + keys[np.minimum(first + i, len(keys) - 1)]) if len(keys) else out
        out = nxt if inside.all() else np.where(inside, nxt, out)
    return out, many
