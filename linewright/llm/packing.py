"""Packing of tokenised documents into training sequences of bounded length by the sum-of-squares rule.

A document is its token ids and one closing id. Only documents longer than a sequence are cut. Each piece is placed so
that the sum over all gaps g of (open sequences with g free places) squared becomes smallest: it goes into an open
sequence or begins one, whichever leaves the gaps most evenly spread, so that later pieces find a gap that fits. Ties go
to the smallest gap left. At the end, open sequences that fit into one another are merged, fullest first.

The rule looks at all gaps of one set of sequences, so the pieces are dealt by hash into lots of about `LOT` pieces; lots
are packed independently. A lot ends with few open sequences (at most one is less than half full), against thousands of
full ones, so the loss stays the same share at any size. Only ids, lengths and checksums of pieces are shuffled; texts and
token ids stay in the task that read them.

Tokenisation: white space never lies within a token of the vocabulary used, so each white-space separated part is encoded
by itself, once per distinct part and slice, with a bounded cache per task.

Defined results: a null text is an empty one, and an empty one has only the closing id; repeated rows and null ids are
packed like any others; an empty table gives an empty result; a very long text becomes many pieces, which may lie in
different lots; columns besides doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm import words
from linewright.llm.registry import query

LENGTH = 4096
END_ID = 1
#: Pieces packed together, about.
LOT = 16384
#: Distinct parts whose ids a task keeps.
CACHED = 300_000

PIECES = "doc_id bigint, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class Encoder:
    """Token ids of white-space separated parts of texts."""

    #: A run of letters, then a run of signs, is two words of the vocabulary's own splitting rule.
    PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?|#$%&*\"()]*)")

    def __init__(self, path: str) -> None:
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        self.bytes = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Ids of one word of the splitting rule, as 32-bit numbers."""
        ids = self.known.get(word)
        if ids is None:
            mapped = word if word.isascii() else self.bytes.pre_tokenize_str(word)[0][0]
            ids = self.known[word] = np.array([t.id for t in self.whole.model.tokenize(mapped)], "<u4").tobytes()
        return ids

    def part(self, part: str) -> bytes:
        plain = self.PLAIN.fullmatch(part.lower() if part.isascii() and "<" not in part else part)
        if plain:
            return self.word(plain[1]) + (self.word(plain[2]) if plain[2] else b"")
        return np.array(self.whole.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def texts(self, text: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > CACHED:
            self.known.clear()
        counts, parts = words.split(text, lower=False)
        codes, distinct = words.coded(parts)
        encoded = [self.part(p) for p in distinct.to_pylist()]
        lengths = np.array([len(e) // 4 for e in encoded], np.int64)
        flat = np.frombuffer(b"".join(encoded), "<u4")
        starts = np.cumsum(lengths) - lengths
        bounds = np.concatenate([[0], np.cumsum(counts)])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            many = lengths[codes[a:b]]
            at = np.repeat(starts[codes[a:b]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            yield flat[at]


def piece_rows(path: str, length: int):
    """mapInArrow function: doc_id, text -> PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in words.slices(batches, "text"):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), length)):
                    part = ids[start : start + length]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack_lot(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of one lot. lengths: of the pieces, in the order of placing."""
    return merged(*sum_of_squares(lengths, length), length)


def sum_of_squares(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece by the rule alone, and how far each sequence is filled."""
    n_open = np.zeros(length + 1, np.int64)
    by_gap: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset, filled = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for k, size in enumerate(lengths.tolist()):
        gap = 0
        if size < length:
            # half of what the sum of squares grows by if the piece goes into gap size + i; a full sequence has no gap to count
            grows = n_open[: length - size] - n_open[size:length] + 1.0
            grows[0] = 0.5 - n_open[size]
            grows[n_open[size:length] == 0] = np.inf
            best = int(grows.argmin())
            gap = size + best if grows[best] <= n_open[length - size] + 0.5 else 0
        if gap:
            n_open[gap] -= 1
            s = by_gap[gap].pop()
        else:
            s, gap = len(filled), length
            filled.append(0)
        sequence[k], offset[k] = s, filled[s]
        filled[s] += size
        if gap > size:
            n_open[gap - size] += 1
            by_gap[gap - size].append(s)
    return sequence, offset, np.array(filled, np.int64)


def merged(sequence: np.ndarray, offset: np.ndarray, filled: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Put whole sequences into the gaps of others, the fullest first, each into the smallest gap that it fits."""
    into, shift = np.arange(len(filled)), np.zeros(len(filled), np.int64)
    room: dict[int, list[int]] = {}
    gaps = np.zeros(length + 1, bool)
    for s in np.argsort(-filled, kind="stable").tolist():
        size = int(filled[s])
        if size == length:
            continue
        fits = np.flatnonzero(gaps[size:])
        gap = size + int(fits[0]) if len(fits) else length
        host = room[gap].pop() if len(fits) else s
        if len(fits):
            gaps[gap] = bool(room[gap])
            into[s], shift[s] = host, length - gap
        room.setdefault(gap - size, []).append(host)
        gaps[gap - size] = gap > size
    return into[sequence], offset + shift[sequence]


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, lot: int = LOT) -> DataFrame:
    """docs: doc_id, text. One row per piece, as PACKED."""
    n_lots = max(1, -(-docs.count() // lot))
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(piece_rows(tokenizer, length), PIECES)
    dealt = pieces.withColumn("lot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_lots)))

    def placed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = pack_lot(rows["length"].to_numpy(), length)
        return rows.drop(columns="lot").assign(sequence_id=int(key[0]) << 32 | sequence, offset=offset)

    return dealt.groupBy("lot").applyInPandas(placed, PACKED)


@query("op6_packing")
def op6_packing(spark, sf_dir):
    """All documents in sequences of 4096 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
