"""Alignment of the tokens of two tokenizers, weighted by how often their ids meet in the whole corpus.

A text behind one space is cut by a byte-level vocabulary (A) and a vocabulary of pieces (B). Every pair of tokens that
share bytes is a link; where tokens of both end at the same byte, a group ends. The count of an id pair is the number of
links that hold it in the corpus. Each document is judged by its links: the sum of their counts, and how many of them hold
the pair that is the most frequent one of their B id.

* First pass: every task adds up its links per id pair and writes (part, pair, number).
* The distinct pairs are dealt into buckets of about `BUCKET` pairs and each bucket gets a minimal perfect hash, which keeps
  its pairs for verification. The numbers of `LEAVES` parts become one dense vector per bucket, indexed by the hash, and the
  vectors are added as a tree, `FAN_IN` at a time. No task holds more than that many vectors of a bucket.
* Second pass: the documents are aligned again and every link looks up its count. What is sent to all tasks are hashes and
  vectors of at most `MOST_PAIRS` pairs; where there are more, the buckets take turns, and every turn adds to the sums that
  the turns before have written. Nothing is cut off, and no link is shuffled.

Neither vocabulary has a token that crosses a single space or line break between other characters (B's is verified), so a
text is aligned in the stretches between those, once per distinct stretch of a slice. A vocabulary that does not allow
this is applied to whole texts.

Defined results: null and empty texts have no tokens, nor have texts that a vocabulary does not give back byte by byte;
their numbers are 0 and their groups ''. Repeated rows count each, ids (null, repeated) are passed through, ties for the
most frequent pair are all best, an empty table gives an empty result, very long texts are aligned whole, and columns
besides doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm import words
from linewright.llm.perfect_hash import PerfectHash
from linewright.llm.registry import query
from linewright.llm.shared import staged

#: Pairs of a bucket, about; sparse parts of a vector; vectors added at a time.
BUCKET = 1 << 16
LEAVES = 32
FAN_IN = 16
#: Pairs whose counts are sent to all tasks at once (24 bytes each).
MOST_PAIRS = 1 << 22
#: Distinct stretches that are encoded at once, and id pairs that a task adds up before it writes them.
AT_ONCE = 4_096
HELD = 1_000_000
#: Bytes of text that are aligned at once; a single longer text is a slice of its own.
SLICE_BYTES = 2 << 20

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"

#: Bytes that begin a character which is surely no white space.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE0] = True


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists one after the other, and how many each has."""
    return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


class Strings:
    """Byte strings by number, for whole arrays of numbers at once."""

    def __init__(self, strings: list[bytes]) -> None:
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the strings one after the other, and the end of each."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.data[np.arange(sizes.sum()) + np.repeat(self.starts[numbers] - (ends - sizes), sizes)], ends


#: How byte-level vocabularies of this kind cut texts into words before they merge bytes.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merged_by_id(path: str):
    """An encoder of the same vocabulary that merges the pair with the lowest id first, or None if that is not its rule.

    It takes a fifth of the time. The two cut words by tables of different Unicode versions, so it is for texts of letters
    below U+0280 alone, where these agree.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    model, cut = described["model"], described["pre_tokenizer"] or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain = plain and not described["normalizer"] and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
    if not plain:
        return None
    byte_of, vocabulary = byte_level(), model["vocab"]
    ids = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(c not in vocabulary for c in byte_of) or any(i >= j for i, j in pairwise([max(vocabulary[c] for c in byte_of), *ids])):
        return None
    ranks = {bytes(byte_of[c] for c in t): vocabulary[t] for t in [*byte_of, *(t for t, k in vocabulary.items() if len(t) > 1 and all(c in byte_of for c in t))]}
    merged = set(ids)
    return tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks={t: k for t, k in ranks.items() if len(t) == 1 or k in merged}, special_tokens={})


class Aligner:
    """Tokens, groups and links of texts. Ids of a pair are one number: A's id times the size of B, and B's id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.merged_a = merged_by_id(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = byte_level()
        spelled = {k: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else b"" for t, k in self.a.get_vocab().items()}
        size_a = max(spelled) + 1
        self.size_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(self.size_b)]
        self.spelled_a = Strings([spelled.get(k, b"") for k in range(size_a)])
        self.spelled_b = Strings([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])
        # each id as it stands inside its side of a group and at the end of it
        self.written = Strings([b"%d%s" % (k, end) for size, last in ((size_a, b"|"), (self.size_b, b";")) for end in (b",", last) for k in range(size)])
        self.space = self.b.piece_to_id("▁")
        self.in_stretches = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where stretches begin: at texts, at single spaces and at line breaks between solid characters."""
        begins = np.zeros(len(data), bool)
        if self.in_stretches:
            before, here, after = data[:-2], data[1:-1], _SOLID[data[2:]]
            begins[1:-1] = after & (((here == 0x20) & (before != 0x20)) | ((here == 0x0A) & ((before >= 0x80) | _SOLID[before])))
        begins[offsets[:-1]] = True
        return np.flatnonzero(begins)

    def tokens(self, stretches: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids one after the other, number of each stretch) of A and of B."""
        out: list[tuple[list, list]] = [([], []), ([], [])]
        for start in range(0, len(stretches), AT_ONCE):
            some = stretches[start : start + AT_ONCE]
            for (ids, many), found in zip(out, (self.tokens_a(some), self.tokens_b(some)), strict=True):
                ids.append(found[0])
                many.append(found[1])
        nothing = [np.zeros(0, np.int64)]
        return [(np.concatenate(ids or nothing), np.concatenate(many or nothing)) for ids, many in out]

    def tokens_a(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((len(s) > 1 and _SOLID[s[1]] and max(s) < 0xCA for s in stretches), bool, len(stretches))
        plain &= bool(self.in_stretches and self.merged_a)
        ids, many = np.zeros(0, np.int64), np.zeros(len(stretches), np.int64)
        if plain.any():
            # one after the other they are cut where each alone is
            some = [s for s, p in zip(stretches, plain, strict=True) if p]
            ids = np.array(self.merged_a.encode_ordinary(b"".join(some).decode()), np.int64)
            ends = np.searchsorted(np.cumsum(self.spelled_a.sizes[ids]), np.cumsum([len(s) for s in some]), "right")
            many[plain] = np.diff(ends, prepend=0)
        others = [s.decode() for s, p in zip(stretches, plain, strict=True) if not p]
        if not others:
            return ids, many
        more, many[~plain] = flat([e.ids for e in self.a.encode_batch(others, add_special_tokens=False)])
        out = np.empty(many.sum(), np.int64)
        of_plain = np.repeat(plain, many)
        out[of_plain], out[~of_plain] = ids, more
        return out, many

    def tokens_b(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """B puts a space in front: it is the stretch's own one, or comes off again."""
        text = [s.decode() for s in stretches]
        found = self.b.encode([t[1:] if t[0] == " " else t for t in text], num_threads=1)
        return flat([ids[1:] if t[0] != " " and ids[0] == self.space else ids for t, ids in zip(text, found, strict=True)])

    def texts(self, text: pa.Array) -> Aligned:
        text = pc.fill_null(text.cast(pa.large_string()), "")
        filled = np.flatnonzero(pc.not_equal(text, "").to_numpy(zero_copy_only=False))
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text.take(pa.array(filled)), pa.scalar("", pa.large_string()))
        _, offsets, data = spaced.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(spaced) + 1] if len(spaced) else np.zeros(1, np.int64)
        starts = self.starts(np.frombuffer(data or b"", np.uint8)[: offsets[-1]], offsets)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, offsets[-1])), data or pa.py_buffer(b"")])
        codes, distinct = words.coded(cut)
        return Aligned(self, len(text), filled, codes, np.searchsorted(starts, offsets[:-1]), distinct.to_pylist())


class Aligned:
    """The alignment of the texts of a slice: of each its stretches, of each distinct stretch its numbers.

    The tokens of all stretches lie one after the other, as the bytes do. Every place where a token of A or B ends is the end
    of one link, that of the two tokens which hold the byte before; where both end, a group ends.
    """

    def __init__(self, aligner: Aligner, n_rows: int, filled: np.ndarray, codes: np.ndarray, first: np.ndarray, stretches: list[bytes]) -> None:
        (a, n_a), (b, n_b) = aligner.tokens(stretches)
        n = len(stretches)
        size = np.fromiter(map(len, stretches), np.int64, n)
        data = np.frombuffer(b"".join(stretches), np.uint8)
        of_a, of_b, of_byte = (np.repeat(np.arange(n), many) for many in (n_a, n_b, size))
        good = np.ones(n, bool)
        for strings, ids, of in ((aligner.spelled_a, a, of_a), (aligner.spelled_b, b, of_b)):
            good &= np.bincount(of, strings.sizes[ids], n) == size
        for strings, ids, of in ((aligner.spelled_a, a, of_a), (aligner.spelled_b, b, of_b)):
            here = good[of_byte]
            other = strings.joined(ids[good[of]])[0] != data[here]
            good &= np.bincount(of_byte[here][other], minlength=n) == 0
        a, b, of_a, of_b = a[good[of_a]], b[good[of_b]], of_a[good[of_a]], of_b[good[of_b]]
        ends_a, ends_b = np.cumsum(aligner.spelled_a.sizes[a]), np.cumsum(aligner.spelled_b.sizes[b])
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        ends = ends[np.diff(ends, prepend=0) > 0]
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        both = (ends_a[at_a] == ends) & (ends_b[at_b] == ends)
        owner = of_a[at_a]
        self.aligner, self.a, self.b, self.ends_a, self.ends_b, self.cuts = aligner, a, b, ends_a, ends_b, ends[both]
        self.links = a[at_a] * aligner.size_b + b[at_b]
        counts = (of_a, of_b, owner[both], owner)
        self.numbers = np.stack([np.bincount(of, minlength=n) for of in counts], axis=1) if n else np.zeros((0, 4), np.int64)
        self.ends = np.cumsum(self.numbers[:, 3])
        last = np.append(first[1:], len(codes))
        whole = np.logical_and.reduceat(good[codes], first) if len(first) else np.zeros(0, bool)
        self.size_b, self.n_rows, self.codes = aligner.size_b, n_rows, codes
        self.rows, self.first, self.last = filled[whole], first[whole], last[whole]
        self.times = np.bincount(codes[np.repeat(whole, last - first)], minlength=n)

    def per_row(self, of_stretch: np.ndarray) -> np.ndarray:
        """Sums over the stretches of each text; 0 for texts without tokens."""
        sums = np.concatenate([[0], np.cumsum(of_stretch[self.codes])])
        out = np.zeros(self.n_rows, np.int64)
        out[self.rows] = sums[self.last] - sums[self.first]
        return out

    def per_stretch(self, of_link: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of_link)])
        return sums[self.ends] - sums[self.ends - self.numbers[:, 3]]

    def pair_numbers(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(self.links, np.repeat(self.times, self.numbers[:, 3]))

    def groups(self) -> list[bytes]:
        """The groups of each distinct stretch, each with `;` behind it."""
        size_a = len(self.aligner.spelled_a.sizes)
        group_a, group_b = np.searchsorted(self.cuts, self.ends_a), np.searchsorted(self.cuts, self.ends_b)
        upto_a, upto_b = np.searchsorted(self.ends_a, self.cuts, "right"), np.searchsorted(self.ends_b, self.cuts, "right")
        entries = np.empty(len(self.a) + len(self.b), np.int64)
        entries[np.arange(len(self.a)) + np.append(0, upto_b)[group_a]] = self.a + size_a * (self.ends_a == self.cuts[group_a])
        entries[np.arange(len(self.b)) + upto_a[group_b]] = 2 * size_a + self.b + self.size_b * (self.ends_b == self.cuts[group_b])
        data, ends = self.aligner.written.joined(entries)
        text = data.tobytes()
        cuts = np.append(0, ends)[np.append(0, np.cumsum(self.numbers[:, 0] + self.numbers[:, 1]))].tolist()
        return [text[i:j] for i, j in pairwise(cuts)]

    def joined_groups(self) -> list[str]:
        out = [""] * self.n_rows
        codes, of = self.codes.tolist(), self.groups().__getitem__
        for row, i, j in zip(self.rows.tolist(), self.first.tolist(), self.last.tolist(), strict=True):
            out[row] = b"".join(map(of, codes[i:j]))[:-1].decode()
        return out


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    keys, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, n)
    return keys[total > 0], total[total > 0]


def links_of_parts(path_a: str, path_b: str):
    """mapInArrow function: text -> part, pair, n; each pair once per HELD pairs of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = Aligner(path_a, path_b), TaskContext.get().partitionId()
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def batch_of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int64)), pa.array(keys), pa.array(n)], names=["part", "pair", "n"])

        for batch in words.slices(batches, "text", SLICE_BYTES):
            more = aligner.texts(batch.column(0)).pair_numbers()
            keys, n = summed(np.concatenate([keys, more[0]]), np.concatenate([n, more[1]]))
            if len(keys) > HELD:
                yield batch_of(keys, n)
                keys, n = keys[:0], n[:0]
        if len(keys):
            yield batch_of(keys, n)

    return run


#: A prime and a multiplier that spread pairs over buckets without passing 63 bits, in Spark and in numpy alike.
_PRIME, _SPREAD = (1 << 31) - 1, 2_654_435_761


def bucket_column(pair: Column, n_buckets: int) -> Column:
    return F.shiftright((pair % _PRIME * _SPREAD % (1 << 32)) * n_buckets, 32)


def bucket_numbers(pair: np.ndarray, n_buckets: int) -> np.ndarray:
    return (pair % _PRIME * _SPREAD % (1 << 32)) * n_buckets >> 32


def hashed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    table = PerfectHash.of(rows["pair"].to_numpy())
    return pd.DataFrame({"bucket": [key[0]], "sizes": [table.sizes.tobytes()], "bits": [table.bits.tobytes()], "pairs": [table.keys.tobytes()]})


def restored(sizes: bytes, bits: bytes, pairs: bytes) -> PerfectHash:
    return PerfectHash.restored(np.frombuffer(sizes, "<i8"), np.frombuffer(bits, "<u8"), np.frombuffer(pairs, "<i8"))


def dense(key: tuple, numbers: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    """The vector of one lot of parts in one bucket."""
    own = restored(*table.iloc[0][["sizes", "bits", "pairs"]])
    vector = np.zeros(len(own.keys), np.int64)
    place = own.verified(numbers["pair"].to_numpy())
    if (place < 0).any():
        raise ValueError(f"bucket {key[0]} lacks a pair of the first pass")
    np.add.at(vector, place, numbers["n"].to_numpy())
    return pd.DataFrame({"bucket": [key[0]], "lot": [key[1]], "counts": [vector.tobytes()]})


def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    vector = sum(np.frombuffer(v, "<i8") for v in rows["counts"])
    return pd.DataFrame({"bucket": [key[0]], "lot": [key[1]], "counts": [vector.tobytes()]})


def counted(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, int]:
    """(bucket, sizes, bits, pairs, counts) as a written table, and the number of buckets."""
    numbers = staged(docs.select("text").mapInArrow(links_of_parts(path_a, path_b), "part long, pair long, n long"), "alignment-links")
    distinct = staged(numbers.select("pair").distinct(), "alignment-pairs")
    n_buckets = -(-distinct.count() // BUCKET)
    n_lots = ((numbers.agg(F.max("part")).first()[0] or 0) // LEAVES) + 1
    bucket = bucket_column(F.col("pair"), max(n_buckets, 1)).alias("bucket")
    tables = staged(distinct.select(bucket, "pair").groupBy("bucket").applyInPandas(hashed, "bucket long, sizes binary, bits binary, pairs binary"), "alignment-hashes")
    dealt = numbers.select(bucket, F.floor(F.col("part") / LEAVES).alias("lot"), "pair", "n")
    in_lots = dealt.select("bucket", "lot").distinct().join(tables, "bucket").withColumnsRenamed({"bucket": "its_bucket", "lot": "its_lot"})
    vectors = dealt.groupBy("bucket", "lot").cogroup(in_lots.groupBy("its_bucket", "its_lot")).applyInPandas(dense, "bucket long, lot long, counts binary")
    while n_lots > 1:
        n_lots = -(-n_lots // FAN_IN)
        vectors = vectors.select("bucket", F.floor(F.col("lot") / FAN_IN).alias("lot"), "counts").groupBy("bucket", "lot").applyInPandas(added, "bucket long, lot long, counts binary")
    return staged(tables.join(vectors.drop("lot"), "bucket"), "alignment-counts"), n_buckets


def pair_table(counts: DataFrame, size_b: int) -> DataFrame:
    """a_id, b_id, n of every id pair that a link holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs = np.frombuffer(pairs, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(pairs // size_b), pa.array(pairs % size_b), pa.array(np.frombuffer(n, "<i8"))], names=["a_id", "b_id", "n"])

    return counts.select("pairs", "counts").mapInArrow(run, "a_id long, b_id long, n long")


def size_of(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def judged(path_a: str, path_b: str, sent, last: bool):
    """mapInArrow function: doc_id, text, n_best, count_sum -> the same with this turn's buckets added, or ALIGNED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        most, n_buckets, buckets = sent.value
        tables = {b: (restored(*table), np.frombuffer(counts, "<i8")) for b, (*table, counts) in buckets.items()}
        for batch in words.slices(batches, "text", SLICE_BYTES):
            own = aligner.texts(batch.column(1))
            pairs, at = np.unique(own.links, return_inverse=True)
            count = np.zeros(len(pairs), np.int64)
            # stretches that stand only in texts without tokens have not been counted
            used = np.bincount(at, np.repeat(own.times, own.numbers[:, 3]), len(pairs)) > 0
            of = np.where(used, bucket_numbers(pairs, n_buckets), -1)
            for b, (table, counts) in tables.items():
                here = np.flatnonzero(of == b)
                place = table.verified(pairs[here])
                if (place < 0).any():
                    raise ValueError(f"bucket {b} lacks a pair of the second pass")
                count[here] = counts[place]
            best = (count > 0) & (count == most[pairs % own.size_b])
            n_best = own.per_row(own.per_stretch(best[at].astype(np.int64))) + batch.column(2).to_numpy()
            total = own.per_row(own.per_stretch(count[at])) + batch.column(3).to_numpy()
            if last:
                columns = [batch.column(0), *(pa.array(own.per_row(own.numbers[:, k])) for k in range(4)), pa.array(n_best), pa.array(total), pa.array(own.joined_groups(), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_best), pa.array(total)], names=["doc_id", "text", "n_best", "count_sum"])

    return run


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs: doc_id, text. One row per document, as ALIGNED; groups: `a1,a2|b1;a3|b2,b3` in the text's order."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    counts, n_buckets = counted(docs, path_a, path_b)
    size_b = size_of(path_b)
    most = np.zeros(size_b, np.int64)
    # one row per id of B at most
    for r in pair_table(counts, size_b).groupBy("b_id").agg(F.max("n").alias("n")).toLocalIterator():
        most[r.b_id] = r.n
    docs = docs.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    in_turn = max(1, MOST_PAIRS // BUCKET)
    for start in range(0, max(n_buckets, 1), in_turn):
        rows = counts.where(F.col("bucket").between(start, start + in_turn - 1)).collect()
        buckets = {r.bucket: (bytes(r.sizes), bytes(r.bits), bytes(r.pairs), bytes(r.counts)) for r in rows}
        sent = docs.sparkSession.sparkContext.broadcast((most, max(n_buckets, 1), buckets))
        last = start + in_turn >= n_buckets
        docs = docs.mapInArrow(judged(path_a, path_b, sent, last), ALIGNED if last else "doc_id long, text string, n_best long, count_sum long")
        if not last:
            docs = staged(docs, "alignment-turn")
    return docs


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark, sf_dir):
    """Alignment of a byte-level and a piece vocabulary over every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    aligned = alignments(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups"), 256))).drop("groups")
