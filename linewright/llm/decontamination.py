"""Words of documents that repeat passages of benchmark items.

Both sides are normalised: A-Z lower-cased, words are runs of ASCII digits and letters and of everything beyond ASCII. All
windows of `WINDOW` consecutive words of all items (an item of fewer words is one window) go into one Aho-Corasick
automaton over ` word word ... `; each document's normalised text runs through it once, whatever the number of windows.
Only texts with a match are looked at again, to find the matched words and their places in the original text.

The automaton is made in each task from the windows, which travel as one broadcast: its size is checked first, and above
`MOST_BYTES` of benchmark text the call is refused rather than cut (give it the items in parts and join the hits). The
documents are scanned in place and never shuffled.

Defined results: a null or empty text has no words; items without words (null, empty, signs only) have no window; an item
id that stands on several rows is one item with the windows of all of them, a null id is left out of the list of items but
its windows count as hits; repeated documents are judged each; an empty table of documents gives an empty result, an empty
benchmark gives no hits; columns of the same names as results are replaced in `scanned` and kept in `clean_documents`.
Very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm import words
from linewright.llm.registry import query

WINDOW = 13
#: Largest benchmark text that is broadcast; the automaton takes about 60 times the bytes of the distinct windows.
MOST_BYTES = 32 << 20

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>, spans array<struct<start:int,end:int>>"
#: Everything that is no word, and words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normalised(texts: pa.Array) -> tuple[pa.Array, list[str]]:
    """The texts with A-Z lower-cased (places stay), and ` word word ... ` of each, or one blank if it has no word."""
    low = pc.ascii_lower(words.plain(texts))
    spaced = pc.ascii_trim(pc.replace_substring_regex(low, BETWEEN, " "), " ").to_pylist()
    return low, [f" {s} " if s else " " for s in spaced]


def windows_of(items: list[tuple[int | None, str | None]], n: int = WINDOW) -> dict[str, set]:
    """Window -> ids of the items that have it."""
    found: dict[str, set] = {}
    for (item_id, _), norm in zip(items, normalised(pa.array([text for _, text in items], pa.string()))[1], strict=True):
        w = norm.split(" ")[1:-1]
        for i in range(max(1, len(w) - n + 1) if w else 0):
            found.setdefault(f" {' '.join(w[i : i + n])} ", set()).add(item_id)
    return found


def automaton_of(found: dict[str, set]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for window, ids in found.items():
        automaton.add_word(window, (window.count(" ") - 1, tuple(ids)))
    automaton.make_automaton()
    return automaton


def scan(low: pa.Scalar, norm: str, automaton) -> tuple:
    """One row of RESULT. low, norm: as `normalised` returns them."""
    n_words = max(0, norm.count(" ") - 1)
    hits = list(automaton.iter(norm)) if len(automaton) and n_words else []
    items: set = set()
    spans: list = []
    n_hit = 0
    if hits:
        word_no = np.cumsum(np.frombuffer(norm.encode("utf-32-le"), "<u4") == 32)
        change = np.zeros(n_words + 1, np.int64)
        for end, (size, ids) in hits:
            last = int(word_no[end]) - 1  # words that end before this blank
            change[last - size] += 1
            change[last] -= 1
            items.update(ids)
        hit = np.cumsum(change)[:n_words] > 0
        n_hit = int(hit.sum())
        places = [m.span() for m in WORD.finditer(low.as_py())]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[::2], edges[1::2], strict=True)]
    items.discard(None)
    digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words, sorted(items), spans


def scanned(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs with the columns of RESULT. docs: text and others; items: item_id, text. Spans: code points of the text."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text, more than the {MOST_BYTES} that may be broadcast; give it in parts")
    found = windows_of([(r[0], r[1]) for r in items.select(F.col("item_id").cast("long"), "text").collect()], n)
    sent = docs.sparkSession.sparkContext.broadcast(found)
    new = [part.split()[0] for part in RESULT.split(", ")]
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), RESULT])
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(sent.value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        for batch in words.slices(batches, "text"):
            rows = [scan(low, norm, automaton) for low, norm in zip(*normalised(batch.column(place)), strict=True)]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *new])

    return kept.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    both = docs.select(F.struct(*own).alias("doc"), "text")
    return scanned(both, items).where("NOT contaminated").select("doc.*")


@query("op7_decontamination")
def op7_decontamination(spark, sf_dir):
    """Words hit by benchmark passages, per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = scanned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
