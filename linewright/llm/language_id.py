"""Language of texts, word by word, with character n-grams for words that training has not seen.

Words are runs of letters in lower case. A known word adds the logarithm of its smoothed relative frequency in each language.
For any other word the n-grams of the word between marks of its ends step in: the 5-grams if training knows any of them,
else the 4-grams, and so on down to single letters; the known ones add their log frequencies, averaged over the word, so that
a word weighs like a word. A word without any known letter says nothing. The language with the largest sum wins, ties go to
the first in the order of its name; the score is its share of the likelihood of all languages.

Training counts words and n-grams per language on the executors. Rows that may be used are given; of these, `SAMPLE` per
language, those with the lowest hash of their id, are the sample, read whole. Words in fewer than `MIN_ROWS` rows of the
sample are left to the n-grams, which keeps names, typing errors and junk out of the model. The model is bounded by the sample, whatever
the corpus, and is sent to all tasks, which keep it per Python worker. All documents are scored where they are read, without any shuffle.

Defined results: a null text and a text without letters have the language `und` and score 0, so has everything where nothing
could be learned; null languages are not learned, an empty one is a language; a null id counts as the empty text for the fold;
repeated rows count each; very long texts are read whole; an empty table gives an empty result; columns besides doc_id, text
and lang are left out, whatever their names.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions.workers import kept_per_worker
from linewright.llm import words
from linewright.llm.registry import query
from linewright.llm.shared import fold_of, staged

#: Training rows of each language; a word is known from this many of them on.
SAMPLE = 2_000
MIN_ROWS = 2
LONGEST = 5
#: Parts that the ids of a language are dealt into before they are ranked.
DEALS = 64
#: Added to every count.
SMOOTH = 0.5
#: Distinct parts of texts whose sums a task keeps.
CACHED = 300_000
UNKNOWN = "und"

#: Kind of a count: 0 for words, n for n-grams, -1 for the number of rows.
COUNTS = "lang string, kind int, term string, n long, in_rows long"


#: Signs that words often stand between.
EDGES = ".,;:!?\"'()[]{}<>|#$%&*-_+=/\\0123456789"


def words_of(part: str) -> list[str]:
    """Words of a white-space separated part, composed and in lower case."""
    import regex

    word = part.strip(EDGES).lower()
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    return [word] if word.isalpha() else regex.findall(r"\p{L}+", word)


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word between marks of its ends; single letters stand alone."""
    if n == 1:
        return list(word)
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> COUNTS, each term once per language and slice."""
    for batch in words.slices(batches, "text"):
        counts, flat = words.split(batch.column(1), lower=False)
        codes, distinct = words.coded(flat)
        found = [words_of(p) for p in distinct.to_pylist()]
        seen: dict[str, tuple[Counter, Counter]] = {}
        ends = np.cumsum(counts)
        for lang, start, end in zip(batch.column(0).to_pylist(), ends - counts, ends, strict=True):
            own = Counter(w for c in codes[start:end].tolist() for w in found[c])
            times, rows = seen.setdefault(lang, (Counter(), Counter()))
            times.update(own)
            rows.update(own.keys())
        for lang, (times, rows) in seen.items():
            out = [(0, w, n, rows[w]) for w, n in times.items()]
            for size in range(1, LONGEST + 1):
                of_size: Counter = Counter()
                for w, n in times.items():
                    for g in grams(w, size):
                        of_size[g] += n
                out += [(size, g, n, 0) for g, n in of_size.items()]
            kinds, terms, n, in_rows = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [pa.array([lang] * len(out), pa.string()), pa.array(kinds, pa.int32()), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(in_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "term", "n", "in_rows"])


class Model:
    """Log frequencies per language of words (kind 0) and of n-grams (kind n); the rows of all kinds lie in one table."""

    def __init__(self, langs: list[str], terms: list[list[str]], logs: np.ndarray) -> None:
        self.langs, self.terms, self.logs = langs, terms, logs
        starts = np.cumsum([0, *map(len, terms)]).tolist()
        self.places = [{t: start + k for k, t in enumerate(of)} for of, start in zip(terms, starts, strict=False)]
        self.known: dict[str, int] = {}
        self.sums = np.zeros((0, len(langs)))
        self.lettered = np.zeros(0, bool)

    @classmethod
    def of(cls, langs: list[str], terms: list[list[str]], counts: list[np.ndarray]) -> Model:
        """terms and counts (a row per term, a column per language) of each kind."""
        logs = [np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * max(len(n), 1))) for n in counts]
        return cls(langs, terms, np.concatenate(logs))

    def found(self, word: str) -> list[int]:
        """Places of the word, else of its longest n-grams that are known at all; their logs are averaged."""
        place = self.places[0].get(word)
        if place is not None:
            return [place]
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            at = [p for p in map(self.places[n].get, grams(word, n)) if p is not None]
            if at:
                return at
        return []

    def learn(self, parts: list[str]) -> None:
        """Sums over the words of parts, all parts at once."""
        places, sizes, many = [], [], []
        for part in parts:
            found = words_of(part)
            many.append(len(found))
            for word in found:
                at = self.found(word)
                places += at
                sizes.append(len(at))
        sizes, many = np.array(sizes, np.int64), np.array(many, np.int64)
        of_word = np.repeat(np.arange(len(sizes)), sizes)
        of_part = np.repeat(np.arange(len(many)), many)[of_word]
        logs = self.logs[np.array(places, np.int64)]
        sums = np.stack([np.bincount(of_part, logs[:, k] / sizes[of_word], len(many)) for k in range(len(self.langs))], axis=1)
        for k, part in enumerate(parts, len(self.sums)):
            self.known[part] = k
        self.sums = np.concatenate([self.sums, sums])
        self.lettered = np.concatenate([self.lettered, many > 0])

    def parts(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the words of parts, and whether they have any."""
        if len(self.known) > CACHED:
            self.known.clear()
            self.sums, self.lettered = self.sums[:0], self.lettered[:0]
        new = [p for p in distinct if p not in self.known]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        return self.sums[at], self.lettered[at]

    def predicted(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        counts, flat = words.split(text, lower=False)
        if not self.langs:
            return [UNKNOWN] * len(counts), np.zeros(len(counts))
        codes, distinct = words.coded(flat)
        sums, lettered = self.parts(distinct.to_pylist())
        rows = np.repeat(np.arange(len(counts)), counts)
        total = np.stack([np.bincount(rows, sums[codes, k], len(counts)) for k in range(len(self.langs))], axis=1)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        some = np.bincount(rows, lettered[codes], len(counts)) > 0
        return [self.langs[k] if s else UNKNOWN for k, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def sampled(docs: DataFrame, folds: int, held_out: int, sample: int) -> DataFrame:
    """lang, text of the training rows: of each language the `sample` ids with the lowest hash. Only ids are ranked."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
    hashed = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    # in two steps, so that no task ranks all ids of a language: first within each of `DEALS` parts, then what these keep
    for deal in ([F.pmod("h", F.lit(DEALS))], []):
        ranked = hashed.withColumn("place", F.row_number().over(Window.partitionBy("lang", *deal).orderBy("h", "doc_id")))
        hashed = ranked.where(F.col("place") <= sample).drop("place")
    chosen = hashed
    chosen = staged(chosen.select("lang", "doc_id").distinct(), "language-sample")
    return usable.join(chosen.withColumnsRenamed({"lang": "its_lang", "doc_id": "its_id"}), F.col("lang").eqNullSafe(F.col("its_lang")) & F.col("doc_id").eqNullSafe(F.col("its_id")), "left_semi").select("lang", "text")


def trained(docs: DataFrame, folds: int, held_out: int, sample: int = SAMPLE, min_rows: int = MIN_ROWS) -> Model:
    """docs: doc_id, text, lang."""
    counts = sampled(docs, folds, held_out, sample).mapInArrow(count_terms, COUNTS)
    counts = counts.groupBy("lang", "kind", "term").agg(F.sum("n").alias("n"), F.sum("in_rows").alias("in_rows"))
    counts = staged(counts, "language-counts")
    known = counts.where("kind = 0").groupBy("term").agg(F.sum("in_rows").alias("rows")).where(F.col("rows") >= min_rows).select("term", F.lit(0).alias("kind"))
    kept = counts.where("kind > 0").unionByName(counts.join(known, ["term", "kind"], "left_semi"))
    # as many rows as the sample's words and n-grams, whatever the corpus
    table = kept.select("lang", "kind", "term", "n").toArrow()
    langs = sorted(set(table.column("lang").to_pylist()), key=str.encode)
    column = {lang: k for k, lang in enumerate(langs)}
    of = np.array([column[x] for x in table.column("lang").to_pylist()], np.int64)
    kind, n = table.column("kind").to_numpy(), table.column("n").to_numpy()
    terms, numbers = [], []
    for size in range(LONGEST + 1):
        here = np.flatnonzero(kind == size)
        codes, distinct = words.coded(table.column("term").take(pa.array(here)).combine_chunks())
        own = np.zeros((len(distinct), len(langs)))
        own[codes, of[here]] = n[here]
        terms.append(distinct.to_pylist())
        numbers.append(own)
    return Model.of(langs, terms, numbers)


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.terms, model.logs))
    name = uuid.uuid4().hex

    def received() -> Model:
        return Model(*sent.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept_per_worker("language", name, received)
        for batch in words.slices(batches, "text"):
            lang, score = model.predicted(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """docs: doc_id, text, lang. Returns doc_id, held_out, lang_pred, score; languages of the held-out fold are not used."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    found = predictions(docs, trained(docs, folds, held_out))
    return found.select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score")


@query("op13_language_id")
def op13_language_id(spark, sf_dir):
    """Language of every document."""
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 2)
