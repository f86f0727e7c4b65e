"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its words in lower case, without signs at their ends, and the words' first 4 to 9 letters, hashed into
`BUCKETS` places. A document is the set of its places. Its score is the logistic of bias + sum of weights +
sum over all pairs of places of the products of their factor vectors, so a pair (an insult with a mention of a group) can
weigh what neither of its parts does; the pairs cost one pass, as the sum over pairs is half of (sum of vectors) squared
minus the sum of squared vectors.

Training uses a bounded sample of labelled rows (`SAMPLE` of each class, those with the lowest hash of their id; the bias
is corrected for the classes' true shares). Places are screened first: the `PLACES` whose share differs most surely between
the classes take part, the others weigh nothing. The machine is fitted by AdaGrad on the driver over these few places; the
model is a few hundred kilobytes whatever the corpus. All documents are scored in the tasks that read them, without any
shuffle.

Defined results: a null or empty text has no terms and gets the score of the bias; null labels are left out, repeated
labels count each; without labelled rows of both classes the score is the share of label 1 (0.5 without labels); a null id
counts as the empty text in `held_out`; repeated rows are scored each and ties have no effect; empty tables give empty
results; columns besides doc_id and text are left out, whatever their names. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm import words
from linewright.llm.registry import query
from linewright.llm.shared import fold_of

BUCKETS = 1 << 18
SAMPLE = 5_000
PLACES = 2_048
FACTORS = 4
PREFIXES = (4, 5, 6, 7, 8, 9)
EDGES = ".,;:!?\"'()[]{}<>|#$%&*-_+=/\\"


def places_of_words(distinct: pa.Array) -> np.ndarray:
    """For each distinct word the places of its terms (an absent term repeats the word)."""
    import xxhash

    place = np.empty((len(distinct), 1 + len(PREFIXES)), np.int32)
    h = xxhash.xxh3_64_intdigest
    for i, w in enumerate(distinct.to_pylist()):
        w = w.lower().strip(EDGES) or w
        place[i] = h(w.encode()) % BUCKETS
        for j, n in enumerate(PREFIXES, 1):
            if len(w) > n:
                place[i, j] = h(f"{n}:{w[:n]}".encode()) % BUCKETS
    return place


def marked(text: pa.Array, feature_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (row, place) of texts, or (row, feature) where a table place -> feature (or -1) is given."""
    counts, flat = words.split(text)
    codes, distinct = words.coded(flat)
    place = places_of_words(distinct)
    rows = np.repeat(np.arange(len(counts)), counts)
    if feature_of is not None:
        place = feature_of[place]
        used = (place >= 0).any(axis=1)[codes]
        rows, codes = rows[used], codes[used]
    pairs = np.unique((rows[:, None].astype(np.int64) * BUCKETS + place[codes])[place[codes] >= 0])
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass(frozen=True)
class Machine:
    bias: float
    feature_of: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, n_rows: int, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        total = self.bias + np.bincount(rows, self.weights[features], n_rows)
        for v in self.factors.T:
            total += 0.5 * (np.bincount(rows, v[features], n_rows) ** 2 - np.bincount(rows, v[features] ** 2, n_rows))
        return total


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def screened(rows: np.ndarray, places: np.ndarray, label: np.ndarray, most: int = PLACES) -> np.ndarray:
    """The places whose share differs most surely between the classes, by the z score of the difference."""
    n1 = max(1.0, label.sum())
    n0 = max(1.0, len(label) - label.sum())
    with1 = np.bincount(places, label[rows], BUCKETS)
    both = np.bincount(places, minlength=BUCKETS)
    pooled = (both + 1) / (n0 + n1 + 2)
    z = np.abs(with1 / n1 - (both - with1) / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
    z[both < 3] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] > 2.5])


def fit(rows: np.ndarray, places: np.ndarray, label: np.ndarray, shift: float, passes: int = 300, rate: float = 0.2, ridge: float = 5e-5, seed: int = 3) -> Machine:
    """Full-batch AdaGrad on the mean logistic loss with a ridge penalty."""
    kept = screened(rows, places, label)
    feature_of = np.full(BUCKETS, -1, np.int32)
    feature_of[kept] = np.arange(len(kept))
    feature = feature_of[places]
    rows, feature = rows[feature >= 0], feature[feature >= 0]
    n = len(label)
    theta = np.concatenate([np.zeros((len(kept), 1)), np.random.default_rng(seed).normal(0, 0.05, (len(kept), FACTORS))], axis=1)
    bias, seen, seen_bias = 0.0, np.full(theta.shape, 1e-6), 1e-6
    for _ in range(passes):
        machine = Machine(bias, feature_of, theta[:, 0], theta[:, 1:])
        error = (logistic(machine.logits(n, rows, feature)) - label) / n
        slope = np.empty_like(theta)
        slope[:, 0] = np.bincount(feature, error[rows], len(kept))
        for k in range(FACTORS):
            v = theta[:, 1 + k]
            others = np.bincount(rows, v[feature], n)[rows] - v[feature]
            slope[:, 1 + k] = np.bincount(feature, error[rows] * others, len(kept))
        slope += ridge * theta
        seen += slope**2
        seen_bias += error.sum() ** 2
        theta -= rate * slope / np.sqrt(seen)
        bias -= rate * error.sum() / math.sqrt(seen_bias)
    return Machine(bias + shift, feature_of, theta[:, 0].copy(), theta[:, 1:].copy())


def trained(docs: DataFrame, labels: DataFrame) -> Machine:
    """docs: doc_id, text; labels: doc_id, label, one row per label that may be used."""
    nothing = (np.full(BUCKETS, -1, np.int32), np.zeros(0), np.zeros((0, FACTORS)))
    labels = labels.where("label IN (0, 1)")
    totals = {r.label: r.n for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Machine(30.0 if n1 else -30.0 if n0 else 0.0, *nothing)
    chosen = labels.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).unionByName(labels.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            row, place = marked(batch.column(1))
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sets = [place[a:b].astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["label", "places"])

    # at most 2 * SAMPLE ids: a fixed bound, whatever the corpus
    sample = docs.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(run, "label int, places binary").collect()
    if len({r.label for r in sample}) < 2:
        return Machine(math.log(n1 / n0), *nothing)
    sets = [np.frombuffer(r.places, "<i4") for r in sample]
    label = np.array([r.label for r in sample], float)
    shift = math.log(n1 / n0) - math.log(label.sum() / (len(label) - label.sum()))
    return fit(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), label, shift)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.feature_of, machine.weights, machine.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*sent.value)
        for batch in words.slices(batches, "text"):
            score = logistic(own.logits(batch.num_rows, *marked(batch.column(1), own.feature_of)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, least: float) -> DataFrame:
    """Returns doc_id, held_out, score, predicted. Labels of the held-out fold are not used."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where(fold_of(F.col("doc_id"), folds) != held_out)
    machine = trained(docs.select(F.col("doc_id").cast("long"), "text"), known)
    return scored(docs, machine).select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classified(docs, labels, "toxic", 3, 1, 0.7)
