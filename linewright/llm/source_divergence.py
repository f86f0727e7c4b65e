"""Audit of how the vocabulary of sources differs, with terms carried as digests until the last step.

Terms are runs of letters (A-Z and a-z, and anything outside ASCII), A-Z lower-cased. A language keeps the terms that at
least `MIN_DOCS` of its documents have. Every source of a language, and the language itself, gives each kept term a share
of `SCALE` parts, smoothed by two occurrences; two shares p and q are (p - q)^2 / (p + q) apart. The audit reports, per
source, how far every other source of its language is (summed over all kept terms), and the terms that most set it apart
from its language. All arithmetic is in whole numbers.

Late materialization: the tasks that read the texts write (language, source, 64-bit digest of the term, counts), and beside
the first row of a term the term itself, once. From these files the counting reads, shuffles and sums digests and numbers
only; the column of terms is not read. Terms come in for the digests that pass `MIN_DOCS`: the smallest and the largest
string of a digest are equal unless two terms share it. Digests shared by several terms are split, that is counted again
from the texts by the terms themselves and numbered in `twin`. After that, (digest, twin) stands for a term exactly, and
strings are joined back only to the few rows that are returned.

Distances between sources: of a pair's terms only those that one of both has are summed one by one; all others have the
same two smallest shares, so their number is enough. The work is dealt in blocks of about `TERMS` terms and tiles of about
`SOURCES` by `SOURCES` sources, each block with the list of its tile's sources, so neither a large language nor a source with a third of all rows makes a large group, and
what is shuffled are sums per block, not pairs per term.

Defined results: a null text, language or source is an empty one; a group without terms has all its distances and no terms;
a language without kept terms has distances 0; documents count each, also repeated rows and null ids; ties rank by the bytes
of the item; an empty table gives an empty result; very long texts are read whole, `words.SLICE_BYTES` of texts (or one
text) at a time; further columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm import words
from linewright.llm.registry import query
from linewright.llm.shared import staged

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
#: Kept terms of a block and sources of a tile's side, about.
TERMS = 4096
SOURCES = 256
#: Bits of the table that tells which digests may pass: at most 2^20 rows of 16 bytes are sent to all tasks.
BITS = 1 << 26

PARTIAL = "lang string, source string, digest long, n long, docs long, term string"
KEY = ("lang", "digest", "twin")

#: For each byte of UTF-8 text the byte itself if it belongs to a term (A-Z lower-cased), else a space.
_IN_TERM = np.full(256, 0x20, np.uint8)
_IN_TERM[0x80:] = np.arange(0x80, 0x100)
_IN_TERM[0x61:0x7B] = np.arange(0x61, 0x7B)
_IN_TERM[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms_of(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of terms of each text, and all terms in order."""
    text = words.plain(text)
    _, offsets, data = text.buffers()
    size = int(np.frombuffer(offsets, np.int64)[len(text)]) if len(text) else 0
    letters = _IN_TERM[np.frombuffer(data, np.uint8)[:size]] if size else np.zeros(0, np.uint8)
    spaced = pa.LargeStringArray.from_buffers(len(text), offsets, pa.py_buffer(letters.tobytes())) if size else text
    return words.split(spaced, lower=False)


def partials(mask: int, every_term: bool):
    """mapInArrow function: lang, source, text -> PARTIAL, each term once per group and slice.

    The string is null but for the first row of a term and language in a slice, unless every one is asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            counts, flat = terms_of(batch.column(2))
            if not len(flat):
                continue
            codes, distinct = words.coded(flat)
            lang, source = (pc.fill_null(batch.column(i), "").dictionary_encode() for i in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            in_doc, n = np.unique(np.repeat(np.arange(len(counts)), counts) * len(distinct) + codes, return_counts=True)
            keys, place = np.unique(group[in_doc // len(distinct)] * len(distinct) + in_doc % len(distinct), return_inverse=True)
            of, term = np.divmod(keys, len(distinct))
            digest = (words.hashes(distinct) & np.uint64(mask)).view(np.int64)
            again = np.ones(len(keys), bool)
            again[np.unique(of // len(source.dictionary) * len(distinct) + term, return_index=True)[1]] = False
            columns = [
                lang.dictionary.take(pa.array(of // len(source.dictionary))),
                source.dictionary.take(pa.array(of % len(source.dictionary))),
                pa.array(digest[term]),
                pa.array(np.bincount(place, n).astype(np.int64)),
                pa.array(np.bincount(place)),
                distinct.cast(pa.string()).take(pa.array(term, mask=None if every_term else again)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "digest", "n", "docs", "term"])

    return run


def may_pass(passing: DataFrame) -> DataFrame:
    """word, bits: the digests that pass, as a table of `BITS` bits at most, 64 to a row, whatever their number."""
    bit = F.pmod("digest", F.lit(BITS))
    return passing.select(F.floor(bit / 64).alias("word"), F.expr("shiftleft(1L, int(pmod(digest, 64)))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def spelled(partial: DataFrame, passing: DataFrame) -> DataFrame:
    """lang, digest, least, most: the smallest and the largest string of each digest that passes.

    The table of bits keeps nearly all strings of rare terms in the tasks that read them; the exact join follows behind the
    aggregation.
    """
    bits = F.broadcast(staged(may_pass(passing), "divergence-bits"))
    word = F.floor(F.pmod("digest", F.lit(BITS)) / 64).alias("word")
    some = partial.where("term IS NOT NULL").select("lang", "digest", "term", word).join(bits, "word")
    some = some.where("(bits & shiftleft(1L, int(pmod(digest, 64)))) <> 0")
    ends = some.groupBy("lang", "digest").agg(F.min("term").alias("least"), F.max("term").alias("most"))
    return ends.join(passing.select("lang", "digest"), ["lang", "digest"], "left_semi")


def counted(partial: DataFrame, min_docs: int, again) -> tuple[DataFrame, DataFrame]:
    """(kept terms, their occurrences per source): lang, digest, twin, n, term; and lang, source, digest, twin, n.

    again: a function that reads the texts once more, for PARTIAL with all strings; called only where terms share a digest.
    """
    by_source = staged(partial.groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    passing = staged(by_source.groupBy("lang", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs), "divergence-passing")
    ends = staged(spelled(partial, passing), "divergence-terms")
    one = ends.where("least = most").select("lang", "digest", F.lit(0).alias("twin"), F.col("least").alias("term"))
    kept = passing.join(one, ["lang", "digest"]).select(*KEY, "n", "term")
    in_source = by_source.select("lang", "source", "digest", F.lit(0).alias("twin"), "n")
    shared = ends.where("least < most").select("lang", "digest")
    if not shared.isEmpty():
        # several terms with one digest: few, so they are counted by their strings
        apart_again = again().join(shared, ["lang", "digest"], "left_semi").groupBy("lang", "digest", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        apart_again = staged(apart_again, "divergence-shared")
        twins = apart_again.groupBy("lang", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        twins = twins.withColumn("twin", F.row_number().over(Window.partitionBy("lang", "digest").orderBy("term"))).where(F.col("docs") >= min_docs)
        twins = staged(twins.select(*KEY, "n", "term"), "divergence-twins")
        kept = kept.unionByName(twins)
        in_source = in_source.unionByName(apart_again.join(twins.select(*KEY, "term"), ["lang", "digest", "term"]).select("lang", "source", "digest", "twin", "n"))
    kept = staged(kept, "divergence-kept")
    return kept, staged(in_source.join(kept.select(*KEY), list(KEY), "left_semi"), "divergence-kept-counts")


def share(n: Column, total: Column, kept: Column) -> Column:
    """Parts of SCALE of a term with n of `total` occurrences, where the language keeps `kept` terms."""
    wide = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + 2 * kept).cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def tile_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Distances of all pairs of sources of one tile, over those terms of one block that either has.

    rows: source, side, digest, twin, p, least (share of an absent term); every source of the tile has a row with p = 0
    besides. Returns lang, source, item, part, either.
    """
    lang, _, low, high = key
    source, names = pd.factorize(rows["source"])
    least = np.zeros(len(names), np.int64)
    least[source] = rows["least"].to_numpy()
    side = np.zeros(len(names), np.int64)
    side[source] = rows["side"].to_numpy()
    real = rows["p"].to_numpy() > 0
    rows, source = rows[real], source[real]
    term = rows.groupby(["digest", "twin"], sort=False).ngroup().to_numpy()
    p = np.broadcast_to(least, (term.max(initial=-1) + 1, len(names))).copy()
    has = np.zeros(p.shape, bool)
    p[term, source] = rows["p"].to_numpy()
    has[term, source] = True
    left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
    sums = np.zeros((len(left), len(right)), np.int64)
    for k, s in enumerate(left):
        own, others = p[has[:, s], s][:, None], p[has[:, s]][:, right]
        sums[k] += ((own - others) ** 2 // (own + others)).sum(axis=0)
    for k, s in enumerate(right):
        own, others = p[has[:, s], s][:, None], least[left][None, :]
        sums[:, k] += ((own - others) ** 2 // (own + others) * ~has[has[:, s]][:, left]).sum(axis=0)
    many = has.sum(axis=0)
    both = has[:, left].T.astype(np.int64) @ has[:, right].astype(np.int64) if has.size else sums
    either = many[left][:, None] + many[right][None, :] - both
    i, j = np.indices(sums.shape).reshape(2, -1)
    a, b = names[left[i]], names[right[j]]
    once = (either.ravel() > 0) & ((low != high) | (left[i] < right[j]))
    swap = np.asarray(a > b)
    out = pd.DataFrame({"lang": lang, "source": np.where(swap, b, a), "item": np.where(swap, a, b), "part": sums.ravel(), "either": either.ravel()})
    return out[once]


def pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """shares: lang, source, digest, twin, p, least, n_sources, n_terms; groups: the same without digest, twin and p.

    One row per pair source < item that has terms.
    """
    n_tiles, n_blocks = F.ceil(F.col("n_sources") / SOURCES), F.ceil(F.col("n_terms") / TERMS)
    tile = F.pmod(F.xxhash64("source"), n_tiles).alias("side"), n_tiles.alias("tiles")
    dealt = shares.select("lang", "source", "digest", "twin", "p", "least", F.pmod("digest", n_blocks).alias("block"), *tile)
    everywhere = groups.where("n_terms > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    dealt = dealt.unionByName(everywhere.select("lang", "source", F.lit(0).cast("long").alias("digest"), F.lit(0).alias("twin"), F.lit(0).cast("long").alias("p"), "least", "block", *tile))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("lang", "block", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "source", "side", "digest", "twin", "p", "least")
    sums = dealt.groupBy("lang", "block", "low", "high").applyInPandas(tile_sums, "lang string, source string, item string, part long, either long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("part").alias("part"), F.sum("either").alias("either"))


def all_pairs(groups: DataFrame) -> DataFrame:
    """groups: lang, source, least, n_sources, n_terms. All source < item of a language, met tile by tile."""
    n_tiles = F.ceil(F.col("n_sources") / SOURCES)
    one = groups.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), n_tiles - 1)))
    other = groups.select("lang", F.col("source").alias("item"), F.col("least").alias("item_least"), F.pmod(F.xxhash64("source"), n_tiles).alias("tile"))
    return one.join(other, ["lang", "tile"]).where("source < item").select("lang", "source", "item", "least", "item_least", "n_terms")


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, digest_bits: int = 64) -> DataFrame:
    """docs: text, lang, source. Returns lang, source, part (pair, term), item, value, rank.

    digest_bits narrows the digests; any width gives the same rows, fewer bits only make more terms share one.
    """
    docs = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    mask = (1 << digest_bits) - 1
    partial = staged(docs.mapInArrow(partials(mask, False), PARTIAL), "divergence-partial")
    kept, in_source = counted(partial, min_docs, lambda: docs.mapInArrow(partials(mask, True), PARTIAL))
    langs = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n").alias("lang_total"))
    totals = in_source.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    occurring = staged(docs.select("lang", "source").distinct(), "divergence-groups")
    sizes = occurring.groupBy("lang").agg(F.count("*").alias("n_sources"))
    groups = occurring.join(sizes, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["n_terms", "lang_total", "total"])
    least = F.when(F.col("n_terms") > 0, share(F.lit(0), F.col("total"), F.col("n_terms")))
    groups = staged(groups.withColumn("least", least), "divergence-totals")
    shares = in_source.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("n_terms")))

    pairs = all_pairs(groups).join(pair_sums(shares, groups), ["lang", "source", "item"], "left").na.fill(0, ["part", "either"])
    absent = F.when(F.col("n_terms") > 0, (F.col("n_terms") - F.col("either")) * apart(F.col("least"), F.col("item_least"))).otherwise(0)
    ends = F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = pairs.select("lang", (F.col("part") + absent).alias("value"), F.inline(ends))
    by_item = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_item).alias("rank"))

    whole = kept.select(*KEY, F.col("n").alias("lang_n"))
    apart_terms = shares.join(whole, list(KEY)).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms")))
    apart_terms = apart_terms.where("p > q").select("lang", "source", "digest", "twin", apart(F.col("p"), F.col("q")).alias("value"))
    # ties at the last rank are decided by the strings, so all of them stay until these are joined
    first = apart_terms.withColumn("place", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("place") <= top)
    first = first.join(kept.select(*KEY, F.col("term").alias("item")), list(KEY)).withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top)
    return pairs.unionByName(first.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
occ AS (
  SELECT rn, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
docs AS (
  SELECT rn, lang, source, term, count(*) AS n FROM occ GROUP BY ALL),
kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM docs GROUP BY ALL HAVING count(*) >= 10),
langs AS (
  SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (
  SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM docs GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM cells GROUP BY ALL),
p AS (
  SELECT c.lang, c.source, c.term, c.n, 1 + 1000000000::HUGEINT * (c.n + 2) // (t.total + 2 * l.v) AS p,
    1 + 1000000000::HUGEINT * (c.lang_n + 2) // (l.total + 2 * l.v) AS q
  FROM cells c JOIN totals t USING (lang, source) JOIN langs l USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms)
WHERE rank <= 10
"""


@query("op11_source_divergence", SQL)
def op11_source_divergence(spark, sf_dir):
    """Distances of sources and the terms that set each apart, per language."""
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
