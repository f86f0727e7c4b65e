"""Near-duplicate documents: MinHash with tensored banding, exact verification, connected components.

Signature. Two collections of `HALVES` half keys, each half key made of `ROWS` minhashes. The table keys are all pairs of
a half key of the first and one of the second collection: HALVES squared keys from 2 * HALVES * ROWS minhashes, where keys
of their own would take HALVES squared * 2 * ROWS. Two sets of similarity s share a key with probability
(1 - (1 - s^ROWS)^HALVES)^2; at the threshold of 0.85 with the values below, 1 - 7e-5.

Classes. Documents with equal sets form a class, found by a digest of the set; only one document of each goes on, so a
group of copies, however large, costs one row per task.

Candidates. Never all pairs of a bucket. First every bucket is compared with one hub, the member with the largest buckets,
which in a group of copies is the text they come from. Links so found make components. The buckets of one hub are one bucket
from then on; if its other members are in one component it is done, since further links in it would change nothing. Of the documents in the remaining buckets, each
shingle's number of documents is counted; it is rare if at most `RARE` have it. Two documents that are linked either

* share a rare shingle. Then one is among the first few of both, the rarest first (the prefix filter: at least `percent` of
  either set is shared). Pairs are made on these shingles, each of which has at most RARE documents. Or they
* share frequent shingles only, and both have enough of these, given their sizes. Such members of a bucket are compared with
  further hubs, more in each round, over different components only, until a bucket is in one component or all its
  members have been hubs.

So no link between components is lost whatever a bucket's size, and documents that differ from all others in more than the
threshold allows, such as the distant copies of a popular text, are compared with the hub alone. Buckets with the same
members are one bucket.

Verification joins both full sets to each pair. Skewed hubs are split by the adaptive join. The texts of documents that
stand in no pair are read but not taken apart again, and nothing but the sets of documents in pairs is shuffled.

Defined results: documents without words (null, empty, white space) have an empty set and link with nothing; a null id
cannot name a component: its row is kept, in no component; rows repeated with one id get one result each and link by that
id, also where their texts differ (each text is then compared by a number of its own); ties in size or similarity have no effect, as the component is its smallest id; an empty table gives an empty result;
columns besides doc_id and text are left out of the result, whatever their names, and kept by `distinct_documents`. A very
long text is one row of a task and is taken apart whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm import words
from linewright.llm.registry import query
from linewright.llm.shared import staged

HALVES, ROWS = 8, 2
#: Ids that are sent to all tasks, at most; above it, the join shuffles.
MOST_SENT = 1_000_000
#: A shingle is rare if at most so many documents of those looked at have it.
RARE = 8
#: By how much the number of further hubs grows in each round.
GROWTH = 6

SIGNATURES = "doc_id long, n_shingles long, digest binary, halves array<long>"


def set_rows(n: int, halves: int | None, rows: int):
    """mapInArrow function: doc_id, text -> SIGNATURES, or doc_id and the sorted set if halves is None."""
    seeds = np.random.default_rng(20_240_229).integers(1, 1 << 63, (2 * (halves or 0) * rows, 2), dtype=np.int64).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in words.slices(batches, "text"):
            counts, flat = words.split(batch.column(1))
            codes, distinct = words.coded(flat)
            shingles, many = words.windows(words.hashes(distinct)[codes], counts, n)
            ends = np.cumsum(many)
            sets = [np.unique(shingles[a:b]) for a, b in zip(ends - many, ends, strict=True)]
            sizes = np.array([len(s) for s in sets], np.int64)
            ids = batch.column(0)
            if halves is None:
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                values = np.concatenate(sets).view(np.int64) if len(sets) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(values))], names=["doc_id", "set"])
                continue
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            full = np.flatnonzero(sizes)
            keys = np.zeros((len(sets), 2 * halves), np.uint64)
            if len(full):
                flat_sets = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for k, (a, b) in enumerate(seeds):
                    lowest = np.minimum.reduceat(words.mixed(flat_sets * (a | np.uint64(1)) + b), starts)
                    keys[full, k // rows] = words.mixed(keys[full, k // rows] * np.uint64(0x9E3779B97F4A7C15) + lowest)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * 2 * halves, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(digests, pa.binary()), lists], names=["doc_id", "n_shingles", "digest", "halves"])

    return run


def signatures(docs: DataFrame, n: int = 3, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(set_rows(n, halves, rows), SIGNATURES)


def buckets(classes: DataFrame, halves: int = HALVES) -> DataFrame:
    """bucket, rep, n: members of all table keys with two members or more; keys with equal members count once.

    classes: rep, n_shingles, halves.
    """
    keys = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(halves - 1)), lambda i: F.transform(F.sequence(F.lit(halves), F.lit(2 * halves - 1)), lambda j: F.xxhash64(i, j, F.get("halves", i), F.get("halves", j)))))
    members = classes.select("rep", F.col("n_shingles").cast("int").alias("n"), F.explode(keys).alias("bucket"))
    return one_of_equal(members)


def sent_or_shuffled(ids: DataFrame) -> DataFrame:
    """A table of ids with a hint to broadcast it if it has at most MOST_SENT rows. ids: a written table."""
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of the nodes of links a, b. A few written rounds of star contraction."""
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = staged(small.select("e.*").where("u <> v").distinct(), "edges")
        after = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def one_of_equal(rows: DataFrame) -> DataFrame:
    """The buckets of rows (bucket, rep, n) that have two members or more, one of those with the same members.

    The planner takes an exploded row for one element, so rows and what is counted from them look far smaller than they
    are. The kept buckets are written, to be sized by their files, and a semi join never sends its left side, the rows.
    """
    kept = (
        rows.groupBy("bucket")
        .agg(F.count("*").alias("size"), F.min("rep").alias("first"), F.max("rep").alias("last"), F.sum(F.xxhash64("rep") % (1 << 40)).alias("sum"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("xor"))
        .where("size > 1")
        .groupBy("size", "first", "last", "sum", "xor")
        .agg(F.min("bucket").alias("bucket"))
    )
    return rows.join(staged(kept.select("bucket"), "kept-buckets"), "bucket", "left_semi")


def with_links(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """Components after more links (a, b), and whether they differ from before. Only the components that these links join
    are gone through, not all links found so far. labels: node, component of all nodes but the smallest of each component."""
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("x"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("y"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    joined = staged(ends.where("a <> b").distinct(), "joined")
    if joined.isEmpty():
        return labels, False
    found = components(joined)
    moved = labels.join(found.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left")
    return staged(moved.select("node", F.coalesce("c", "component").alias("component")).unionByName(found), "labels"), True


def with_hubs(members: DataFrame) -> DataFrame:
    """members (bucket, rep, n) with hub and its size m, the member that has the largest buckets together (ties: the smallest id).

    The files of members are small for their rows where buckets are large, so all joins here are told to shuffle.
    """
    members = members.hint("merge")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    weights = members.join(sizes, "bucket").groupBy("rep").agg(F.sum("size").alias("weight"))
    hubs = members.join(weights, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("id"), "n")).alias("top"))
    return members.join(hubs, "bucket").select("bucket", "rep", "n", (-F.col("top.id")).alias("hub"), F.col("top.n").alias("m")).where("rep <> hub")


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs (rep, hub) whose full sets have 100 * intersection >= percent * union, as a written table."""
    a = sets.select(F.col("doc_id").alias("rep"), F.col("set").alias("a"))
    b = sets.select(F.col("doc_id").alias("hub"), F.col("set").alias("b"))
    both = pairs.join(a, "rep").join(b, "hub").withColumn("common", F.size(F.array_intersect("a", "b")))
    return staged(both.where(100 * F.col("common") >= percent * (F.size("a") + F.size("b") - F.col("common"))).select(F.col("rep").alias("a"), F.col("hub").alias("b")), "links")


def near_sizes(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with the component of rep."""
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def unsettled(members: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """The members of buckets over several components, with their component, as a written table."""
    marked = labelled(members, labels)
    mixed = marked.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least")).where("low <> high")
    return staged(marked.join(mixed.select("bucket", "least"), "bucket"), name)


def counted_shingles(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rep, n, component, frequent (number of shingles in more than RARE sets), prefix (the rare ones to look for), written.

    rest: rep, n, component, distinct.
    """
    held = rest.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("rep", F.explode("set").alias("shingle"))
    counts = held.groupBy("shingle").agg(F.count("*").alias("df"))
    rare = F.when(F.col("df") <= RARE, F.struct("df", "shingle"))
    per_rep = held.join(counts, "shingle").groupBy("rep").agg(F.count_if(F.col("df") > RARE).cast("int").alias("frequent"), F.array_sort(F.collect_list(rare)).alias("rare"))
    many = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1
    prefix = F.transform(F.filter(F.slice("rare", F.lit(1), many), lambda x: x["df"] > 1), lambda x: x["shingle"])
    return staged(rest.join(per_rep, "rep").select("rep", "n", "component", "frequent", prefix.alias("prefix")), "shingles")


def pairs_on_rare_shingles(counted: DataFrame, percent: int) -> DataFrame:
    """rep, hub over different components that have a rare shingle of both prefixes in common; each shingle has at most RARE.

    Both sides are exploded, which the planner sizes too low, so the join is told to shuffle.
    """
    x = counted.select(F.explode("prefix").alias("shingle"), "rep", "n", "component")
    y = x.select("shingle", F.col("rep").alias("hub"), F.col("n").alias("m"), F.col("component").alias("c"))
    return x.join(y.hint("merge"), "shingle").where((F.col("rep") > F.col("hub")) & (F.col("component") != F.col("c")) & near_sizes("n", "m", percent)).select("rep", "hub").distinct()


def pairs_with_hubs(members: DataFrame, first: int, last: int, percent: int) -> DataFrame:
    """rep, hub: members of each bucket with its hubs number first to last, over different components, as far as their
    frequent shingles may suffice. members: bucket, rep, n, component, frequent. Hubs are numbered by id in a bucket."""
    ranked = members.withColumn("no", F.row_number().over(Window.partitionBy("bucket").orderBy("rep"))).where(F.col("no") <= last)
    hubs = ranked.where(F.col("no") > first).select("bucket", F.col("rep").alias("hub"), F.col("n").alias("m"), F.col("component").alias("c"), F.col("frequent").alias("f"))
    enough = (100 + percent) * F.least("frequent", "f") >= percent * (F.col("n") + F.col("m"))
    met = members.join(hubs, "bucket").where((F.col("component") != F.col("c")) & near_sizes("n", "m", percent) & enough)
    return met.select(F.greatest("rep", "hub").alias("rep"), F.least("rep", "hub").alias("hub")).distinct()


def linked_reps(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """node, component of the reps that are linked with another. members: bucket, rep, n, written."""
    ids = staged(members.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    found = docs.select(F.col("doc_id").cast("long"), "text").join(sent_or_shuffled(ids), "doc_id", "left_semi")
    sets = staged(found.mapInArrow(set_rows(n, None, 0), "doc_id long, set array<long>").dropDuplicates(["doc_id"]), "sets")

    members = staged(with_hubs(members), "members")
    pairs = members.where(near_sizes("n", "m", percent)).select("rep", "hub").distinct()
    labels = components(linked_pairs(pairs, sets, percent))
    # the buckets of one hub are one bucket from here on, so that a pair that shares many of them is made once
    rest = unsettled(members.select(F.col("hub").alias("bucket"), "rep", "n").distinct(), labels, "unsettled")
    if rest.isEmpty():
        return labels
    counted = counted_shingles(rest.select("rep", "n", "component").distinct(), sets, percent)
    labels, _ = with_links(labels, linked_pairs(staged(pairs_on_rare_shingles(counted, percent), "pairs"), sets, percent))
    rest = rest.drop("component").join(counted.select("rep", "frequent"), "rep").where(F.col("frequent") * (100 + percent) >= percent * (F.col("n") + F.col("least")))
    done, changed = 0, True
    while True:
        if changed:
            rest = unsettled(rest.select("bucket", "rep", "n", "frequent"), labels, "unsettled")
        rest = rest.join(rest.groupBy("bucket").count().where(F.col("count") > done).select("bucket"), "bucket")
        if rest.isEmpty():
            return labels
        last = GROWTH * (done + 1)
        pairs = staged(pairs_with_hubs(rest, done, last, percent), "pairs")
        done, changed = last, False
        if not pairs.isEmpty():
            labels, changed = with_links(labels, linked_pairs(pairs, sets, percent))


def with_one_text_each(docs: DataFrame, signed: DataFrame, n: int, percent: int) -> DataFrame:
    """The result of `near_duplicates` where an id stands on unequal texts.

    Every (id, set) gets a number of its own and the numbers are compared like ids; then the numbers of one id are linked as
    well, and each component is named by its smallest id. Only here are texts shuffled, to give them their numbers.
    """
    pairs = signed.where("doc_id IS NOT NULL").select("doc_id", "digest", "n_shingles").distinct()
    numbered = staged(pairs.withColumn("number", F.monotonically_increasing_id()), "numbered")
    texts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(with_digest(n), "doc_id long, text string, digest binary")
    texts = staged(texts.join(numbered, ["doc_id", "digest"]).select(F.col("number").alias("doc_id"), "text"), "numbered-texts")
    found = staged(near_duplicates(texts, n, percent).distinct(), "numbered-components")
    of_texts = found.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    own = numbered.where("n_shingles > 0").withColumn("first", F.min("number").over(Window.partitionBy("doc_id")))
    labels = components(of_texts.unionByName(own.where("number <> first").select(F.col("number").alias("a"), F.col("first").alias("b"))))
    placed = numbered.join(labels.withColumnRenamed("node", "number"), "number", "left")
    placed = staged(placed.withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "number"))), "numbered-labels")
    named = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    result = placed.join(named, "component", "left").select("doc_id", "digest", "component_id")
    joined = signed.join(result, ["doc_id", "digest"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def with_digest(n: int):
    """mapInArrow function: doc_id, text -> the same with the digest of the set, as in SIGNATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            (signed,) = set_rows(n, HALVES, ROWS)(iter([batch]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed.column(2)], names=["doc_id", "text", "digest"])

    return run


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id, kept: one row per document."""
    signed = staged(signatures(docs, n), "signatures")
    several = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("low"), F.max(F.xxhash64("digest")).alias("high")).where("low <> high")
    if not several.isEmpty():
        return with_one_text_each(docs, signed, n, percent)
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves")), "classes")
    found = linked_reps(docs, staged(buckets(classes), "buckets"), n, percent)
    same = signed.join(classes.select("digest", "rep"), "digest", "left")
    joined = same.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with the columns of docs; of rows repeated with one id and text, one."""
    judged = staged(near_duplicates(docs, n, percent), "near-duplicates")
    gone = staged(judged.where("NOT kept").select("doc_id").distinct(), "gone")
    left = docs.join(sent_or_shuffled(gone), "doc_id", "left_anti")
    twice = staged(judged.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return left
    return left.join(sent_or_shuffled(twice), "doc_id", "left_anti").unionByName(left.join(sent_or_shuffled(twice), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


@query("op4_near_dedup")
def op4_near_dedup(spark, sf_dir):
    """Components of documents over links of at least 85 % of three-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)
