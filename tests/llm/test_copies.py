"""Near duplicates, repeated passages and contamination, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import cases
import pytest
from linewright.llm import decontamination, near_dedup, suffix_dedup


def shingles(text, n):
    w = cases.WORD.findall(cases.lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components_by_hand(rows, n, percent):
    sets = {i: shingles(t, n) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def chain(rng, steps, size=120):
    """Texts of which each is a near copy of the one before, while the first and the last are not."""
    w = cases.prose(rng, size, 5000).split()
    for k in range(steps):
        yield " ".join(w)
        at = (k * 11) % size
        w = [*w[:at], f"new{k}", *w[at + 1 :]]


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_components_like_brute_force(spark, n, percent):
    rng = random.Random(n)
    rows = cases.awkward()
    rows += [(1000 + k, t, "src0", "en") for k, t in enumerate(chain(rng, 40))]
    base = cases.prose(rng, 100, 5000).split()
    for k in range(60):  # a group of near copies around one text, many of them too far from each other
        changed = list(base)
        for j in rng.sample(range(100), 1 + k % 6):
            changed[j] = f"y{k}.{j}"
        rows.append((2000 + k, " ".join(changed), "src0", "en"))
    got = near_dedup.near_duplicates(cases.frame(spark, rows, extra=True), n, percent).collect()
    assert len(got) == len(rows)
    want = components_by_hand(rows, n, percent)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_one_document_of_each_component_stays(spark):
    rows = cases.awkward()
    docs = cases.frame(spark, rows, extra=True)
    left = near_dedup.distinct_documents(docs, 3, 85)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    want = components_by_hand(rows, 3, 85)
    assert ids == Counter({i: 1 for i in want if want[i][1] == i}) + Counter({None: 2})
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0 and near_dedup.distinct_documents(docs.limit(0)).count() == 0


def test_ids_on_unequal_texts(spark):
    """One id on two texts links what is near either; twice as many rows, empty ones, and ids that meet in a chain."""
    rng = random.Random(12)
    base = [cases.prose(rng, 60, 4000) for _ in range(8)]

    def near(k, j):
        words = base[k].split()
        words[j] = f"x{j}"
        return " ".join(words)

    rows = [(1, base[0]), (1, base[1]), (2, near(0, 5)), (3, near(1, 7)), (4, base[2]), (5, base[2]), (5, base[3]), (6, near(3, 9)), (7, base[4]), (8, base[5])]
    rows += [(9, base[6]), (9, ""), (9, None), (10, near(6, 3)), (10, near(6, 3)), (11, base[7]), (0, near(7, 2)), (None, base[0]), (12, ""), (11, near(5, 4))]
    rows = [(i, t, "s", "en") for i, t in rows]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 0, 10: 9, 11: 0, 0: 0, 12: 12, None: None, 9: 9}
    got = near_dedup.near_duplicates(cases.frame(spark, rows, extra=True), 3, 85).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    left = near_dedup.distinct_documents(cases.frame(spark, rows), 3, 85).collect()
    assert {r.doc_id for r in left} == {i for i, c in want.items() if c == i}


def test_buckets_are_looked_at_until_all_components_are_settled(spark):
    """Members of one bucket that are not linked with the first hubs are still compared with each other."""
    rng = random.Random(9)
    w = cases.prose(rng, 200, 9000).split()
    rows = []
    for k in range(14):  # pairwise about 0.7 apart, so that most share buckets, and each with one near copy
        changed = [x if rng.random() < 0.93 else f"z{k}.{i}" for i, x in enumerate(w)]
        rows.append((k, " ".join(changed), "s", "en"))
        rows.append((100 + k, " ".join([*changed, "tail"]), "s", "en"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(cases.frame(spark, rows), 3, 85).collect()}
    assert got == components_by_hand(rows, 3, 85)


def broadcasts(df):
    """For each broadcast that df's plan begins with, the operators below it."""
    depth, found = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        node = line.lstrip(" :+-")
        own = len(line) - len(node)
        depth = [(d, below) for d, below in depth if d < own]
        for _, below in depth:
            below.append(node.split(" ")[0])
        if node.startswith("BroadcastExchange"):
            depth.append((own, []))
            found.append(depth[-1][1])
    return found


def test_no_exploded_table_is_broadcast_on_an_estimate(spark):
    """The planner counts one element for each exploded row, and files that pack equal values are small for their rows:
    neither says how many rows would go to the driver."""
    rng = random.Random(9)
    w = cases.prose(rng, 200, 9000).split()
    rows = [(k, " ".join(x if rng.random() < 0.93 else f"z{k}.{i}" for i, x in enumerate(w)), "s", "en") for k in range(14)]
    signed = near_dedup.staged(near_dedup.signatures(cases.frame(spark, rows)).withColumnRenamed("doc_id", "rep"), "classes")
    found = near_dedup.buckets(signed)
    assert not any("Generate" in below for below in broadcasts(found))
    halves = {r.rep: r.halves for r in signed.collect()}
    keys = [frozenset(k for k, h in halves.items() if (h[i], h[j]) == pair) for i in range(8) for j in range(8, 16) for pair in {(h[i], h[j]) for h in halves.values()}]
    members = defaultdict(set)
    for r in found.collect():
        members[r.bucket].add(r.rep)
    assert Counter(map(frozenset, members.values())) == Counter({k: 1 for k in keys if len(k) > 1}) and members

    written = near_dedup.staged(found, "buckets")
    assert not broadcasts(near_dedup.with_hubs(written))
    counted = spark.createDataFrame([(1, 10, 1, 0, [5, 6]), (2, 10, 2, 0, [6, 7]), (3, 10, 2, 0, [7]), (4, 90, 4, 0, [5])], "rep long, n int, component long, frequent int, prefix array<long>")
    pairs = near_dedup.pairs_on_rare_shingles(near_dedup.staged(counted, "shingles"), 80)
    assert not broadcasts(pairs) and [tuple(r) for r in pairs.collect()] == [(2, 1)]


def passages_by_hand(rows, length):
    texts = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            texts[i].add(t or "")
    where = defaultdict(set)
    for i, all_texts in texts.items():
        for t in all_texts:
            w = cases.WORD.findall(t)
            for k in range(len(w) - length + 1):
                where[tuple(w[k : k + length])].add(i)
    found = set()
    for i, all_texts in texts.items():
        for t in all_texts:
            w = cases.WORD.findall(t)
            hit = [False] * len(w)
            for k in range(len(w) - length + 1):
                if len(where[tuple(w[k : k + length])]) > 1:
                    hit[k : k + length] = [True] * length
            k = 0
            while k < len(w):
                j = k
                while j < len(w) and hit[j]:
                    j += 1
                if j > k:
                    found.add((i, k, j - k))
                k = max(j, k + 1)
    return found


@pytest.mark.parametrize("partitions", ["2", "13"])
def test_passages_like_brute_force(spark, partitions):
    rng = random.Random(2)
    rows = cases.awkward()
    for length in (49, 50, 51, 80, 200):
        passage = cases.prose(rng, length, 9000)
        for k in range(40 if length == 80 else 3):
            rows.append((5000 + 100 * length + k, f"{cases.prose(rng, rng.randrange(90), 9000)} {passage} {cases.prose(rng, rng.randrange(90), 9000)}", "s", "en"))
    shared = cases.prose(rng, 120, 9000).split()
    for k in range(8):  # the same passage cut at different places
        rows.append((90000 + k, " ".join([cases.prose(rng, 20, 9000), *shared[7 * k : 7 * k + 62], cases.prose(rng, 20, 9000)]), "s", "en"))
    rows.append((91000, "again and " * 300, "s", "en"))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {tuple(r) for r in suffix_dedup.repeated_passages(cases.frame(spark, rows, extra=True)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == passages_by_hand(rows, 50)


def test_passages_of_empty_tables_and_their_texts(spark):
    docs = cases.frame(spark, cases.awkward())
    assert suffix_dedup.repeated_passages(docs.limit(0)).count() == 0
    found = suffix_dedup.repeated_passages(docs.where("doc_id IN (0, 100)"))
    texts = {r.doc_id: r.passage for r in suffix_dedup.passage_texts(docs, found).collect()}
    assert texts == {0: cases.awkward()[0][1], 100: cases.awkward()[0][1]}


ITEMS = [(1, "The quick, brown fox! jumps"), (2, " ".join(f"q{i}" for i in range(30))), (3, None), (4, "..."), (5, "the QUICK brown fox jumps"), (None, "nobody knows"), (2, "second text of two")]


def contamination_by_hand(text, n=13):
    def cut(t):
        return decontamination.WORD.findall(cases.lower(t))

    found = defaultdict(set)
    for i, t in ITEMS:
        w = cut(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            found[tuple(w[k : k + n])].add(i)
    w, hit, items = cut(text), set(), set()
    for k in range(len(w)):
        for size in {len(f) for f in found}:
            if tuple(w[k : k + size]) in found and k + size <= len(w):
                hit |= set(range(k, k + size))
                items |= found[tuple(w[k : k + size])]
    items.discard(None)
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_like_brute_force(spark):
    q = [f"q{i}" for i in range(30)]
    rows = cases.awkward() + [
        (500, "x the quick brown FOX jumps y", "s", "en"),
        (501, "x " + "-".join(q[3:16]) + "; then " + " ".join(q[10:22]) + " q0", "s", "en"),
        (502, "x " * 500 + "Nobody  knows", "s", "en"),
        (503, "second text of two two second text of two", "s", "en"),
        (504, "Ünder the quick brown fox jumpsé", "s", "en"),
    ]
    docs = cases.frame(spark, rows, extra=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("more", cases_lit("x"))
    got = decontamination.scanned(docs, items).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter((i, *contamination_by_hand(t)) for i, t, *_ in rows)
    text = {i: t for i, t, *_ in rows}
    spans = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.spans] for r in got if r.doc_id in (500, 502)}
    assert spans == {500: ["the quick brown FOX jumps"], 502: ["Nobody  knows"]}
    clean = decontamination.clean_documents(docs, items)
    assert clean.columns == docs.columns and Counter(r.doc_id for r in clean.collect()) == Counter(i for i, t, *_ in rows if not contamination_by_hand(t)[-1])


def cases_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_contamination_of_empty_tables_and_too_large_benchmarks(spark, monkeypatch):
    docs, items = cases.frame(spark, cases.awkward()), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.scanned(docs.limit(0), items).count() == 0
    assert decontamination.scanned(docs, items.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    monkeypatch.setattr(decontamination, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        decontamination.scanned(docs, items)
