"""Distances with a limit, repeated pairs scored once, recognisers made once per worker, first positions without a join."""

import os
import random
import time
from datetime import datetime

import pytest
from linewright.functions import distance, pair_edits, text
from linewright.operators import charset, predict, scoring
from linewright.sources import images
from pyspark.resource import ResourceProfileBuilder
from pyspark.sql import functions as F


def edits_by_table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (x != y)))
        row = left
    return row[-1]


def changed(rng, tokens, n, alphabet):
    tokens = list(tokens)
    for _ in range(n):
        k = rng.randrange(len(tokens) + 1)
        tokens[k : k + rng.randrange(2)] = [rng.choice(alphabet)] * rng.randrange(2)
    return tokens


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "aé语😀"])
def test_distances_of_random_pairs(alphabet):
    """Near and unlike pairs, by each way and with every kind of limit."""
    rng = random.Random(alphabet)
    for t in range(1500):
        a = [rng.choice(alphabet) for _ in range(rng.randrange(40))]
        b = changed(rng, a, rng.randrange(6), alphabet) if t % 2 else [rng.choice(alphabet) for _ in range(rng.randrange(40))]
        if t % 3:
            a, b = "".join(a), "".join(b)
        want = edits_by_table(a, b)
        assert distance.sequence_edits(a, b) == want
        if a and b:
            assert distance._edits_by_diagonals(a, b, 80) == distance._edits_by_columns(a, b, 80) == want
        for most in {0, 1, max(0, want - 1), want, want + 1, 100}:
            assert distance.edits_within(a, b, most) == (want if want <= most else None)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "aé語😀xyz"])
def test_many_pairs_at_once(alphabet):
    """Sizes around the machine word, near and unlike pairs, empty sides, pairs that are too long to go together."""
    rng = random.Random(alphabet)
    sizes = [0, 1, 2, 5, 20, 63, 64, 65, 100, 127, 128, 129, 200, 256, 257, 300]
    pairs = []
    for t in range(2000):
        a = "".join(rng.choice(alphabet) for _ in range(rng.choice(sizes)))
        b = changed(rng, a, rng.randrange(12), alphabet) if t % 3 else [rng.choice(alphabet) for _ in range(rng.choice(sizes))]
        pairs.append((a, "".join(b)))
    got = pair_edits.edits_of_pairs(*pair_edits.of_texts([a for a, _ in pairs]), *pair_edits.of_texts([b for _, b in pairs]), distance.sequence_edits)
    assert got.tolist() == [distance._edits_by_columns(a, b, 10_000) if a and b else len(a) + len(b) for a, b in pairs]
    words = [(a.split("a"), b.split("a")) for a, b in pairs]
    got = pair_edits.edits_of_pairs(*split_numbers(words), distance.sequence_edits)
    assert got.tolist() == [distance._edits_by_columns(a, b, 10_000) for a, b in words]
    assert pair_edits.edits_of_pairs(*pair_edits.of_texts([]), *pair_edits.of_texts([]), distance.sequence_edits).tolist() == []


def split_numbers(pairs):
    numbers, sizes = pair_edits.of_words([a for a, _ in pairs] + [b for _, b in pairs])
    cut = int(sizes[: len(pairs)].sum())
    return numbers[:cut], sizes[: len(pairs)], numbers[cut:], sizes[len(pairs) :]


def test_long_near_pairs_are_cheap():
    """20,000 words with 30 edits: far below one column per word; unlike texts are given up early."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    near = changed(rng, words, 30, ["x", "y", "z"])

    def seconds(run):
        start = time.perf_counter()
        run()
        return time.perf_counter() - start

    assert distance.sequence_edits(words, near) == distance._edits_by_columns(words, near, 30_000) <= 30
    columns = min(seconds(lambda: distance._edits_by_columns(words, near, 30_000)) for _ in range(2))
    assert min(seconds(lambda: distance.sequence_edits(words, near)) for _ in range(3)) < columns / 3
    unlike = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    assert distance.edits_within(words, unlike, 2000) is None
    assert min(seconds(lambda: distance.edits_within(words, unlike, 2000)) for _ in range(3)) < columns / 3


def pair_rows(rng, n=300):
    alphabet = "abc dé"
    rows = []
    for k in range(n):
        gt = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 20, 40, 400])))
        pred = "".join(changed(rng, gt, rng.randrange(5), alphabet)) if k % 3 else gt
        if k % 7 == 0:
            pred = pred.replace("é", "é")
        rows.append((f"m{k % 2}", pred, gt))
    rows += [("m0", None, "abc"), ("m0", "abc", None), ("m0", None, None), ("m1", "", ""), ("m1", "x", ""), ("m1", "", "x")]
    return rows + rows[:40] * 3


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(pair_rows(random.Random(5)), "model string, pred string, gt string").repartition(3).persist()


@pytest.mark.parametrize("threshold", [0.1, 0.0, 0.25, 1.0, 1.5])
def test_limits_like_whole_rates(pairs, threshold):
    want = {r.model: tuple(r)[1:] for r in scoring.perfect_counts(scoring.score_rows(pairs), ["model"], threshold).collect()}
    assert {r.model: tuple(r)[1:] for r in scoring.limit_counts(pairs, ["model"], threshold).collect()} == want
    distinct = scoring.distinct_pairs(pairs, ["model"])
    assert {r.model: tuple(r)[1:] for r in scoring.limit_counts(distinct, ["model"], threshold, "weight").collect()} == want
    plan = scoring.limit_counts(pairs, ["model"], threshold)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein(pred" in plan and "Some(" in plan.split("levenshtein(pred", 1)[1][:2000]


def test_weighted_aggregates_like_rows(spark, pairs):
    distinct = scoring.distinct_pairs(pairs, ["model"])
    assert distinct.agg(F.sum("weight")).first()[0] == pairs.count() > distinct.count()
    rows, once = scoring.score_rows(pairs), scoring.score_rows(distinct)

    def got(df):
        return {tuple(r) for r in df.collect()}

    assert got(scoring.aggregate_scores(once, ["model"], "weight")) == got(scoring.aggregate_scores(rows, ["model"]))
    assert got(scoring.macro_rates(once, ["model"], "weight")) == got(scoring.macro_rates(rows, ["model"]))
    assert got(scoring.macro_der(once, ["model"], "weight")) == got(scoring.macro_der(rows, ["model"]))
    assert got(scoring.median_errors(once, ["model"], "weight")) == got(scoring.median_errors(rows, ["model"]))
    none = scoring.score_rows(scoring.distinct_pairs(pairs.limit(0), []))
    assert scoring.aggregate_scores(none, [], "weight").first()["n"] == 0
    plan = scoring.aggregate_scores(once, ["model"], "weight")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("hashpartitioning(") :]
    assert "partial_count" in below and "char_errors" not in below  # combined before the shuffle, scored behind it


def test_recogniser_is_made_once_per_worker(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()
    rows = spark.createDataFrame([(i, f"v{i}", "x") for i in range(200)], "id int, path string, gt string").repartition(20)

    def factory():
        with open(made / str(os.getpid()), "a") as file:
            file.write("x")
        return lambda values: [f"{v}@{os.getpid()}" for v in values]

    got = predict.batch_predict(rows, factory=factory, batched=True, batch=7).collect()
    assert sorted(r.pred.split("@")[0] for r in got) == sorted(f"v{i}" for i in range(200)) and not any(r.failed for r in got)
    used = {r.pred.split("@")[1] for r in got}
    assert {p.name for p in made.iterdir()} == used and all(p.read_text() == "x" for p in made.iterdir())
    assert len(used) < 20

    def broken():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        predict.batch_predict(rows, factory=broken).collect()
    with pytest.raises(ValueError):
        predict.batch_predict(rows)


def test_recogniser_gets_bytes(spark, tmp_path):
    for name, body in {"a b.png": b"\x00one", "c.png": b"two", "bad.png": b"bad"}.items():
        (tmp_path / name).write_bytes(body)
    listing = images.image_listing(spark, str(tmp_path))
    gone = spark.createDataFrame([("gone", (tmp_path / "gone.png").as_uri(), 0)], "path string, uri string, size long")
    rows = listing.unionByName(gone).select(F.element_at(F.split("path", "/"), -1).alias("id"), "uri", F.lit("x").alias("gt"))

    def recognise(values):
        if b"bad" in values:
            raise OSError
        return [v.decode().strip("\x00") for v in values]

    want = {"a b.png": ("one", False), "c.png": ("two", False), "bad.png": ("", True), "gone": ("", True)}
    assert {r.id: (r.pred, r.failed) for r in predict.batch_predict(rows, recognise, "uri", batched=True, read=True).collect()} == want
    held = images.with_contents(listing).select("path", "content", F.lit("x").alias("gt"))
    assert {r.pred for r in predict.batch_predict(held, lambda v: v.hex(), "content").collect()} == {b"\x00one".hex(), b"two".hex(), b"bad".hex()}


def test_recogniser_asks_for_its_resources(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", "x")], "id int, path string, gt string")
    asked = []
    monkeypatch.setattr(type(rows), "mapInPandas", lambda self, run, schema, barrier=False, profile=None: asked.append(profile))
    profile = ResourceProfileBuilder().build
    predict.batch_predict(rows, str.upper, resources=profile)
    assert asked == [profile]


def test_first_positions_need_no_second_look(spark):
    """One exchange per aggregation and none under the texts; nulls, negative and very large numbers keep their order."""
    rng = random.Random(9)
    rows = [(f"d{rng.randrange(3)}", rng.randrange(2), n, "".join(rng.choice("abcdeé語😀") for _ in range(rng.randrange(12)))) for n in [*range(-40, 40), 1 << 61, -(1 << 61)]]
    df = spark.createDataFrame(rows, "dir_name string, split_ord int, line_no long, text string").repartition(3)
    counts = charset.char_counts(df, by=["split_ord"], order=["dir_name", "split_ord", "line_no"])
    want = {}
    for d, s, n, t in rows:
        for pos, c in reversed(list(enumerate(t))):
            want[s, c] = min(want.get((s, c), ("~",)), (d, s, n, pos))
    assert {(r.split_ord, r.ch): tuple(r.first_seen) for r in counts.collect()} == want
    stored = spark.read.parquet(written(df))
    plan = charset.char_counts(stored, order=["dir_name", "split_ord", "line_no"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2 and plan.count("FileScan") == 1
    assert "SortAggregate" not in plan[plan.rindex("Exchange") :]


def written(df):
    path = f"{df.sparkSession.conf.get('spark.checkpoint.dir')}/first-positions"
    df.write.mode("overwrite").parquet(path)
    return path


def test_timestamp_lies_within_the_query(spark):
    before = datetime.now().astimezone()
    stamp = spark.range(1).select(text.utc_timestamp().alias("t")).first().t
    assert before <= datetime.fromisoformat(stamp) <= datetime.now().astimezone() and stamp.endswith("Z")
