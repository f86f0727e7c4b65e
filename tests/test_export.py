import hashlib
import json
import random

from pyspark.sql import functions as F

from linewright.operators import export, sampling
from linewright.sinks.corpus import chat_sink


def lines(spark):
    rows = [
        ("test", 1, "images/test/b1.png", 'ẹ̀ "x"\\', True),
        ("test", 2, None, None, True),
        ("test", 3, "images/test/gone.png", "t", False),
        ("test", 4, "images\\test\\a.v1.png", "}", True),
        ("train", 1, "images/train/z.png", "", True),
    ]
    return spark.createDataFrame(rows, "split string, line_no long, rel_path string, text string, has_image boolean")


def test_records_and_manifest(spark, tmp_path):
    data = lines(spark)
    samples = export.chat_samples(data, "/repo/data", "/repo", "Read: \"it\"")
    chat_sink(samples, str(tmp_path / "out"))
    written = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out" / "split=test")).collect()]
    assert written[0] == {
        "id": "b1",
        "source_relative": "images/test/b1.png",
        "source_image": "data/images/test/b1.png",
        "messages": [
            {"role": "user", "content": [{"type": "image", "image": "data/images/test/b1.png"}, {"type": "text", "text": "Read: \"it\""}]},
            {"role": "assistant", "content": 'ẹ̀ "x"\\'},
        ],
    }
    assert written[1]["source_relative"] == "images/test/a.v1.png" and written[1]["messages"][1]["content"] == "}"
    skipped = [tuple(r) for r in export.skipped_lines(data).orderBy("line").collect()]
    assert skipped == [("test", 2, "not_two_tab_fields", None), ("test", 3, "missing_image", "images/test/gone.png")]
    manifest = {r["split"]: r for r in export.export_manifest(data, samples).collect()}
    assert (manifest["test"]["exported"], manifest["test"]["skipped_malformed"], manifest["test"]["skipped_missing_image"]) == (2, 1, 1)
    assert manifest["train"]["ids_tree_sha256"] == tree_digest({1: "z"})
    assert manifest["test"]["ids_sha256"] == hashlib.sha256("\n".join(w["id"] for w in written).encode()).hexdigest()
    longer = {r["split"]: r["ids_sha256"] for r in export.export_manifest(data, samples, most=1).collect()}
    assert longer == {"test": None, "train": hashlib.sha256(b"z").hexdigest()}


def tree_digest(parts):
    for _ in range(export.LEVELS):
        runs = {}
        for no in sorted(parts):
            runs.setdefault(no // export.FAN_IN, []).append(parts[no])
        parts = {run: hashlib.sha256("\n".join(p).encode()).hexdigest() for run, p in runs.items()}
    return parts[0]


def test_id_digest_keeps_order(spark):
    ids = [("a", i, f"id{i}") for i in range(5000)] + [("b", 1, "x")] + [("c", i * 10**13, f"{i}") for i in range(50)]
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame(ids, "split string, line_no long, id string").repartition(13)
    flat = {r["split"]: r["ids_sha256"] for r in export.ids_digest(df, 4999).collect()}
    assert flat == {s: None if s == "a" else hashlib.sha256("\n".join(i for t, n, i in sorted(ids) if t == s).encode()).hexdigest() for s in "abc"}
    got = {r["split"]: r["ids_tree_sha256"] for r in export.ids_tree_digest(df).collect()}
    assert got == {s: tree_digest({n: i for t, n, i in ids if t == s}) for s in "abc"}
    swapped = df.withColumn("line_no", F.expr("case line_no when 1 then 2 when 2 then 1 else line_no end"))
    assert {r["split"]: r["ids_tree_sha256"] for r in export.ids_tree_digest(swapped).collect()}["a"] != got["a"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Coalesce 1" not in plan


def test_id_digest_of_a_large_split(spark):
    """More ids than one batch, one partition or any limit; missing ids are left out, repeated ones stay."""
    n = export.FLAT + 5000
    rows = spark.range(n).select(F.expr("if(id % 7 = 0, 'b', if(id % 11 = 0, null, 'a'))").alias("split"), (-F.col("id")).alias("line_no"),
                                 F.expr("if(id % 1000 = 3, null, concat('id', id div 2))").alias("id"))
    twice = rows.unionByName(rows.where("line_no > -30000").withColumns({"split": F.lit("twice"), "line_no": F.lit(1).cast("long"), "id": F.expr("if(id = 'id1', 'id0', 'id1')")}))
    want = {}
    for split, no, i in sorted(((r.split, r.line_no, r.id) for r in twice.collect()), key=lambda r: (str(r[0]), r[1], r[2] or "")):
        want.setdefault(split, []).extend([] if i is None else [i])
    got = {r.split: r.ids_sha256 for r in export.ids_digest(twice.repartition(7)).collect()}
    assert got == {s: hashlib.sha256("\n".join(ids).encode()).hexdigest() for s, ids in want.items()}
    assert len(want["a"]) > 80_000 and set(want) == {"a", "b", None, "twice"}


def test_fraction_samples_are_exact_and_repeatable(spark):
    rows = spark.range(1001).repartition(5)
    for fraction in (0.25, 0.5, 0.75, 1.0, 0.0001):
        ids = [r["id"] for r in sampling.fraction_sample(rows, "id", fraction, 42).collect()]
        assert len(ids) == len(set(ids)) == max(1, int(1001 * fraction))
        again = sampling.fraction_sample(spark.range(1001), "id", fraction, 42)
        assert sorted(ids) == sorted(r["id"] for r in again.collect())
        order = sorted(range(1001), key=lambda i: (hashlib.md5(f"42{i}".encode()).hexdigest(), i))
        assert set(ids) == set(order[: len(ids)])
    assert sampling.n_sample(rows, "id", 5000, 1).count() == 1001
    assert sampling.first_rows(rows, ["id"], None).count() == 1001
    assert [r["id"] for r in sampling.first_rows(rows, ["id"], 2).collect()] == [0, 1]
