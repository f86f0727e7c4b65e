"""Files as they are found: images of any type, quoted logs, several sidecars, split label files."""

import struct
from collections import Counter

from linewright.functions.text import pct, round_n, sample_id
from linewright.operators import charset
from linewright.operators.predict import batch_predict
from linewright.operators.scoring import aggregate_scores, score_rows
from linewright.plans import consolidate
from linewright.plans.evaluate import evaluate, record
from linewright.sinks.runs import metrics_append
from linewright.sources import images, labels, records
from linewright.sources.lines import number_lines
from pyspark.sql import functions as F

PNG = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + struct.pack(">II", 90, 40) + b"rest"


def exports(tmp_path):
    folder = tmp_path / "raw" / "batch_1"
    (folder / "labels").mkdir(parents=True)
    (folder / "images").mkdir()
    for name, content in {"a.png": PNG, "b.jpg": b"jpeg", "c.PNG": PNG, "d e.png": b"no png"}.items():
        (folder / "images" / name).write_bytes(content)
    names = ["./images/a.png", "images//b.jpg", "images/c.PNG", "images/d e.png", "images/gone.png"]
    (folder / "labels" / "train.txt").write_text("".join(f"{n}\ttext of {i}\n" for i, n in enumerate(names)))
    return str(tmp_path / "raw")


def test_images_of_any_type_exist(spark, tmp_path):
    raw = exports(tmp_path)
    rows = {r["rel_path"]: (r["has_image"], r["height"]) for r in consolidate.read_raw_labels(spark, raw).collect()}
    assert rows == {"./images/a.png": (True, 40), "images//b.jpg": (True, None), "images/c.PNG": (True, 40), "images/d e.png": (True, None), "images/gone.png": (False, None)}
    inventory = spark.createDataFrame([(f"{raw}/batch_1/images/gone.png", 7), (f"{raw}/batch_1/./images/a.png", 9)], "path string, height int")
    rows = {r["rel_path"]: (r["has_image"], r["height"]) for r in consolidate.read_raw_labels(spark, raw, inventory=inventory).collect()}
    assert rows["images/gone.png"] == (True, 7) and rows["./images/a.png"] == (True, 9) and rows["images//b.jpg"] == (False, None)
    plan = images.image_dims(spark, raw)._jdf.queryExecution().executedPlan().toString()
    assert "file_listing" in plan and "content#" not in plan


def test_line_numbers_of_a_split_in_several_files(spark, tmp_path):
    for split, files in {"train": 3, "test": 1}.items():
        folder = tmp_path / "labels" / f"split={split}"
        folder.mkdir(parents=True)
        for k in range(files):
            (folder / f"part-{k}.txt").write_text("".join(f"i{k}.{j}\tt\n" for j in range(5)))
    lines = labels.read_split_lines(spark, str(tmp_path), ("train",))
    assert all("split=train" in f for f in lines.inputFiles())
    numbered = number_lines(lines, "split").orderBy("line_no").collect()
    assert [(r["line_no"], r["value"]) for r in numbered] == [(5 * k + j + 1, f"i{k}.{j}\tt") for k in range(3) for j in range(5)]


def test_logs_with_quotes(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.csv").write_text('model,split,n,timestamp\n"a ""b"", c",test,3,2024-01-02T00:00:00\n')
    rows = spark.createDataFrame([('x "y", z', "val", "4", "2024-01-01T00:00:00")], "model string, split string, n string, timestamp string")
    metrics_append(rows, str(tmp_path / "log"))
    read = records.read_metrics_log(spark, str(tmp_path / "log")).orderBy("log_ord").collect()
    assert [(r["model"], r["split"], r["n"]) for r in read] == [('x "y", z', "val", "4"), ('a "b", c', "test", "3")]


def test_recorded_runs_keep_their_sidecars(spark, tmp_path):
    scored = evaluate(spark.createDataFrame([(1, "a", "A")], "id int, path string, gt string"), str.upper)
    kind = "struct<model_kind: string, ckpt_prefix: string, dict_path: string, rec_config: string, checkpoint_integrity: struct<ckpt_prefix: string, missing_by_component: map<string, long>, shape_mismatch_by_component: map<string, long>>>"
    provenance = spark.createDataFrame([(("tesseract", None, None, None, None),)], f"provenance {kind}")
    meta, log = str(tmp_path / "meta"), str(tmp_path / "log")
    for model in ("one", "two"):
        record(scored, model, "test", str(tmp_path / model), log, provenance, meta)
    sidecars = records.read_sidecars(spark, f"{meta}/*").collect()
    assert {(r["model"], r["metrics"]["n"], r["phantom"]) for r in sidecars} == {("one", 1, "n/a"), ("two", 1, "n/a")}
    logged = records.read_metrics_log(spark, log).collect()
    assert all((tmp_path / "meta" / r["meta_path"].rsplit("/", 1)[1]).is_dir() for r in logged) and len(logged) == 2


def test_batched_recogniser(spark):
    calls = spark.sparkContext.accumulator(0)

    def recognise(paths):
        calls.add(1)
        if "bad" in paths:
            raise OSError("bad")
        return [None if p == "none" else p.upper() for p in paths]

    def answers(values):
        rows = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "id int, path string, gt string").coalesce(1)
        return [(r["pred"], r["failed"]) for r in batch_predict(rows, recognise, batched=True).orderBy("id").collect()]

    assert answers(["a", "none", "b"]) == [("A", False), ("", True), ("B", False)]
    assert calls.value == 1
    assert answers(["a", "bad", "b"]) == [("A", False), ("", True), ("B", False)]
    single = spark.createDataFrame([(1, "a", "x")], "id int, path string, gt string")
    assert batch_predict(single, lambda v: None).first()["failed"]


def test_lost_predictions_count(spark):
    rows = spark.createDataFrame([(None, "abcd"), ("abcd", "abcd")], "pred string, gt string")
    assert aggregate_scores(score_rows(rows), []).first().asDict()["cer"] == 0.5


def test_numbers_and_paths_at_the_edges(spark):
    row = spark.range(1).select(
        round_n(F.lit(float("inf")), 4).alias("inf"), pct(F.lit("Infinity")).alias("pct"), round_n(F.lit(0.12345), 4).alias("plain"),
        sample_id(F.lit("a/b.")).alias("dot"), sample_id(F.lit("a/b.png")).alias("png"),
    ).first()
    assert row["inf"] == float("inf") and row["pct"] == "—" and row["plain"] == 0.1235 and row["dot"] == "b." and row["png"] == "b"


def test_first_seen_characters_are_not_sorted_one_by_one(spark):
    rows = [("d1", 0, 5, "hello"), ("d0", 1, 9, "élo o"), ("d0", 1, 3, "oh"), ("d1", 0, 6, None), ("d1", 0, 7, "")]
    df = spark.createDataFrame(rows, "dir_name string, split_ord int, line_no long, text string")
    counts = charset.char_counts(df, order=["dir_name", "split_ord", "line_no"])
    got = {r["ch"]: (r["n"], tuple(r["first_seen"])) for r in counts.collect()}
    want_n = Counter(c for *_, t in rows for c in t or "")
    want_at = {c: min((d, s, n, t.index(c)) for d, s, n, t in rows if t and c in t) for c in want_n}
    assert got == {c: (want_n[c], want_at[c]) for c in want_n}
    plan = counts._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = {i: len(line) - len(line.lstrip(" :+-")) for i, line in enumerate(plan)}
    for i, line in enumerate(plan):
        if "Generate explode" in line:
            above = [k for k in range(i) if depth[k] < depth[i]][-4:]
            assert not any("Sort" in plan[k] for k in above[-2:])

