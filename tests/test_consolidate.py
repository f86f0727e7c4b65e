import struct
from pathlib import Path

from pyspark.sql import functions as F

from linewright.operators import charset, hygiene
from linewright.operators.audit import inventory, leaks
from linewright.operators.hygiene import Limits
from linewright.plans import consolidate as plan
from linewright.plans import profile
from linewright.sources import labels as source
from linewright.sources.images import image_dims
from linewright.sources.lines import number_lines, read_lines


def png(path: Path, width: int, height: int) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", width, height, 8, 2, 0, 0, 0))


def export(root: Path, name: str, split: str, rows: list[str], images: dict[str, int]) -> None:
    folder = root / name / "labels"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{split}.txt").write_bytes("".join(rows).encode())
    for image, height in images.items():
        png(root / name / "images" / image, 300, height)


def make_exports(root: Path) -> None:
    export(root, "batch_ocr_2", "train",
           ["images/a.png\tbàbá mi\n", "images/b.png\tthe old\n", "\n", "no tab here\n", "images/k.png\tìwé kan\n"],
           {"a.png": 50, "b.png": 50, "k.png": 50})
    export(root, "batch_ocr_10 (Unzipped + Files)", "train",
           ["images/a.png\tthe new\r\n", "images/b.png\telé mi\r", "images/tall.png\tilé gíga\n", "images/none.png\tilé\n"],
           {"a.png": 50, "b.png": 50, "tall.png": 181})
    export(root, "batch_ocr_10 (Unzipped + Files)", "val",
           ["images/b.png\tlater\n", "images/short.png\tab\n", "images/long.png\t" + "a" * 101 + "\n", "images/odd.png\tilé…\n"],
           {"b.png": 50, "short.png": 50, "long.png": 50, "odd.png": 50})
    export(root, "batch_ocr_10_more", "test", ["images/b.png\tẹ̀dà kan\n", "images/broken.png\tilé wa\n"], {"b.png": 50})
    (root / "batch_ocr_10_more" / "images" / "broken.png").write_bytes(b"not an image")
    export(root, "notes", "train", ["images/z.png\tilé\n"], {"z.png": 50})


def test_whole_run(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    make_exports(raw)
    plan.run(spark, str(raw), str(out), str(tmp_path / "report"))
    rows = source.parse_labels(source.read_split_lines(spark, str(out)))
    got = {(r["split"], r["rel_path"], r["text"]) for r in rows.collect()}
    assert got == {
        ("train", "images/train/a.png", "bàbá mi"),  # the newer label is not valid, the older one stays
        ("train", "images/train/b.png", "elé mi"),  # among equal ids the first in reading order
        ("train", "images/train/k.png", "ìwé kan"),
        ("test", "images/test/broken.png", "ilé wa"),  # an unreadable image keeps its row
    }
    chars = [r["value"] for r in spark.read.text(str(out / "dictionary")).collect()]
    assert chars == sorted(set("bàbá mielé miìwé kanilé wa") - {" "})
    report = spark.read.json(str(tmp_path / "report")).first()
    assert report["unique_images_total"] == 4 and report["export_ids"] == [2, 10]
    assert report["hygiene"]["drop_counts"].asDict() == {
        "missing_image": 1, "invalid_yoruba": 2, "label_too_short": 1, "label_too_long": 1,
        "non_whitelisted_codepoint": 1, "image_too_tall": 1,
    }


def test_rows_stay_in_file_name_order(spark, tmp_path):
    from linewright.sinks.corpus import label_sink

    rows = [("train", f"p{i:03d}.png", "x") for i in range(200)]
    label_sink(spark.createDataFrame(rows, "split string, file_name string, text string").repartition(7), str(tmp_path))
    parts = sorted((tmp_path / "labels" / "split=train").glob("part-*"))
    lines = [line.split("\t")[0] for part in parts for line in part.read_text().splitlines()]
    assert lines == [f"images/train/p{i:03d}.png" for i in range(200)]


def test_hygiene_off_still_checks_validity(spark):
    rows = [("ab", True, 500), ("the", True, 50), ("x" * 200, True, 50), ("ilé", False, 50), ("ilé", True, None)]
    df = spark.createDataFrame(rows, "text string, has_image boolean, height int")
    reasons = [r["reason"] for r in hygiene.with_reason(df, Limits(hygiene=False)).collect()]
    assert reasons == [None, "invalid_yoruba", "invalid_yoruba", "missing_image", None]
    assert [r["reason"] for r in hygiene.with_reason(df, Limits(max_height=0, strict_charset=False)).collect()][0] == "label_too_short"
    assert hygiene.height_unknown(df).first()[0] == 1


def test_line_numbers_cross_blocks(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"line {i}\n" if i % 50 else "\n" for i in range(1, 5001)))
    (tmp_path / "other.txt").write_text("a\rb\r\nc")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = number_lines(read_lines(spark, [str(path), str(tmp_path / "other.txt")])).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    numbered = {r["line_no"]: r["value"] for r in rows if r["file_path"].endswith("long.txt")}
    assert numbered == {i: (f"line {i}" if i % 50 else "") for i in range(1, 5001)}
    assert sorted((r["line_no"], r["value"]) for r in rows if r["file_path"].endswith("other.txt")) == [(1, "a"), (2, "b"), (3, "c")]


def test_image_dims(spark, tmp_path):
    png(tmp_path / "a b" / "x.png", 1000, 86)
    (tmp_path / "y.png").write_bytes(b"tiny")
    got = {Path(r["path"]).name: (r["width"], r["height"]) for r in image_dims(spark, str(tmp_path)).collect()}
    assert got == {"x.png": (1000, 86), "y.png": (None, None)}


def test_one_file_name_in_a_third_of_the_rows(spark):
    hot = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot.png").otherwise(F.concat(F.lit("f"), F.col("id") % 1000)).alias("file_name"),
        F.lit("ilé").alias("text"), F.lit("train").alias("split"), (F.col("id") % 40).alias("export_id"),
        F.lit(True).alias("has_image"), F.lit(50).alias("height"), F.col("id").alias("line_no"),
    )
    corpus = plan.consolidate(hot, ["line_no"])
    assert "WindowGroupLimit" in corpus.accepted._jdf.queryExecution().executedPlan().toString()
    assert corpus.accepted.where("file_name = 'hot.png'").select("export_id", "line_no").collect() == [(39, 39)]


def test_profile(spark):
    rows = [("train", 1, "ẹ́ b", 10, 20), ("train", 2, "ab", None, None), ("train", 3, "ñ~ñ", 30, 190), ("val", 4, "x", None, None)]
    labels = spark.createDataFrame(rows, "split string, line_no long, text string, width int, height int")
    dictionary = spark.createDataFrame([("a",), ("b",), ("q",)], "ch string")
    tables = profile.analysis(labels, dictionary, ["line_no"])
    stats = {r["split"]: r for r in tables["text_length"].collect()}
    assert (stats["train"]["median"], stats["train"]["p95"], stats["train"]["mean"]) == (3, 4, 3.0)
    marks = {r["mark"]: r["n"] for r in tables["combining_diacritics"].collect()}
    assert marks == {"combining_dot_below": 1, "combining_acute": 1, "U+0303": 2, "total": 4}
    cover = tables["vocab_coverage"].first()
    assert (cover["dict_size"], cover["unique_chars_in_data"], cover["chars_in_dict"]) == (3, 8, 2)
    assert cover["coverage_pct"] == 25.0
    audit = profile.audit(labels, ["line_no"])
    heights = {r["split"]: (r["p50"], r["max"]) for r in audit["image_height_px"].collect()}
    assert heights == {"train": (105.0, 190.0), "val": (0.0, 0.0)}
    offending = {(r["codepoint"], r["n"], r["name"]) for r in audit["offending_codepoints"].collect()}
    assert offending == {("U+00F1", 2, "LATIN SMALL LETTER N WITH TILDE")}
    shown = {(r["rule"], r["split"], r["shown"], r["offenders"]) for r in audit["examples"].collect()}
    assert ("non_yoruba_codepoint", "train", "ñ~ñ", "ñ") in shown and ("image_too_tall", "train", "190", None) in shown
    top = [r["ch"] for r in tables["top_50_chars"].collect()]
    assert top[:3] == ["b", "ñ", "ẹ"]


def test_leaks_and_inventory(spark):
    rows = [("train", "a"), ("test", "a"), ("train", "b"), ("train", "b")]
    df = spark.createDataFrame(rows, "split string, file_name string")
    assert [r["file_name"] for r in leaks(df, "file_name").collect()] == ["a"]
    lines = spark.createDataFrame([("test", "ab", True), ("test", None, True), ("test", "abcd", False)], "split string, text string, has_image boolean")
    got = inventory(lines, ["split"]).first()
    assert tuple(got)[1:] == (3, 2, 1, 1, 2, 2, 2.0)
    assert charset.char_dictionary(spark.createDataFrame([(" ",)], "text string")).count() == 0


def test_counts_of_absent_things(spark, tmp_path):
    (tmp_path / "train.txt").write_text("a\tb\n \n\u00a0\nc\n")
    assert source.label_count_or_default(spark, str(tmp_path / "train.txt")).first()["n"] == 2
    assert source.label_count_or_default(spark, str(tmp_path / "none.txt")).first()["n"] == 500
    plain = charset.char_counts(spark.createDataFrame([("abc",)], "text string"))
    assert [tuple(r) for r in charset.mark_counts(plain).collect()] == [("total", 0)]
    assert [tuple(r) for r in charset.precomposed_counts(plain).collect()] == [("total", 0)]
    (tmp_path / "dict.txt").write_text("a\n \n\nb\na\n")
    assert sorted(r["ch"] for r in source.read_char_dict(spark, str(tmp_path / "dict.txt")).collect()) == [" ", "a", "b"]


def test_staged_tables_go_to_the_shared_folder(spark):
    from linewright.session import scratch_dir, stage

    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(shared)
    assert stage(spark.range(3), "y").inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(shared.lstrip("/"))
