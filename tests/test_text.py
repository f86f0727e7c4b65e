from pyspark.sql import functions as F

from linewright import constants
from linewright.functions import text as t


def one(spark, value, use, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(use(F.col("v")).alias("r")).first()["r"]


def test_fixed_values():
    assert len(constants.WHITELIST) == 95 + 48
    assert len(set(constants.PRECOMPOSED)) == 27
    assert sorted(map(ord, constants.MARK_NAMES)) == [0x300, 0x301, 0x323]
    assert len(constants.FOREIGN_WORDS) == 21 and len(constants.MONTHS_AND_NUMERALS) == 17


def test_validity(spark):
    cases = {
        "ọ̀to": False,  # a combining mark ends a word
        "tó": True,
        "5to": True,
        "to_": True,
        "lọ to ilé": False,
        "TO ilé": False,
        "Ọjọ́ May": False,
        "vi": False,
        "iwe": True,
        "a...": False,
        "a..": True,
        "__ a": True,
        "a___": False,
        "a = b": False,
        "Zara": False,
        "bàbá": True,
        "ſtó": True,
        "iſ": False,  # long s matches s without regard to case
        "ın": False,  # and so do both special i
        "İn": False,
    }
    df = spark.createDataFrame(list(cases.items()), "v string, expected boolean")
    for row in df.select("v", "expected", t.is_valid_text(F.col("v")).alias("r")).collect():
        assert row["r"] == row["expected"], row


def test_whitelist_and_offenders(spark):
    assert one(spark, "Ẹ kú iṣẹ́ – ‘o’", t.only_whitelisted) is True
    assert one(spark, "kú…", t.only_whitelisted) is False
    assert one(spark, "ñ…añ]", t.offenders) == "ñ…"
    assert one(spark, "^-]\\[", t.only_whitelisted) is True


def test_clean_transcript(spark):
    cases = {
        "```foo bar```": "bar",  # a first word glued to the fence counts as the fence's language
        "```\nẹ kú\n```": "ẹ kú",
        "```text\né \nsecond\n```": "é",
        "  a b  ": "a b",
        "one\ntwo": "one",
        None: "",
        "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "v string, expected string")
    for row in df.select("v", "expected", t.clean_transcript(F.col("v")).alias("r")).collect():
        assert row["r"] == row["expected"], row


def test_rounding_is_pythons(spark):
    values = [0.12345, 2.675, 27.625, 1.2035, 0.00005, 0.00015, 0.005, -0.005, 0.015, 1 / 3, 1234567.891]
    values += [i / 800 for i in range(400)] + [i / 20000 for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", t.round_n(F.col("v"), 4).alias("four"), t.round_n(F.col("v"), 2).alias("two")).collect():
        assert row["four"] == round(row["v"], 4) and row["two"] == round(row["v"], 2)
    for raw, shown in {"1.2035": "120.3", "5.433": "543.3", "": "—", None: "—", "n/a": "—", "0.9847": "98.5", "0.0005": "0.1", "0.0015": "0.1"}.items():
        assert one(spark, raw, t.pct) == shown


def test_paths(spark):
    assert one(spark, "images/test/b1_line3.png", t.file_name) == "b1_line3.png"
    assert one(spark, "images/test/b1.v2_line3.png", t.sample_id) == "b1.v2_line3"
    assert one(spark, "a/.hidden", t.sample_id) == ".hidden"
    assert one(spark, "images\\a.png", t.forward_slashes) == "images/a.png"
    assert one(spark, "/repo/data/a.png", lambda c: t.portable_path(c, "/repo/")) == "data/a.png"
    assert one(spark, "/report/a.png", lambda c: t.portable_path(c, "/repo")) == "/report/a.png"


def test_blocks(spark):
    cases = {0x7F: "ascii", 0x80: "latin-1-supplement", 0x24F: "latin-extended-b", 0x250: "other-bmp-low",
             0x301: "combining-diacritics", 0x500: "other-bmp-low", 0x800: "other", 0x1E62: "latin-extended-additional",
             0x2019: "general-punctuation", 0x20AC: "superscripts-and-currency", 0x1F600: "other", 0xFB01: "alphabetic-presentation-forms"}
    df = spark.createDataFrame(list(cases.items()), "cp int, expected string")
    for row in df.select("expected", t.unicode_block(F.col("cp")).alias("r")).collect():
        assert row["r"] == row["expected"]


def test_phantom_flag(spark):
    rows = [
        (None, None, None, None, None, "unknown"),
        (True, "tesseract", None, None, None, "n/a"),
        (True, None, False, None, None, "unknown"),
        (True, "crnn", True, 0, None, "false"),
        (True, None, True, 1, 2, "true"),
    ]
    df = spark.createDataFrame(rows, "p boolean, k string, i boolean, m int, s int, expected string")
    flag = t.phantom_flag(F.col("p"), F.col("k"), F.col("i"), F.col("m"), F.col("s"))
    for row in df.select("expected", flag.alias("r")).collect():
        assert row["r"] == row["expected"]


def test_classify_param(spark):
    cases = {"head.fc": "head", "Student.head.w": "head", "x.ctc_head.b": "head", "neck.encoder": "backbone",
             "a_ctc_encoder": "head", "backbone.c": "backbone", "loss": "other"}
    df = spark.createDataFrame(list(cases.items()), "k string, expected string")
    for row in df.select("expected", t.classify_param(F.col("k")).alias("r")).collect():
        assert row["r"] == row["expected"]
