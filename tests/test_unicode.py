"""Normalisation, marks and edit distances against plain Python."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.constants import WHITELIST
from linewright.functions import unicode as u
from linewright.functions.distance import char_errors, mark_errors, rate, sequence_edits, word_errors
from linewright.functions.text import SPACE_CLASS, words

TRICKY = [
    "",
    "plain",
    "àbọ̀ ẹ̀kọ́",
    unicodedata.normalize("NFD", "àbọ̀ ẹ̀kọ́"),
    "é",
    "́leading",
    "ọ̣",
    "ǖ Ǘ",
    "ǵ̣",
    "ǵ̣",
    "x̄́",
    "é̀",
    "n̄́ ñ ç ß",
    "가 가",
    "̈́ क़ Ω",
    "ạ̧́b",
    "𝒳́ \U0001d15e",
    "ā́ Ṣ́ ṣ́",
]


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def test_nfc_and_marks_match_python(spark):
    alphabet = [chr(c) for c in sorted(WHITELIST)] + ["ǵ", "ç", "ơ", "ǖ", "̧", "̣"]
    made = ["".join(alphabet[(i * k * 7 + k * k) % len(alphabet)] for k in range(1, 14)) for i in range(400)]
    texts = TRICKY + made + [unicodedata.normalize("NFC", t) for t in made]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    rows = df.select("t", u.nfc(F.col("t")).alias("nfc"), u.combining_marks(F.col("t")).alias("marks")).collect()
    for row in rows:
        if row["t"] is None:
            assert row["nfc"] is None and row["marks"] is None
        else:
            assert row["nfc"] == unicodedata.normalize("NFC", row["t"]), repr(row["t"])
            assert row["marks"] == u.mark_string(row["t"]), repr(row["t"])


def test_regular_text_needs_no_arrow_function():
    """Text of the regular letters that is composed gives its marks letter by letter."""
    letters = st.text(st.sampled_from([chr(c) for c in u._REGULAR]), max_size=12)

    @settings(max_examples=300, deadline=None)
    @given(letters)
    def check(text):
        composed = unicodedata.normalize("NFC", text)
        if all(ord(c) in set(u._REGULAR) for c in composed):
            assert "".join(u._MARKED.get(c, "") for c in composed) == u.mark_string(composed)

    check()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_sequence_edits(a, b):
    assert sequence_edits(a, b) == slow_edits(a, b)


def test_errors_match_brute_force(spark):
    base = "Ẹ kú àárọ̀ o, ẹ̀yin ọ̀rẹ́ mi. "
    pairs = [
        ("àbọ̀ ẹ̀kọ́", "àbọ̀ ẹ̀kọ́"),
        ("", ""),
        ("", "ab"),
        ("", "two words"),
        ("", "à"),
        ("x" * 20, "hi"),
        ("abc", ""),
        ("é", "plain"),
        ("a b c", "a b\u001cc"),
        (unicodedata.normalize("NFD", base), base),
        (base * 20, base.replace("ẹ", "e") * 19),
        ("a b c d e f g " * 40, "a c b d g " * 50),
        (" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(0, 600, 2))),
        ("a " * 124, "b " * 125),
        (" ".join(chr(0x4E00 + i) for i in range(125)), " ".join(chr(0x5E00 + i) for i in range(125))),
    ] + [(t, s) for t, s in zip(TRICKY, TRICKY[1:])]
    df = spark.createDataFrame(pairs, "pred string, gt string")
    p, g = F.col("pred"), F.col("gt")
    out = df.select("pred", "gt", char_errors(p, g).alias("c"), word_errors(p, g).alias("w"), mark_errors(p, g).alias("m"))
    out = out.select("*", rate(F.col("c")).alias("cer"), rate(F.col("w")).alias("wer"), rate(F.col("m")).alias("der"))

    def expected(a, b):
        return (0.0 if not a else 1.0) if not b else slow_edits(a, b) / len(b)

    for row in out.collect():
        pred, gt = (unicodedata.normalize("NFC", row[k]) for k in ("pred", "gt"))
        assert row["cer"] == expected(pred, gt), row
        assert row["wer"] == expected(pred.split(), gt.split()), row
        assert row["der"] == expected(u.mark_string(pred), u.mark_string(gt)), row


def test_white_space_is_pythons(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    others = [chr(c) for c in (0x200B, 0xFEFF, 0x180E, 0x1B, 0x86)]
    df = spark.createDataFrame([(f"a{c}b",) for c in spaces + others], "t string")
    for row in df.select("t", words(F.col("t")).alias("w")).collect():
        assert row["w"] == row["t"].split(), repr(row["t"])
    assert len(spaces) == 29 and SPACE_CLASS
