"""Queries over every letter and every line, against brute force."""

import hashlib
import unicodedata


def test_unicode_functions_see_every_letter(spark, tmp_path):
    from catalog.text import k01

    texts = ["España", "garçon, forêt, Mädchen, ÖL, Über", "éèóíÉÈ ÍÓ Ñ Ç Ê", "plain", "", "ñ already apart"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = {
        i: (
            hashlib.sha256(unicodedata.normalize("NFC", t).encode()).hexdigest(),
            sum(1 for c in unicodedata.normalize("NFD", t) if unicodedata.combining(c)),
        )
        for i, t in rows
    }
    assert {r.doc_id: (r.digest, r.marks) for r in k01(spark, str(tmp_path)).collect()} == expected


def test_inventory_counts_blank_lines(spark, tmp_path):
    from catalog.records import d20

    text = "\n".join(f"line {k}" for k in range(80))
    rows = [(8, "xx", "src1", text), (9, "xx", "src2", "one line")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.split: r for r in d20(spark, str(tmp_path)).collect()}
    blank = sum((8 * 1000000 + k + 1) % 37 == 0 for k in range(80))
    untabbed = sum((n := 8 * 1000000 + k + 1) % 29 == 0 and n % 37 > 0 for k in range(80))
    assert blank and got["val"].lines_in_file == 80 and got["val"].tab_parsed_rows == 80 - blank - untabbed
    assert got["test"].lines_in_file == 1
