"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = "doc_id long, text string, source string, lang string"
#: Extra columns with names that operators use for themselves.
EXTRA = ("score", "kept", "n_words", "lot", "found", "doc", "component_id", "spans", "rep")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed: int = 1) -> list[tuple]:
    """doc_id, text, source, lang: nulls, empty and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(60, 140)) for _ in range(20)]
    rows = [(i, t, f"src{i % 3}", "en") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "src0", "en") for i in range(4)]
    near = base[5].split()
    for k in range(4):
        changed = list(near)
        changed[k * 7] = f"x{k}"
        rows.append((200 + k, " ".join(changed), "src1", "de"))
    rows += [(300, None, "src0", "en"), (301, "", "src0", None), (302, " \t\n ", None, "en"), (303, "Two words", "src2", "en"), (304, "two words", "src2", "en")]
    rows += [(305, prose(rng, 30_000, 20_000), "src1", "fr"), (306, "same " * 200, "src1", "fr"), (307, "Été ÜBER ñandú 日本語 " * 30, "src2", "es")]
    rows += [(None, "no id here " + base[7], "src0", "en"), (None, None, None, None)]
    rows += [rows[3], rows[3]]
    return rows


def frame(spark, rows, schema: str = DOCS, extra: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.select("*", *(F.lit(f"own {name}").alias(name) for name in EXTRA)) if extra else df
