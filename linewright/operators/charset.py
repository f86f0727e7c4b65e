"""Character statistics.

The corpus is exploded once into counts per (group, character). Everything else (blocks, marks, dictionary, coverage,
top lists) is computed from that table, which has at most one row per group and assigned code point.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.constants import MARK_NAMES, PRECOMPOSED, WHITELIST
from linewright.functions.text import at_least_one, codepoint, codepoint_label, round_n, unicode_block
from linewright.functions.unicode import combining_marks


def char_counts(labels: DataFrame, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Characters per group with counts; with `order` also `first_seen`, the place of the first occurrence.

    The last column of `order` is a number. Each row is reduced to its distinct characters with their first positions.
    Number and position travel as one fixed-width decimal, so a hash table keeps the lowest one per block of rows (the other
    columns of `order`) and character; only blocks are compared as a whole, and no text is looked at twice.
    """
    by, order = by or [], order or []
    if not order:
        chars = labels.select(*by, F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
        return chars.groupBy(*by, "ch").agg(F.count("*").alias("n"))
    rows = [*dict.fromkeys([*by, *order])]
    distinct = labels.select(*rows, "text", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''")
    held = (F.length("text") - F.length(F.replace("text", F.col("ch"), F.lit("")))).cast("long")
    positions = F.lit(1 << 31).cast("decimal(10,0)")
    place = F.col(order[-1]).cast("long").cast("decimal(19,0)") * positions + (F.position(F.col("ch"), F.col("text")) - 1)
    block = [*dict.fromkeys([*by, *order[:-1], "ch"])]
    blocks = distinct.select(*block, place.alias("_place"), held.alias("_held")).groupBy(*block).agg(
        F.sum("_held").alias("n"), F.min("_place").alias("_place")
    )
    first = blocks.groupBy(*by, "ch").agg(F.sum("n").alias("n"), F.min(F.struct(*order[:-1], "_place")).alias("at"))
    position = F.pmod(F.col("at._place"), positions)
    number = F.call_function("div", F.col("at._place") - position, positions)
    seen = F.struct(*(F.col(f"at.{c}").alias(c) for c in order[:-1]), number.alias(order[-1]), position.cast("int").alias("pos"))
    return first.select(*by, "ch", "n", seen.alias("first_seen"))


def top_chars(counts: DataFrame, n: int) -> DataFrame:
    """Most frequent characters; among equals the one seen first comes first."""
    return counts.orderBy(F.desc("n"), F.asc("first_seen")).limit(n)


def block_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Characters per Unicode block."""
    by = by or []
    return counts.groupBy(*by, unicode_block(codepoint(F.col("ch"))).alias("block")).agg(F.sum("n").alias("n"))


@F.arrow_udf(T.StringType())
def unicode_name(chars: pa.Array) -> pa.Array:
    return pa.array([None if c is None else unicodedata.name(c, "<unnamed>") for c in chars.to_pylist()], pa.string())


def offending_codepoints(counts: DataFrame) -> DataFrame:
    """Characters outside the whitelist with code point, name and block."""
    cp = codepoint(F.col("ch"))
    return counts.where(~cp.isin(*sorted(WHITELIST))).select(
        codepoint_label(cp).alias("codepoint"),
        F.when(cp >= 0x20, F.col("ch")).otherwise("").alias("char"),
        *[c for c in counts.columns if c != "ch"],
        unicode_name(F.col("ch")).alias("name"),
        unicode_block(cp).alias("block"),
    )


def mark_counts(counts: DataFrame) -> DataFrame:
    """Combining marks of the decomposed corpus by name, and their `total`.

    Decomposition works letter by letter, so decomposing each distinct character once gives the corpus counts.
    """
    marks = counts.groupBy("ch").agg(F.sum("n").alias("n")).select(
        F.explode(F.split(combining_marks(F.col("ch")), "")).alias("mark"), "n"
    ).where("mark <> ''")
    named = codepoint_label(codepoint(F.col("mark")))
    for mark, name in MARK_NAMES.items():
        named = F.when(F.col("mark") == mark, name).otherwise(named)
    return _with_total(marks.select(named.alias("mark"), "n"), "mark")


def _with_total(rows: DataFrame, key: str) -> DataFrame:
    """Sums per key and their `total`, which is 0 for no rows."""
    sums = rows.groupBy(key).agg(F.sum("n").alias("n"))
    total = sums.agg(F.lit("total").alias(key), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return sums.unionByName(total)


def precomposed_counts(counts: DataFrame) -> DataFrame:
    """Listed precomposed letters by letter, and their `total`."""
    return _with_total(counts.where(F.col("ch").isin(*PRECOMPOSED)).select(F.col("ch").alias("letter"), "n"), "letter")


def char_dictionary(labels: DataFrame) -> DataFrame:
    """Distinct characters other than the space. Write or show them ordered: string order is code point order."""
    return char_counts(labels).where("ch <> ' '").select("ch")


def chars_not_in_dict(chars: DataFrame, dictionary: DataFrame) -> DataFrame:
    return chars.select("ch").distinct().join(dictionary.select("ch"), "ch", "left_anti")


def chars_in_dict(chars: DataFrame, dictionary: DataFrame) -> DataFrame:
    return chars.select("ch").intersect(dictionary.select("ch"))


def vocab_coverage(chars: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary size, characters in the data, overlap, the characters missed, and coverage in percent."""
    seen = chars.select("ch").distinct().withColumn("seen", F.lit(True))
    known = dictionary.select("ch").distinct().withColumn("known", F.lit(True))
    both = F.col("seen") & F.col("known")
    missed = F.when(F.col("seen") & F.col("known").isNull(), F.col("ch"))
    return (
        seen.join(known, "ch", "full_outer")
        .agg(
            F.count("known").alias("dict_size"),
            F.count("seen").alias("unique_chars_in_data"),
            F.count_if(both).alias("chars_in_dict"),
            F.array_join(F.array_sort(F.collect_list(missed)), "").alias("chars_not_in_dict"),
        )
        .withColumn(
            "coverage_pct",
            round_n(F.col("chars_in_dict") * 100 / at_least_one(F.col("unique_chars_in_data")), 2),
        )
    )
