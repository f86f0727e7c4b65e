"""Dataset analysis and quality audit of a consolidated corpus.

The corpus is exploded into characters once; the small table of counts is staged for all outputs that use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions.text import word_len
from linewright.operators import charset, hygiene, lengths
from linewright.session import stage


def analysis(labels: DataFrame, dictionary: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """Tables of the dataset analysis. `order` is the file order of `labels`."""
    counts = stage(charset.char_counts(labels, order=order), "characters")
    return {
        "split_counts": hygiene.split_counts(labels),
        "text_length": lengths.length_stats(labels, ["split"], F.length("text")),
        "length_histogram": lengths.length_histogram(labels, ["split"], F.length("text")),
        "top_50_chars": charset.top_chars(counts, 50),
        "combining_diacritics": charset.mark_counts(counts),
        "precomposed_diacritic_chars": charset.precomposed_counts(counts),
        "vocab_coverage": charset.vocab_coverage(counts, dictionary),
    }


def audit(labels: DataFrame, order: list[str], limits: hygiene.Limits = hygiene.Limits()) -> dict[str, DataFrame]:
    """Tables of the quality audit, per split. `labels` has `text`, `split`, `width`, `height`."""
    counts = stage(charset.char_counts(labels, by=["split"], order=order), "characters")
    by = ["split"]

    def profile(value) -> DataFrame:
        return lengths.zero_filled(lengths.quantile_profile(labels, by, value), labels, by)

    return {
        "label_length_chars": profile(F.length("text")),
        "label_length_words": profile(word_len(F.col("text"))),
        "image_width_px": profile(F.col("width")),
        "image_height_px": profile(F.col("height")),
        "block_histogram": charset.block_counts(counts, by),
        "offending_codepoints": charset.offending_codepoints(counts),
        "would_drop": hygiene.would_drop(labels, limits),
        "examples": hygiene.example_rows(labels, order, limits),
        "totals": hygiene.audit_totals(labels, limits),
    }
