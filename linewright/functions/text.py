"""Column expressions over label texts, paths and code points."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright.constants import (
    BLOCKS,
    FOREIGN_LETTERS,
    FOREIGN_WORDS,
    HEADLESS_KINDS,
    MONTHS_AND_NUMERALS,
    OTHER_BLOCK,
    SPACE_CLASS,
    WHITELIST,
)
from linewright.functions.unicode import char_class, nfc


def _whole_word(words: Iterable[str]) -> str:
    # A combining mark is not a word character here, which Java's \b would make it.
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}_])"


# --- label checks ---------------------------------------------------------------------------------------------


def has_foreign_letter(text: Column) -> Column:
    return text.rlike(f"(?iu)[{FOREIGN_LETTERS}]")


def has_fill_blank(text: Column) -> Column:
    return text.rlike(r"\.{3,}|_{3,}")


def has_equals(text: Column) -> Column:
    return F.contains(text, F.lit("="))


def has_month_or_numeral(text: Column) -> Column:
    return text.rlike(_whole_word(MONTHS_AND_NUMERALS))


def has_foreign_word(text: Column) -> Column:
    return text.rlike(_whole_word(FOREIGN_WORDS))


def is_valid_text(text: Column) -> Column:
    return ~(
        has_foreign_letter(text)
        | has_fill_blank(text)
        | has_equals(text)
        | has_month_or_numeral(text)
        | has_foreign_word(text)
    )


def only_whitelisted(text: Column, code_points: Iterable[int] = WHITELIST) -> Column:
    return ~text.rlike(f"[^{char_class(code_points)}]")


def offenders(text: Column, code_points: Iterable[int] = WHITELIST) -> Column:
    """Distinct characters outside the whitelist, in code point order, as one string."""
    kept = F.regexp_replace(text, f"[{char_class(code_points)}]+", "")
    return F.array_join(F.array_sort(F.array_distinct(characters(kept))), "")


def too_tall(height: Column, limit: int) -> Column:
    """False where the height is unknown; a limit of 0 switches the check off."""
    return F.lit(False) if limit <= 0 else F.coalesce(height > limit, F.lit(False))


# --- characters and words -------------------------------------------------------------------------------------


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def word_len(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def codepoint(ch: Column) -> Column:
    return F.ascii(ch)


def codepoint_label(cp: Column) -> Column:
    return F.format_string("U+%04X", cp)


def unicode_block(cp: Column) -> Column:
    label = None
    for first, last, name in BLOCKS:
        hit = cp.between(first, last)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(OTHER_BLOCK)


def preview(text: Column, width: int = 80) -> Column:
    return F.concat(F.substring(text, 1, width), F.lit("..."))


def space_label(ch: Column) -> Column:
    return F.when(ch == " ", "(space)").otherwise(ch)


# --- transcripts ----------------------------------------------------------------------------------------------


def clean_transcript(raw: Column) -> Column:
    """First line of a recogniser's answer, without code fences, composed and stripped."""
    text = strip(F.coalesce(raw, F.lit("")))
    bare = F.regexp_replace(
        F.regexp_replace(text, rf"\A```[a-zA-Z0-9]*{SPACE_CLASS}*", ""), rf"{SPACE_CLASS}*```\z", ""
    )
    text = F.when(F.contains(text, F.lit("```")), bare).otherwise(text)
    return nfc(strip(F.split(text, "\n")[0]))


# --- paths ----------------------------------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    """Last path component, with its extension: the key under which repeated annotations meet."""
    return F.substring_index(path, "/", -1)


def sample_id(path: Column) -> Column:
    """Last path component without its extension: the id under which a sample is exported."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+\z", "")


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def portable_path(path: Column, root: str) -> Column:
    """Path relative to the root where it lies under it, else unchanged."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


# --- numbers --------------------------------------------------------------------------------------------------


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, rounded on the exact binary value, ties to even.

    Half of the last digit itself is the one value that `format_number` does not round that way.
    """
    half = float(f"5e-{digits + 1}")
    text = F.call_function("format_number", value, F.lit("0." + "0" * digits))
    return (
        F.when(value == half, f"{half:.{digits}f}").when(value == -half, f"{-half:.{digits}f}").otherwise(text)
    )


def round_n(value: Column, digits: int) -> Column:
    """Rounding as `round` of Python does it; infinite values and NaN stay."""
    finite = F.when(F.abs(value) < float("inf"), value)
    return F.coalesce(fixed(finite, digits).cast("double"), value)


def pct(value: Column) -> Column:
    """A rate as a percentage with one decimal, never capped; a dash where there is no number, or an infinite one."""
    number = value.try_cast("double")
    return F.coalesce(fixed(F.when(F.abs(number) < float("inf"), number) * 100, 1), F.lit("—"))


def at_least_one(n: Column) -> Column:
    return F.greatest(n, F.lit(1))


# --- run records ----------------------------------------------------------------------------------------------


def phantom_flag(
    has_provenance: Column, model_kind: Column, has_integrity: Column, missing_head: Column, mismatched_head: Column
) -> Column:
    """`true` where head weights were not restored, `n/a` where there is no head to restore."""
    bad = F.coalesce(missing_head, F.lit(0)) + F.coalesce(mismatched_head, F.lit(0))
    return (
        F.when(~F.coalesce(has_provenance, F.lit(False)), "unknown")
        .when(F.coalesce(model_kind.isin(*HEADLESS_KINDS), F.lit(False)), "n/a")
        .when(~F.coalesce(has_integrity, F.lit(False)), "unknown")
        .when(bad > 0, "true")
        .otherwise("false")
    )


def classify_param(key: Column) -> Column:
    k = F.lower(key)
    return (
        F.when(k.rlike(r"^head|\.head\.|\.ctc_head\.|ctc_encoder"), "head")
        .when(k.rlike(r"^(?:backbone|neck)"), "backbone")
        .otherwise("other")
    )


def utc_timestamp() -> Column:
    """Start of the query as ISO text with microseconds, in the session's time zone (UTC by `build_session`)."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
