"""Normalisation and combining marks.

Most text of a Latin orthography is already composed, and its marks follow letter by letter. Such "regular" text is
handled by built-in expressions; only the rest is sent to the Arrow functions below, which see NULL for regular rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.constants import WHITELIST


def char_class(code_points: Iterable[int]) -> str:
    """The inside of a Java regex character class for a set of code points, as merged ranges."""
    parts: list[str] = []
    start = last = None
    for cp in sorted(code_points):
        if start is None:
            start = last = cp
        elif cp == last + 1:
            last = cp
        else:
            parts.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
            start = last = cp
    if start is not None:
        parts.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
    return "".join(parts)


def mark_string(text: str) -> str:
    """Combining marks of the decomposed text, in order."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.combining(c))


def _plain(cp: int) -> bool:
    ch = chr(cp)
    return unicodedata.normalize("NFC", ch) == ch and len(mark_string(ch)) <= 1


# All marks in regular text are of the same class (above), so marks never change places when text is decomposed.
_ABOVE = [cp for cp in sorted(WHITELIST) if unicodedata.combining(chr(cp)) == 230]
_REGULAR = [
    cp
    for cp in sorted(set(range(0x300)) | WHITELIST)
    if _plain(cp) and unicodedata.combining(chr(cp)) in (0, 230)
]
_COMPOSABLE = {
    mark: [
        cp
        for cp in _REGULAR
        if not unicodedata.combining(chr(cp)) and len(unicodedata.normalize("NFC", chr(cp) + chr(mark))) == 1
    ]
    for mark in _ABOVE
}
_MARKED = {chr(cp): mark_string(chr(cp)) for cp in _REGULAR if mark_string(chr(cp))}

# Every character that can make a text irregular lies at or above this one, so most texts need no closer look.
_FIRST_DOUBTFUL = min(cp for cp in range(0x300) if cp not in _REGULAR)
_DOUBTFUL = f"[\\x{{{_FIRST_DOUBTFUL:x}}}-\\x{{10ffff}}]"
# The mark is looked for first and its base letter second: marks are rare, base letters are not.
IRREGULAR = "|".join(
    [f"[^{char_class(_REGULAR)}]"]
    + [f"\\x{{{mark:x}}}(?<=[{char_class(bases)}]\\x{{{mark:x}}})" for mark, bases in _COMPOSABLE.items()]
)
_NOT_MARKED = f"[^{char_class(map(ord, _MARKED))}]+"
_ASCII_RUN = r"[\x{0}-\x{7f}]+"


@F.arrow_udf(T.StringType())
def nfc_arrow(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string()
    )


@F.arrow_udf(T.StringType())
def marks_arrow(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else mark_string(t) for t in texts.to_pylist()], pa.string())


def register(spark: SparkSession) -> None:
    """Make both functions available to SQL text as `nfc_text` and `combining_marks`."""
    spark.udf.register("nfc_text", nfc_arrow)
    spark.udf.register("combining_marks", marks_arrow)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def is_irregular(text: Column) -> Column:
    return F.when(is_ascii(text), False).otherwise(text.rlike(_DOUBTFUL) & text.rlike(IRREGULAR))


def nfc(text: Column) -> Column:
    """Text in composed form."""
    return F.coalesce(nfc_arrow(F.when(is_irregular(text), text)), text)


def marks_by_letter(text: Column) -> Column:
    """Combining marks of regular text."""
    beyond_ascii = F.regexp_replace(text, _ASCII_RUN, "")
    marked = F.regexp_replace(beyond_ascii, _NOT_MARKED, "")
    return F.when(is_ascii(text), "").otherwise(F.translate(marked, "".join(_MARKED), "".join(_MARKED.values())))


def combining_marks(text: Column) -> Column:
    """Ordered string of the combining marks of the decomposed text."""
    return F.coalesce(marks_arrow(F.when(is_irregular(text), text)), marks_by_letter(text))
