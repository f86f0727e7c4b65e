"""Edit distances of (prediction, reference) pairs over characters, words and marks.

Each function gives a struct of `edits`, `reference` and `produced` token counts. Pairs of equal texts, most of a good
recogniser's, are settled by expressions. Pairs that differ go to an Arrow function that takes all texts of a batch apart at
once and works through all its pairs together (`pair_edits`): the built-in `levenshtein` costs the product of two lengths one
cell at a time, several times as much for an ordinary line. Pairs that differ over more than 1,024 tokens are done one by one,
by diagonals where they are near, else bit-parallel. All ways give the same numbers for any length; there is no length cap.
Marks are counted there too, but those of ASCII texts, which have none.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Hashable, Sequence
from math import isqrt
from operator import ne
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.functions.pair_edits import code_points, edits_of_runs, of_texts, split_words
from linewright.functions.unicode import is_ascii, mark_string

#: Characters up to which limits on the distance of a pair are left to the built-in function.
LONG = 250
#: Bytes of pairs that are worked through together, about.
PART = 1 << 20
#: Code points below this one are composed whatever stands beside them, and their marks are always the same.
PLAIN = 0x300

ERRORS = T.StructType([T.StructField(name, T.IntegerType()) for name in ("edits", "reference", "produced")])
_ARROW_ERRORS = pa.struct([(name, pa.int32()) for name in ERRORS.names])


def sequence_edits(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Edit distance of two token sequences.

    Common ends are cut off. What is left is first tried diagonal by diagonal, which costs the square of the distance
    whatever the lengths; only pairs with too many edits for that pay one column of the matrix per token.
    """
    return edits_within(a, b, max(len(a), len(b)))


def edits_within(a: Sequence[Hashable], b: Sequence[Hashable], most: int) -> int | None:
    """Edit distance if it is at most `most`, else None, found as early as possible."""
    head = _common_length(a, b, 0, 0)
    a, b = a[head:], b[head:]
    tail = _common_length(a[::-1], b[::-1], 0, 0)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    most = min(most, max(len(a), len(b)))
    if not a or not b:
        return _limited(len(a) + len(b), most)
    least = max(len(a), len(b)) - (Counter(a) & Counter(b)).total()
    if least > most:
        return None
    if least == _simple_edits(a, b):
        return least
    # as many diagonals as cost no more than the columns would
    few = min(most, isqrt(min(len(a), len(b)) * (64 + max(len(a), len(b)) // 64) // 128))
    if least <= few:
        found = _edits_by_diagonals(a, b, few)
        if found is not None or few == most:
            return found
    return _edits_by_columns(a, b, most)


def _simple_edits(a: Sequence[Hashable], b: Sequence[Hashable]) -> int | None:
    """Edits by replacing only, where the lengths are the same, or by leaving out only, where that does."""
    if len(a) == len(b):
        return sum(map(ne, a, b))
    few, many = (a, iter(b)) if len(a) < len(b) else (b, iter(a))
    return abs(len(a) - len(b)) if all(token in many for token in few) else None


def _limited(distance: int, most: int) -> int | None:
    return distance if distance <= most else None


def _common_length(a: Sequence[Hashable], b: Sequence[Hashable], i: int, j: int) -> int:
    """Number of equal tokens from a[i] and b[j] on: stretches of doubling length are compared, then the last one is halved."""
    start, step = i, 8
    while True:
        end = min(step, len(a) - i, len(b) - j)
        if end <= 0:
            return i - start
        if a[i : i + end] != b[j : j + end]:
            break
        i, j, step = i + end, j + end, 2 * step
    low, high = 0, end - 1
    while low < high:
        middle = (low + high + 1) // 2
        if a[i : i + middle] == b[j : j + middle]:
            low = middle
        else:
            high = middle - 1
    return i - start + low


def _edits_by_diagonals(a: Sequence[Hashable], b: Sequence[Hashable], most: int) -> int | None:
    """For 0, 1, 2, ... edits, how far down each diagonal of the matrix they reach, until the last corner is reached."""
    n, m = len(a), len(b)
    corner = m - n
    reach = {0: _common_length(a, b, 0, 0)}
    if corner == 0 and reach[0] == n:
        return 0
    unreached = -1
    for edits in range(1, most + 1):
        further = {}
        for k in range(max(-edits, -n), min(edits, m) + 1):
            i = max(reach.get(k, unreached - 1) + 1, reach.get(k - 1, unreached), reach.get(k + 1, unreached - 1) + 1)
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            i += _common_length(a, b, i, i + k)
            if k == corner and i == n:
                return edits
            further[k] = i
        reach = further
    return None


def _edits_by_columns(a: Sequence[Hashable], b: Sequence[Hashable], most: int) -> int | None:
    """One column of the distance matrix per step, held in two integers; ends where the rest cannot come down to `most`."""
    rows, steps = (a, b) if len(a) >= len(b) else (b, a)
    where: dict[Hashable, int] = {}
    for i, token in enumerate(rows):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(rows)) - 1
    bottom = 1 << (len(rows) - 1)
    up, down, distance, left_over = full, 0, len(rows), len(steps)
    for token in steps:
        hit = where.get(token, 0)
        diagonal = (((hit & up) + up) ^ up) | hit | down
        right = down | (full & ~(diagonal | up))
        left = up & diagonal
        if right & bottom:
            distance += 1
        elif left & bottom:
            distance -= 1
        left_over -= 1
        if distance - left_over > most:
            return None
        right = ((right << 1) | 1) & full
        left = (left << 1) & full
        up = left | (full & ~(diagonal | right))
        down = right & diagonal
    return _limited(distance, most)


class _Texts(NamedTuple):
    """Composed texts of an array, their code points one after the other, and which texts have some from `PLAIN` on."""

    texts: pa.Array
    codes: np.ndarray
    sizes: np.ndarray
    special: np.ndarray


def _composed(texts: pa.Array) -> _Texts:
    codes, sizes = code_points(texts)
    special = np.unique(np.searchsorted(np.cumsum(sizes), np.flatnonzero(codes >= PLAIN), "right"))
    if len(special):
        composed = [unicodedata.normalize("NFC", t) for t in texts.take(pa.array(special)).to_pylist()]
        place = np.arange(len(texts))
        place[special] = len(texts) + np.arange(len(special))
        texts = pa.concat_arrays([texts, pa.array(composed, texts.type)]).take(pa.array(place))
        codes, sizes = code_points(texts)
    return _Texts(texts, codes, sizes, special)


def _chars(texts: _Texts) -> tuple[np.ndarray, np.ndarray]:
    return texts.codes, texts.sizes


def _words(texts: _Texts) -> tuple[np.ndarray, np.ndarray]:
    return split_words(texts.texts)


_PLAIN_MARKS = [mark_string(chr(c)) for c in range(PLAIN)]
_N_MARKS = np.array([*map(len, _PLAIN_MARKS)])
FIRST_MARKED = int(np.flatnonzero(_N_MARKS)[0])
_MARK_AT = np.cumsum(_N_MARKS) - _N_MARKS
_ALL_MARKS = of_texts(_PLAIN_MARKS)[0]


def _marks(texts: _Texts) -> tuple[np.ndarray, np.ndarray]:
    """Marks of plain texts letter by letter, those of the others text by text."""
    ends = np.cumsum(texts.sizes)
    place = np.flatnonzero(texts.codes >= FIRST_MARKED)  # an ordinary text has few
    if len(texts.special):
        place = place[~np.isin(np.searchsorted(ends, place, "right"), texts.special)]
    codes = texts.codes[place]
    n = _N_MARKS[codes]
    upto = np.concatenate([[0], np.cumsum(n)])
    sizes = np.diff(upto[np.searchsorted(place, ends)], prepend=0)
    within = np.arange(upto[-1]) - np.repeat(upto[:-1], n)
    marks = _ALL_MARKS[np.repeat(_MARK_AT[codes], n) + within]
    if len(texts.special):
        others, counts = of_texts([mark_string(t) for t in texts.texts.take(pa.array(texts.special)).to_pylist()])
        sizes[texts.special] = counts
        place = np.repeat(np.isin(np.arange(len(ends)), texts.special), sizes)
        plain, marks = marks, np.empty(len(place), np.uint32)
        marks[place], marks[~place] = others, plain
    return marks, sizes


_TOKENS: dict[str, Callable[[_Texts], tuple[np.ndarray, np.ndarray]]] = {"char": _chars, "word": _words, "mark": _marks}


def _counts(pred: pa.Array, gt: pa.Array, kinds: Sequence[str], share: float | None = None) -> dict[str, np.ndarray]:
    """Per kind of token the edits, reference and produced tokens of all pairs of an array, in parts of bounded size.

    With `share`, a number of edits above this share of the reference tokens may be any other number above it.
    """
    there = pc.and_(pred.is_valid(), gt.is_valid())
    p, g = pred.filter(there).cast(pa.string()), gt.filter(there).cast(pa.string())
    counts = {kind: np.zeros((3, len(pred)), np.int32) for kind in kinds}
    places = np.flatnonzero(there.to_numpy(zero_copy_only=False))
    upto = np.cumsum(pc.add(pc.binary_length(p), pc.binary_length(g)).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(p):
        end = max(start + 1, int(np.searchsorted(upto, PART + (upto[start - 1] if start else 0), "right")))
        many = end - start
        # a reference stands in many pairs, and lines repeat: every text is taken apart once
        each = pa.concat_arrays([p.slice(start, many), g.slice(start, many)]).dictionary_encode()
        which = each.indices.to_numpy()
        texts = _composed(each.dictionary)
        for kind in kinds:
            numbers, sizes = _TOKENS[kind](texts)
            at, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
            most = None if share is None else np.floor(n[many:] * share) + 1
            edits = edits_of_runs(numbers, at[:many], n[:many], at[many:], n[many:], sequence_edits, most)
            counts[kind][:, places[start:end]] = edits, n[many:], n[:many]
        start = end
    return counts


def _errors_arrow(pred: pa.Array, gt: pa.Array, kind: str) -> pa.Array:
    missing = pc.or_(pred.is_null(), gt.is_null())
    return pa.StructArray.from_arrays([pa.array(c) for c in _counts(pred, gt, [kind])[kind]], fields=list(_ARROW_ERRORS), mask=missing)


@F.arrow_udf(ERRORS)
def char_errors_arrow(pred: pa.Array, gt: pa.Array) -> pa.Array:
    return _errors_arrow(pred, gt, "char")


@F.arrow_udf(ERRORS)
def word_errors_arrow(pred: pa.Array, gt: pa.Array) -> pa.Array:
    return _errors_arrow(pred, gt, "word")


@F.arrow_udf(ERRORS)
def mark_errors_arrow(pred: pa.Array, gt: pa.Array) -> pa.Array:
    return _errors_arrow(pred, gt, "mark")


def _errors(edits: Column, reference: Column, produced: Column) -> Column:
    return F.struct(edits.alias("edits"), reference.alias("reference"), produced.alias("produced"))


def _is_long(pred: Column, gt: Column) -> Column:
    return F.greatest(F.length(pred), F.length(gt)) > LONG


def _with_hard(udf: Callable[[Column, Column], Column], hard: Column, pred: Column, gt: Column, easy: Column) -> Column:
    return F.coalesce(udf(F.when(hard, pred), F.when(hard, gt)), easy)


def char_errors(pred: Column, gt: Column) -> Column:
    easy = _errors(F.lit(0), F.length(gt), F.length(pred))
    return _with_hard(char_errors_arrow, pred != gt, pred, gt, easy)


def word_errors(pred: Column, gt: Column) -> Column:
    # words are counted there as well: equal texts cost little more than their references, which other pairs need
    return word_errors_arrow(pred, gt)


def mark_errors(pred: Column, gt: Column) -> Column:
    """Over the combining marks of the decomposed texts."""
    none = F.when(gt.isNotNull(), F.lit(0))
    return _with_hard(mark_errors_arrow, ~(is_ascii(pred) & is_ascii(gt)), pred, gt, _errors(none, none, F.lit(0)))


def _rates(counts: np.ndarray) -> np.ndarray:
    """As `rate` gives them."""
    edits, reference, produced = counts
    return np.where(reference == 0, (produced > 0).astype(float), edits / np.maximum(reference, 1))


#: Rates and what else is made of the counts of a kind of token.
_OF_KIND: dict[str, dict[str, tuple[T.DataType, Callable[[np.ndarray], np.ndarray]]]] = {
    "char": {"cer": (T.DoubleType(), _rates)},
    "word": {"wer": (T.DoubleType(), _rates)},
    "mark": {
        "der": (T.DoubleType(), _rates),
        "mark_edits": (T.IntegerType(), lambda counts: counts[0]),
        "gt_marks": (T.IntegerType(), lambda counts: counts[1]),
        "pred_marks": (T.IntegerType(), lambda counts: counts[2]),
    },
}


def pair_rates(pred: Column, gt: Column, kinds: Sequence[str]) -> Column:
    """A struct of `cer` (of kind `char`), `wer` (`word`), `der`, `mark_edits`, `gt_marks` and `pred_marks` (`mark`).

    The texts of a pair are sent to Python and taken apart once for all kinds; equal texts have no errors, and stay where
    their marks need not be counted.
    """
    made = {name: how for kind in kinds for name, how in _OF_KIND[kind].items()}
    of = {name: kind for kind in kinds for name in _OF_KIND[kind]}
    schema = T.StructType([T.StructField(name, how[0]) for name, how in made.items()])

    @F.arrow_udf(schema)
    def pair_rates_arrow(pred: pa.Array, gt: pa.Array) -> pa.Array:
        counts = _counts(pred, gt, kinds)
        missing = pc.or_(pred.is_null(), gt.is_null())
        return pa.StructArray.from_arrays([pa.array(how(counts[of[name]])) for name, (_, how) in made.items()], names=list(made), mask=missing)

    hard = (pred != gt) | ~is_ascii(gt) if "mark" in kinds else pred != gt
    easy = F.when(pred == gt, F.struct(*[F.lit(0).cast(how[0]).alias(name) for name, how in made.items()]))
    return _with_hard(pair_rates_arrow, hard, pred, gt, easy)


def most_edits(length: Column, threshold: float) -> Column:
    """Largest number of edits whose rate over `length` reference tokens is below the threshold, compared as doubles."""
    near = F.floor(length * threshold).cast("int")
    return F.when((near + 1) / length < threshold, near + 1).when(near / length < threshold, near).otherwise(near - 1)


_LIMITS = T.StructType([T.StructField(name, T.BooleanType()) for name in ("perfect", "below", "same_marks")])


@F.arrow_udf(_LIMITS)
def char_limits_arrow(pred: pa.Array, gt: pa.Array, threshold: pa.Array) -> pa.Array:
    share = threshold[0].as_py() if len(threshold) else 0.0
    counts = _counts(pred, gt, ["char"], share)["char"]
    marks = _counts(pred, gt, ["mark"], 0.0)["mark"]
    found = [counts[0] == 0, _rates(counts) < share, marks[0] == 0]
    return pa.StructArray.from_arrays([pa.array(f) for f in found], names=_LIMITS.names, mask=pc.or_(pred.is_null(), gt.is_null()))


def char_limits(pred: Column, gt: Column, threshold: float) -> Column:
    """Whether the character error rate is 0 (`perfect`), and whether it is `below` a threshold, without the rate itself;
    and whether the marks are the same (`same_marks`).

    Distances are followed only where the threshold can let them be, those of short ASCII texts only as far as it does.
    """
    ascii = is_ascii(pred) & is_ascii(gt)
    hard = (pred != gt) & (_is_long(pred, gt) | ~ascii)
    most = most_edits(F.length(gt), threshold)
    near = F.when(most < 0, False).otherwise(F.call_function("levenshtein", pred, gt, most) >= 0)
    below = F.when(pred == gt, F.lit(0.0 < threshold)).when(gt == "", F.lit(1.0 < threshold)).otherwise(near)
    easy = F.struct((pred == gt).alias("perfect"), below.alias("below"), ((pred == gt) | ascii).alias("same_marks"))
    return F.coalesce(char_limits_arrow(F.when(hard, pred), F.when(hard, gt), F.lit(threshold)), easy)


def rate(errors: Column) -> Column:
    """Edits per reference token; with no reference 0 where nothing was produced either, else 1."""
    return F.when(errors["reference"] == 0, F.when(errors["produced"] == 0, 0.0).otherwise(1.0)).otherwise(
        errors["edits"] / errors["reference"]
    )
