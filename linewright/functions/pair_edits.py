"""Edit distances of many pairs at once.

All pairs of a batch are cut to where they differ, and then advance together through their distance matrices: one column per
step, 64 rows of a column per machine word, one numpy operation for all words of all pairs. A word is one step behind the word
above it, whose carry it needs, so pairs of any length share the steps. Only pairs that still differ over more than `LONGEST`
tokens are worked through one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens over which a pair may differ here, and words of 64 rows that advance together, about.
LONGEST = 1024
TOGETHER = 8192

_ONE = np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of consecutive places: all places, and the number of each within its run."""
    ends = np.cumsum(sizes)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    return np.repeat(starts, sizes) + within, within


def _common(tokens: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """How many tokens two runs have in common from their first places on, going by `step`; looked at in stretches of doubling length."""
    common = np.zeros(len(sizes), np.int64)
    left, width = np.flatnonzero(sizes > 0), 8
    while len(left):
        within = np.arange(width)
        far = common[left]
        a, b = ((at[left] + step * far)[:, None] + step * within for at in (at_a, at_b))
        differ = tokens.take(a, mode="clip") != tokens.take(b, mode="clip")
        differ |= within >= (sizes[left] - far)[:, None]
        first = differ.argmax(axis=1)
        over = differ[np.arange(len(left)), first]
        common[left] += np.where(over, first, width)
        left, width = left[~over], 2 * width
    return common


def _left_out(tokens: np.ndarray, at_few: np.ndarray, n_few: np.ndarray, at_many: np.ndarray, n_many: np.ndarray) -> np.ndarray:
    """Whether a run becomes the other one by leaving out tokens; `LONGEST` more tokens than there are stand last."""
    order = np.argsort(-n_many, kind="stable")
    at_few, at_many, found = at_few[order], at_many[order], np.zeros(len(order), np.int64)
    active = np.searchsorted(-n_many[order], -np.arange(n_many.max(initial=0)), "left")
    for j, k in enumerate(active.tolist()):
        found[:k] += tokens[at_few[:k] + found[:k]] == tokens[at_many[:k] + j]
    out = np.empty(len(order), bool)
    out[order] = found >= n_few[order]
    return out


def _advance(tokens: np.ndarray, at_rows: np.ndarray, n_rows: np.ndarray, at_steps: np.ndarray, n_steps: np.ndarray) -> np.ndarray:
    """Distances of pairs of runs of `tokens`, none of them empty; no token is 0, and as many zeros stand first as a pair has words."""
    words = (n_rows + 63) // 64
    pair = np.repeat(np.arange(len(words)), words)
    word = _spread(np.zeros_like(words), words)[1]
    end = n_steps[pair] + word
    order = np.argsort(-end, kind="stable")
    where = np.empty(len(order) + 1, np.int64)
    where[order] = np.arange(len(order))
    where[-1] = len(order)  # the top of the matrix lies above the first word of a pair
    above = where[np.where(word > 0, np.arange(len(order)) - 1, -1)][order]
    bottoms = where[np.cumsum(words) - 1]
    pair, word, end = pair[order], word[order], end[order]
    rows = np.zeros((len(order), 64), tokens.dtype)
    sizes = np.minimum(n_rows[pair] - 64 * word, 64)
    places, within = _spread(at_rows[pair] + 64 * word, sizes)
    rows[np.repeat(np.arange(len(order)), sizes), within] = tokens[places]
    last = (sizes - 1).astype(np.uint64)
    at = at_steps[pair] - word
    up, down, distance = np.empty(len(order), np.uint64), np.empty(len(order), np.uint64), np.empty(len(order), np.int64)
    plus, minus = np.zeros(len(order) + 1, np.uint64), np.zeros(len(order) + 1, np.uint64)
    plus[-1] = _ONE
    first, same = n_rows[pair], np.empty((len(order), 64), bool)
    active = np.searchsorted(-end, -np.arange(end[0]), "left")  # words that end behind this step
    latest = int(word.max())
    for j, k in enumerate(active.tolist()):
        if j <= latest:  # what a word did before its own first step does not count
            new = np.flatnonzero(word == j)
            up[new], down[new], distance[new] = _FULL, 0, first[new]
        np.equal(rows[:k], tokens[at[:k] + j][:, None], same[:k])
        equal = np.packbits(same[:k].reshape(-1), bitorder="little").view(np.uint64)
        u, d = up[:k], down[:k]
        carry_plus, carry_minus = plus[above[:k]], minus[above[:k]]
        vertical = equal | d
        equal |= carry_minus
        diagonal = equal & u
        diagonal += u
        diagonal ^= u
        diagonal |= equal
        diagonal |= d
        right = diagonal | u
        np.invert(right, right)
        right |= d
        left = u & diagonal
        out = right >> last[:k]
        out &= _ONE
        plus[:k] = out
        distance[:k] += out.view(np.int64)
        np.right_shift(left, last[:k], out)
        out &= _ONE
        minus[:k] = out
        distance[:k] -= out.view(np.int64)
        right <<= _ONE
        right |= carry_plus
        left <<= _ONE
        left |= carry_minus
        np.bitwise_and(right, vertical, d)
        vertical |= right
        np.invert(vertical, vertical)
        np.bitwise_or(left, vertical, u)
    return distance[bottoms]


def _small(tokens: np.ndarray) -> np.ndarray:
    """The same tokens under numbers from 1 on, in as few bytes as they need."""
    most = int(tokens.max(initial=0))
    if 255 <= most < 1 << 21:
        numbers = np.zeros(most + 1, np.int32)
        numbers[tokens] = 1
        numbers = np.cumsum(numbers, dtype=np.int32)
        return numbers.astype(np.min_scalar_type(int(numbers[-1])))[tokens]
    return tokens.astype(np.min_scalar_type(most + 1)) + 1


def edits_of_pairs(
    a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, one: Callable[[Sequence, Sequence], int]
) -> np.ndarray:
    """Edit distance of each pair. a, b: tokens of all pairs one after the other, as whole numbers; n_a, n_b: how many each has."""
    return edits_of_runs(np.concatenate([a, b]), np.cumsum(n_a) - n_a, n_a, len(a) + np.cumsum(n_b) - n_b, n_b, one)


def edits_of_runs(
    tokens: np.ndarray,
    at_a: np.ndarray,
    n_a: np.ndarray,
    at_b: np.ndarray,
    n_b: np.ndarray,
    one: Callable[[Sequence, Sequence], int],
    most: np.ndarray | None = None,
) -> np.ndarray:
    """Edit distances of pairs of runs of `tokens`, given by their first places and sizes.

    `one` does a pair that is too long for this. A pair whose sizes differ by more than its `most` edits is not followed: it
    gets that difference.
    """
    front = LONGEST // 64
    tokens = np.concatenate([np.zeros(front, np.uint8), _small(tokens), np.zeros(LONGEST + 1, np.uint8)])
    at_a, at_b = front + at_a, front + at_b
    head = _common(tokens, at_a, at_b, np.minimum(n_a, n_b), 1)
    tail = _common(tokens, at_a + n_a - 1, at_b + n_b - 1, np.minimum(n_a, n_b) - head, -1)
    at_a, at_b, n_a, n_b = at_a + head, at_b + head, n_a - head - tail, n_b - head - tail
    swap = n_a >= n_b  # the longer side makes the rows
    at_long, at_short = np.where(swap, at_a, at_b), np.where(swap, at_b, at_a)
    short, long = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    out = long.astype(np.int64)
    left = short > 0
    if most is not None:
        apart = long - short
        out = np.where(apart > most, apart, out)
        left &= apart <= most
    for k in np.flatnonzero(left & (long > LONGEST)).tolist():
        out[k] = one(tokens[at_long[k] : at_long[k] + long[k]].tolist(), tokens[at_short[k] : at_short[k] + short[k]].tolist())
    # no pair has fewer edits than its sizes differ by
    here = np.flatnonzero(left & (long <= LONGEST) & (long > short))
    plain = here[_left_out(tokens, at_short[here], short[here], at_long[here], long[here])]
    out[plain] = long[plain] - short[plain]
    left[plain] = False
    here = np.flatnonzero(left & (long <= LONGEST))
    words = np.cumsum((long[here] + 63) // 64)
    start = 0
    while start < len(here):
        done = words[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(words, done + TOGETHER, "right")))
        k = here[start:end]
        out[k] = _advance(tokens, at_long[k], long[k], at_short[k], short[k])
        start = end
    return out


def of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts one after the other, and how many each has."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.fromiter(map(len, texts), np.int64, len(texts))


def of_words(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, given out as they come."""
    known: dict[str, int] = {}
    numbers = [known.setdefault(w, len(known)) for words in texts for w in words]
    return np.array(numbers, np.int64), np.fromiter(map(len, texts), np.int64, len(texts))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts of an array without nulls, as `of_texts` gives them."""
    if not len(texts):
        return of_texts([])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    return np.frombuffer(str(data, "utf-8").encode("utf-32-le"), "<u4"), pc.utf8_length(texts).to_numpy().astype(np.int64)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of the texts of an array without nulls, as `of_words` gives them; white space is that of `str.split`."""
    lists = pc.utf8_split_whitespace(texts)
    words = lists.flatten()
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    numbers = words.filter(pa.array(there)).dictionary_encode().indices.to_numpy().astype(np.int64)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    upto = np.concatenate([[0], np.cumsum(there)])[ends]
    return numbers, np.diff(upto, prepend=0)
