"""Language identification against brute force and on held-out rows."""

import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import cases
import pytest
import regex
from linewright.llm import language_id


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4


def words_by_hand(text):
    return regex.findall(r"\p{L}+", unicodedata.normalize("NFC", (text or "").lower()))


def by_hand(rows, min_rows=language_id.MIN_ROWS):
    """(lang, score) of each row; every row that may be used trains."""
    times, in_rows = defaultdict(Counter), Counter()
    for i, text, _, lang in rows:
        if lang is not None and text is not None and fold(i) != 2:
            found = words_by_hand(text)
            times[lang].update(found)
            in_rows.update(set(found))
    langs = sorted(lang for lang in times if times[lang])
    tables = [{lang: Counter({w: n for w, n in times[lang].items() if in_rows[w] >= min_rows}) for lang in langs}]
    for n in range(1, 6):
        own = {lang: Counter() for lang in langs}
        for lang in langs:
            for w, many in times[lang].items():
                padded = w if n == 1 else f" {w} "
                for i in range(len(padded) - n + 1):
                    own[lang][padded[i : i + n]] += many
        tables.append(own)

    def log(kind, lang, term):
        table = tables[kind]
        size = len(set().union(*table.values()))
        return math.log((table[lang][term] + 0.5) / (sum(table[lang].values()) + 0.5 * max(size, 1)))

    known = [set().union(*t.values()) for t in tables]
    out = []
    for _, text, *_ in rows:
        found = words_by_hand(text)
        if not found or not langs:
            out.append(("und", 0.0))
            continue
        total = dict.fromkeys(langs, 0.0)
        for w, many in Counter(found).items():
            if w in known[0]:
                kind, terms = 0, [w]
            else:
                for kind in (5, 4, 3, 2, 1):
                    padded = w if kind == 1 else f" {w} "
                    terms = [g for i in range(len(padded) - kind + 1) if (g := padded[i : i + kind]) in known[kind]]
                    if terms:
                        break
            if terms:
                for lang in langs:
                    total[lang] += many * sum(log(kind, lang, t) for t in terms) / len(terms)
        best = max(langs, key=lambda lang: (total[lang], [-b for b in lang.encode()]))
        out.append((best, 1 / sum(math.exp(total[x] - total[best]) for x in langs)))
    return out


LETTERS = {"en": "etaoinshrdlu", "de": "enisratdhulcß", "fr": "esaitnruloéèç", "": "кбонтве"}


def speech(rng, lang, vocabulary, n):
    return " ".join(rng.choice(vocabulary[lang]) if rng.random() < 0.8 else "".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = {lang: ["".join(rng.choice(of) for _ in range(rng.randrange(1, 8))) for _ in range(150)] for lang, of in LETTERS.items()}
    out = [(i, speech(rng, lang, vocabulary, rng.randrange(3, 60)), "s", lang) for i in range(240) for lang in [list(LETTERS)[i % 4]]]
    out += [(1000, None, "s", "en"), (1001, "", "s", "en"), (1002, " 12 ²³ --\n", "s", "de"), (1003, out[2][1], "s", None), (1004, "Ωmega 日本語 x", "s", None)]
    out += [(None, out[5][1], "s", "de"), out[7], out[7], (1005, "Ecolé É é ECOLE", "s", "fr"), (1006, speech(rng, "fr", vocabulary, 30_000), "s", "fr"), (1007, "x9y_z's", "s", None)]
    return out


def test_language_like_brute_force(spark, rows):
    """Row by row, as ids may be null or repeated."""
    got = language_id.identified(cases.frame(spark, rows, extra=True), 4, 2).collect()
    left = defaultdict(list)
    for r in got:
        left[r.doc_id].append((r.lang_pred, r.score))
        assert r.held_out == (fold(r.doc_id) == 2) and 0 <= r.score <= 1
    right = defaultdict(list)
    for r, w in zip(rows, by_hand(rows), strict=True):
        right[r[0]].append(w)
    assert left.keys() == right.keys()
    for k in left:
        for (lang, score), (want, expected) in zip(sorted(left[k]), sorted(right[k]), strict=True):
            assert lang == want and score == pytest.approx(expected, abs=1e-9), k


def test_held_out_languages(spark, rows):
    got = {r.doc_id: r for r in language_id.identified(cases.frame(spark, rows), 4, 2).collect()}
    held = [(r[3], got[r[0]].lang_pred) for r in rows[:240] if got[r[0]].held_out]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.98 * len(held)


def test_labels_of_the_held_out_fold_are_not_used(spark, rows):
    docs = cases.frame(spark, rows)
    wrong = cases.frame(spark, [(i, t, s, "xx" if fold(i) == 2 else lang) for i, t, s, lang in rows])
    a, b = (sorted(map(str, language_id.identified(d, 4, 2).collect())) for d in (docs, wrong))
    assert a == b


def test_sample_is_bounded_and_nothing_to_learn(spark, rows):
    docs = cases.frame(spark, rows)
    assert {r.lang: r["count"] for r in language_id.sampled(docs, 4, 2, 10).groupBy("lang").count().collect()}["en"] <= 12
    unknown = cases.frame(spark, [(i, t, s, None) for i, t, s, _ in rows])
    assert {(r.lang_pred, r.score) for r in language_id.identified(unknown, 4, 2).collect()} == {("und", 0.0)}
    assert language_id.identified(docs.limit(0), 4, 2).count() == 0
