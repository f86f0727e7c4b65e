"""The source audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import cases
import pytest
from linewright.llm import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def by_hand(rows, min_docs, top=10):
    """All rows (lang, source, part, item, value, rank)."""
    have, groups = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for _, text, source, lang in rows:
        found = TERM.findall(cases.lower(text))
        have[lang or ""].update(set(found))
        groups[lang or ""][source or ""].update(found)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in have[lang].items() if n >= min_docs), key=str.encode)
        whole = sum(sources.values(), Counter())

        def shares(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (counts[t] + 2) // total for t in kept]

        p = {s: shares(c) for s, c in sources.items()}
        q = shares(whole)
        for s in sources:
            pairs = [(o, sum((x - y) ** 2 // (x + y) for x, y in zip(p[s], p[o], strict=True))) for o in sources if o != s]
            terms = [(t, (x - y) ** 2 // (x + y)) for t, x, y in zip(kept, p[s], q, strict=True) if sources[s][t] and x > y]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def lettered(text):
    """Digits spelled as letters, so that made-up words differ."""
    return text and text.translate(str.maketrans("0123456789", "abcdefGHIJ"))


def got(docs, **options):
    return sorted(tuple(r) for r in source_divergence.divergences(docs, **options).collect())


@pytest.mark.parametrize("bits", [64, 4])
def test_audit_like_brute_force(spark, monkeypatch, bits):
    """Also with digests so short that nearly every term shares one, and with small blocks and tiles."""
    rows = [(i, lettered(t), s, lang) for i, t, s, lang in cases.awkward()]
    rows += [(900, "!!! 12 34", "bare", "en"), (901, None, "bare2", "xx"), (902, "Zz zZ Été", "src0", None)]
    want = by_hand(rows, 3)
    assert {r[2] for r in want} == {"pair", "term"} and len({r[1] for r in want}) > 4
    if bits == 4:
        monkeypatch.setattr(source_divergence, "TERMS", 50)
        monkeypatch.setattr(source_divergence, "SOURCES", 1)
    assert got(cases.frame(spark, rows, extra=True), min_docs=3, digest_bits=bits) == want


def test_many_sources_and_ties(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, lettered(" ".join(f"t{rng.randrange(30)}" if rng.random() < 0.9 else "é—x" for _ in range(12))), f"s{rng.randrange(40)}", "en") for i in range(150)]
    rows += [(500 + i, "aa bb cc dd ee ff gg hh ii jj kk ll mm nn", "ties", "en") for i in range(10)]
    monkeypatch.setattr(source_divergence, "SOURCES", 7)
    assert got(cases.frame(spark, rows)) == by_hand(rows, 10)


def test_no_kept_terms_and_no_rows(spark):
    rows = [(1, "one two", "a", "en"), (2, "three", "b", "en")]
    docs = cases.frame(spark, rows)
    assert got(docs) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert got(docs.limit(0)) == []
