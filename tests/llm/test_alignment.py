"""Token alignment against whole-text encoding, and perfect hashing."""

import random
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
from linewright.llm import perfect_hash, tokenizer_alignment
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

PATHS = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
ODD = [
    "<|endoftext|> a<|endoftext|>b <s></s> <unk> <0x41>",
    "two  spaces   three\n\nlines \n here\t\ttabs \r\nend;\r ();\r\n",
    " leading and trailing ",
    "\nstart\nNext 'll it's 'S don't nbsp  em 　wide \u0085nel\x1cfs",
    "real ▁ lower one eighth",
    "日本語 の テキスト 🙂🙂 á é\n日本 ﬁ ½ ² x²\n²",
    "a\x00b \x07 \x7f",
    " ",
    "\n",
    "#" * 500 + " " * 300 + "1234567890" * 30,
]


def tokens_by_hand(texts):
    """Per text (ids of A, byte ends), (ids of B, byte ends), each text encoded whole; None without tokens."""
    a, b = tokenizers.Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    vocabulary = {k: t for t, k in a.get_vocab().items()}
    byte_of = {ch: i for i, ch in bytes_to_chars().items()}
    out = []
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        spelled = [[bytes(byte_of[c] for c in vocabulary[k]) for k in ids_a]]
        spelled.append([bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in ids_b for p in [b.id_to_piece(k)]])
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
            out.append(None)
        else:
            out.append(tuple((ids, np.cumsum([len(s) for s in sp]).tolist()) for ids, sp in zip((ids_a, ids_b), spelled, strict=True)))
    return out


def bytes_to_chars():
    keep = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    table, n = {k: chr(k) for k in keep}, 0
    for k in range(256):
        if k not in table:
            table[k], n = chr(256 + n), n + 1
    return table


def by_hand(texts):
    links, groups = [], []
    for tokens in tokens_by_hand(texts):
        if tokens is None:
            links.append([])
            groups.append([])
            continue
        (a, ea), (b, eb) = tokens
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        own, j0 = [], 0
        for i in range(len(a)):
            while eb[j0] <= sa[i]:
                j0 += 1
            j = j0
            while j < len(b) and sb[j] < ea[i]:
                own.append((a[i], b[j]))
                j += 1
        links.append(own)
        cuts = sorted(set(ea) & set(eb))
        own, at = [], 0
        ia = ib = 0
        for cut in cuts:
            na, nb = ia, ib
            while na < len(a) and ea[na] <= cut:
                na += 1
            while nb < len(b) and eb[nb] <= cut:
                nb += 1
            own.append(",".join(map(str, a[ia:na])) + "|" + ",".join(map(str, b[ib:nb])))
            ia, ib, at = na, nb, cut
        groups.append(own)
    count = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for tokens, own, parts in zip(tokens_by_hand(texts), links, groups, strict=True):
        sizes = (0, 0) if tokens is None else (len(tokens[0][0]), len(tokens[1][0]))
        out.append((*sizes, len(parts), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), ";".join(parts)))
    return out


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("small", [False, True])
def test_alignment_like_whole_encoding(spark, monkeypatch, small):
    """Also with small buckets, a deep tree and several turns of the second pass."""
    rows = cases.awkward() + [(600 + i, t, "s", "en") for i, t in enumerate(ODD)]
    if small:
        for name, value in (("BUCKET", 64), ("LEAVES", 1), ("FAN_IN", 2), ("MOST_PAIRS", 1 << 14), ("AT_ONCE", 50), ("HELD", 100)):
            monkeypatch.setattr(tokenizer_alignment, name, value)
        monkeypatch.setattr(tokenizer_alignment, "MOST_PAIRS", 64 * 8)
    docs = cases.frame(spark, rows, extra=True).repartition(7)
    got = sorted((tuple(r) for r in tokenizer_alignment.alignments(docs, *PATHS).collect()), key=key)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, by_hand([r[1] for r in rows]), strict=True)), key=key)


def test_random_texts(spark):
    """Random runs of letters, signs and all kinds of white space."""
    rng = random.Random(8)
    signs = ["a", "B", "the", "é", "ß", "1", ".", "'s", " ", " ", "  ", "\n", "\n\n", "\t", " ", " ", "語", "́", "-", "\r\n", "\u0000"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))), None, None) for i in range(1500)]
    got = {r.doc_id: tuple(r)[1:] for r in tokenizer_alignment.alignments(cases.frame(spark, rows), *PATHS).collect()}
    want = by_hand([r[1] for r in rows])
    assert [got[i] for i in range(len(rows))] == want


def test_pair_table_and_empty_table(spark):
    rows = cases.awkward()
    counts, _ = tokenizer_alignment.counted(cases.frame(spark, rows), *PATHS)
    table = {(r.a_id, r.b_id): r.n for r in tokenizer_alignment.pair_table(counts, tokenizer_alignment.size_of(PATHS[1])).collect()}
    want = by_hand([r[1] for r in rows])
    assert sum(table.values()) == sum(w[3] for w in want)
    assert tokenizer_alignment.alignments(cases.frame(spark, rows).limit(0), *PATHS).count() == 0
    assert tokenizer_alignment.alignments(cases.frame(spark, rows).where(F.col("text").isNull()), *PATHS).agg(F.sum("n_a")).first()[0] == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 70_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False)
    table = perfect_hash.PerfectHash.of(keys)
    assert sorted(table.places(keys)) == list(range(n))
    again = perfect_hash.PerfectHash.restored(table.sizes, table.bits, table.keys)
    assert (again.verified(keys) == table.places(keys)).all()
    strange = np.setdiff1d(np.arange(1000), keys)
    assert (again.verified(strange) == -1).all()


def test_perfect_hash_refuses_repeated_numbers():
    with pytest.raises(ValueError):
        perfect_hash.PerfectHash.of(np.array([5, 7, 5]))
