"""The whole pipeline against brute force, and the registration of the queries."""

import random
import zlib
from collections import Counter

import cases
import corpus_pipeline
import numpy as np
import pytest
from test_copies import components_by_hand
from test_models import secret_corpus
from test_rules import measured_by_hand


def tables(spark, folder, rows):
    docs = cases.frame(spark, rows, extra=True)
    docs.write.parquet(f"{folder}/documents.parquet")
    items = [(1, "q " + " ".join(f"q{i}" for i in range(20))), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_pipeline_like_brute_force(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(7)
    rows = [r for r in cases.awkward() if r[0] != 305] + [(r[0] + 1000, *r[1:]) for r in secret_corpus(rng)[:100]]
    rows += [(3000, cases.prose(rng, 60) + " " + " ".join(f"Q{i}" for i in range(20)), "src1", "en")]
    tables(spark, str(tmp_path), rows)
    got = Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    left = []
    for r in rows:
        m = measured_by_hand(r[1])
        if m[0] >= 50 and 100 * m[5] <= 50 * m[0]:
            left.append(r)
    assert len(left) < len(rows) - 5
    components = components_by_hand(left, 5, 80)
    left = [r for r in left if r[0] is None or components[r[0]][1] == r[0]]
    left = [r for k, r in enumerate(left) if r[0] is None or r[0] not in {x[0] for x in left[:k]}]
    left = [r for r in left if r[0] != 3000]
    whole = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    import re

    want = Counter()
    for doc_id, text, *_ in left:
        text = re.sub(r'(?<=token = ")[0-9a-f]{40}|AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}', "[SECRET]", text)
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want[(doc_id, 0, 0, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert got == want


def test_stages_take_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), cases.awkward())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs.limit(0), str(tmp_path))
        assert left.count() == 0
        if name != "packing":
            assert left.columns == docs.columns


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert {"op1_url_filters", "op2_quality_rules", "op11_source_divergence"} <= set(entry.oracle_sql())
