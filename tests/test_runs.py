import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from linewright.operators import audit, keep, runs
from linewright.operators.predict import batch_predict, failure_counts, with_configs
from linewright.plans.compile import compile_tables
from linewright.plans.evaluate import evaluate, record
from linewright.constants import METRICS_COLUMNS
from linewright.sinks.runs import align_columns, log_header, metrics_append
from linewright.sources import records, stores

# Rates of a metrics log in file order, with runs repeated later in the log.
LOG = [
    ("eng", "test", "326", "1.2035", "1.5347", "0.9847", "n/a"),
    ("yor", "test", "326", "9.9", "9.9", "9.9", "n/a"),
    ("zero_shot", "test", "326", "1.0", "1.0", "1.0", "n/a"),
    ("pretrained", "test", "326", "1.7448", "1.0", "0.8397", "true"),
    ("yor", "test", "326", "1.2435", "1.6366", "0.8773", "n/a"),
    ("zero_shot", "test", "326", "5.433", "8.4086", "2.0091", "n/a"),
    ("tuned", "val", "252", "0.1", "0.1", "0.1", "false"),
    ("tuned", "test", "326", "0.9654", "1.2264", "0.6644", "n/a"),
    ("only_dev", "dev", "9", "0.5", "", "", "false"),
    ("only_dev", "extra", "9", "0.4", "", "", "false"),
    ("only_dev", "dev", "10", "0.6", "", "", "false"),
]


@pytest.fixture
def log(spark):
    rows = [(i, *r) for i, r in enumerate(LOG)]
    return spark.createDataFrame(
        rows, "line int, model string, split string, n string, cer string, wer string, der string, phantom string"
    )


def test_compiled_table(spark, log):
    order = spark.createDataFrame(
        [("pretrained", 1, "Pretrained"), ("eng", 2, None), ("yor", 3, "Yor"), ("zero_shot", 4, "Zero"), ("never", 5, "Never"), ("tuned", 6, "Tuned")],
        "model string, ord int, display string",
    )
    out = compile_tables(log, order, ["line"])
    assert [tuple(r) for r in out["table"].collect()] == [
        ("pretrained", "Pretrained", "174.5", "100.0", "84.0", "326"),
        ("eng", "eng", "120.3", "153.5", "98.5", "326"),
        ("yor", "Yor", "124.4", "163.7", "87.7", "326"),
        ("zero_shot", "Zero", "543.3", "840.9", "200.9", "326"),
        ("tuned", "Tuned", "96.5", "122.6", "66.4", "326"),
    ]
    best = {r["metric"]: r["model"] for r in out["best"].collect()}
    assert best == {"cer": "tuned", "wer": "pretrained", "der": "tuned"}
    assert [r["model"] for r in out["missing"].collect()] == ["never"]
    assert runs.best_row(out["table"], "cer_pct").first()["model_label"] == "tuned"


def test_split_preference_falls_back_to_first_seen(log):
    got = keep.prefer_split(log, ["line"]).where("model = 'only_dev'").first()
    assert (got["split"], got["n"]) == ("dev", "10")
    assert keep.latest_for(log, "tuned", ["line"]).first()["split"] == "test"
    assert [r["n"] for r in keep.recent_rows(log, "only_dev", ["n", "absent"], ["line"]).collect()] == ["9", "9", "10"]


def test_best_per_column_ties_and_blanks(spark):
    rows = spark.createDataFrame(
        [("a", 2, "0.5", "", None), ("b", 1, "0.5", "0.7", None), ("c", 3, "", "0.1", None)],
        "model string, ord int, cer string, wer string, der string",
    )
    got = {r["metric"]: r["model"] for r in runs.best_per_column(rows).collect()}
    assert got == {"cer": "b", "wer": "c", "der": None}


def test_append_keeps_an_old_header(spark, tmp_path):
    path = str(tmp_path / "log")
    old = spark.createDataFrame([("m", "test", "1", "0.5")], "model string, split string, n string, cer string")
    align_columns(old, ["model", "split", "n", "cer", "wer"]).coalesce(1).write.csv(path, header=True, emptyValue="")
    metrics_append(old.withColumns({"model": F.lit("later"), "phantom": F.lit("true")}), path)
    rows = records.read_metrics_log(spark, path)
    assert rows.columns == ["model", "split", "n", "cer", "wer", "log_ord"]
    assert [r["model"] for r in rows.orderBy("log_ord").collect()] == ["m", "later"]
    assert records.typed_metrics(rows).first()["wer"] is None


def test_two_writers_of_a_fresh_log(spark, tmp_path):
    """Each append is whole, has a number of its own, and the header is one of the two."""
    path = str(tmp_path / "new" / "log")
    short = spark.createDataFrame([(f"s{k}", "test", "1") for k in range(3)], "model string, split string, n string")
    wide = spark.createDataFrame([(f"w{k}", "test", "2", "x") for k in range(3)], "model string, split string, n string, unknown string")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda k: metrics_append((short if k % 2 else wide).coalesce(1), path), range(8)))
    assert sorted(numbers) == list(range(1, 9))
    rows = records.read_metrics_log(spark, path)
    assert rows.columns == [*METRICS_COLUMNS, "log_ord"]
    models = [r["model"] for r in rows.orderBy("log_ord").collect()]
    by_number = sorted(range(8), key=lambda k: numbers[k])
    assert models == [f"{'s' if k % 2 else 'w'}{j}" for k in by_number for j in range(3)]
    assert not [n for n in os.listdir(path) if n.startswith("_aside") or n.endswith(".tmp")]
    assert metrics_append(short.limit(0), path) == 9 and rows.count() == 24


def test_header_is_settled_once(spark, tmp_path):
    path = str(tmp_path / "log")
    with ThreadPoolExecutor(6) as pool:
        headers = list(pool.map(lambda k: log_header(spark, path), range(6)))
    assert all(h == list(METRICS_COLUMNS) for h in headers)
    with ThreadPoolExecutor(6) as pool:
        claims = list(pool.map(lambda k: stores.claimed(spark, f"{path}/one", str(k)), range(6)))
    assert sum(claims) == 1 and stores.small_text(spark, f"{path}/one") == str(claims.index(True))
    assert stores.small_text(spark, f"{path}/none") is None and stores.names_in(spark, f"{path}/none") == []


def test_provenance_audit(spark):
    log = spark.createDataFrame(
        [("ok", "t", "false"), ("ph", "t", "n/a"), ("none", "t", " TRUE"), ("none2", "t", None), ("stale", "t", ""), ("bad", "t", "true"), ("both", "t", "true")],
        "model string, split string, phantom string",
    )
    sidecars = spark.createDataFrame(
        [("ok", "t", "false", "a", 0, True), ("ph", "t", "True", None, 3, True), ("stale", "t", "n/a", "gone", 0, True),
         ("bad", "t", None, None, None, False), ("both", "t", "true", "gone", 2, True)],
        "model string, split string, meta_phantom string, checkpoint_path string, bad_head int, readable boolean",
    )
    files = spark.createDataFrame([("a",), ("a",)], "path string")
    audited = audit.provenance_audit(log, sidecars, files)
    got = {r["model"]: (r["status"], r["notes"]) for r in audited.collect()}
    assert {m: s for m, (s, _) in got.items()} == {
        "ok": "ok", "ph": "phantom", "none": "phantom", "none2": "no_meta", "stale": "stale", "bad": "no_meta", "both": "phantom"
    }
    assert got["both"][1] == ["head weights not restored: 2", "checkpoint missing on disk: gone"]
    assert {r["status"]: r["n"] for r in audit.status_counts(audited).collect()} == {"ok": 1, "phantom": 3, "no_meta": 2, "stale": 1}
    with pytest.raises(audit.CheckFailed):
        audit.require_no_phantom(audited)


def test_alignment(spark):
    log = spark.createDataFrame(
        [("a", "test", "3"), ("b", "test", ""), ("c", "test", "x"), ("d", "dev", "9"), ("e", None, "4"), ("f", "val", "1"), ("g", "test", "3.0"), ("h", "test", " 7 ")],
        "model string, split string, n string",
    )
    pairs = spark.createDataFrame([("test",)] * 3, "split string")
    rows = audit.alignment_mismatches(log, audit.expected_counts(pairs))
    assert sorted((r["model"], r["reported_n"]) for r in rows.collect()) == [("b", 0), ("h", 7)]
    first = audit.first_mismatches(rows, ["model"], 2).collect()
    assert [(r["model"], r["more"]) for r in first] == [("b", 0), ("h", 0)]
    bare = audit.alignment_mismatches(log.drop("split"), audit.expected_counts(pairs))
    assert ("e", 4) in {(r["model"], r["reported_n"]) for r in bare.collect()}
    none = audit.alignment_mismatches(log, audit.expected_counts(pairs, ("test", "val", "train")))
    assert {r["model"]: r["expected_pairs"] for r in none.collect()} == {"b": 3, "h": 3, "f": 0}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan
    with pytest.raises(audit.CheckFailed):
        audit.require_alignment(rows)


def test_restoration_gate(spark):
    wanted = spark.createDataFrame([("head.a", [3]), ("head.b", [4]), ("neck.c", [5]), ("other", [1])], "key string, shape array<long>")
    found = spark.createDataFrame([("head.a", [3]), ("head.b", [9]), ("x", [1]), ("other", [1])], "key string, shape array<long>")
    state = audit.reconcile(wanted, found)
    assert {r["key"]: r["status"] for r in state.collect()} == {
        "head.a": "restored", "head.b": "shape_mismatch", "neck.c": "missing", "x": "extra", "other": "restored"
    }
    with pytest.raises(audit.CheckFailed, match="1 head"):
        audit.require_restored_head(state)
    audit.require_restored_head(state, allow_head_reinit=True)
    assert audit.reconcile_sample(state, "missing").first()["key"] == "neck.c"


def test_evaluate_and_record(spark, tmp_path):
    def recognise(path):
        if path == "bad":
            raise OSError(path)
        return path.upper()

    rows = spark.createDataFrame([(1, "a", "A"), (2, "bad", "B"), (3, "é", "É")], "id int, path string, gt string")
    predicted = batch_predict(rows, recognise)
    assert failure_counts(predicted, []).first().asDict() == {"n": 3, "failed": 1}
    scored = evaluate(rows, recognise)
    assert {r["id"]: r["cer"] for r in scored.collect()} == {1: 0.0, 2: 1.0, 3: 0.0}
    for _ in range(2):
        record(scored, "upper", "test", str(tmp_path / "rows"), str(tmp_path / "log"))
    assert records.read_scored_rows(spark, str(tmp_path / "rows")).count() == 3
    stored = records.typed_metrics(records.read_metrics_log(spark, str(tmp_path / "log")))
    assert [(r["n"], r["cer"], r["phantom"]) for r in stored.collect()] == [(3, 0.3333, "unknown")] * 2
    configs = with_configs(rows, ["eng", "yor", "eng+yor"], unavailable="yor")
    assert {r["config"] for r in configs.collect()} == {"eng"} and configs.count() == 3


def test_unreadable_sidecar(spark, tmp_path):
    (tmp_path / "a_test.json").write_text(json.dumps({"model": "a", "split": "test", "phantom": "n/a", "metrics": {"n": 3, "cer": 0.5}}))
    (tmp_path / "b_test.json").write_text('{"model": "b", "spl')
    rows = {r["meta_file"].rsplit("/", 1)[1]: r for r in records.read_sidecars(spark, str(tmp_path / "*.json")).collect()}
    assert rows["a_test.json"]["metrics"]["cer"] == 0.5 and rows["a_test.json"]["_corrupt"] is None
    assert rows["b_test.json"]["model"] is None and rows["b_test.json"]["_corrupt"]
