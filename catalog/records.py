"""Queries on run records, verification, exports and file round trips.

`events` stands for a metrics log (model = event type, split = a share of users), `documents` with `labels` for a log
with sidecars, `orders` with `lineitem` for reported and expected counts, `customer` with `orders` for two states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.corpus import ACCEPTED, corpus
from catalog.registry import query
from catalog.text import LINES, label_lines
from catalog.views import PAIRS, SCORED, documents, labels, pairs, rounded, sql, table
from linewright.functions.text import classify_param, phantom_flag
from linewright.operators import audit, charset, export, keep, runs, sampling, scoring
from linewright.operators.pairs import pair_counts
from linewright.session import scratch_dir
from linewright.sinks import corpus as corpus_sinks
from linewright.sinks import runs as run_sinks
from linewright.sources import images, records
from linewright.sources import labels as label_sources
from linewright.sources.lines import number_lines, read_lines

# --- metrics log ----------------------------------------------------------------------------------------------

_SPLIT_OF = "case user_id % 4 when 0 then 'test' when 1 then 'val' when 2 then 'train' else 'other' end"
_MODEL_OF = "concat(event_type, '_', cast(user_id as varchar(20)))"
LOG_ORDER = ["ts", "event_id"]
LOG = f"""
log as (select {_MODEL_OF} as model, {_SPLIT_OF} as split, event_id % 500 as n, value as cer, ts, event_id from events),
last_rows as (select * from log qualify row_number() over (partition by model, split order by ts desc, event_id desc) = 1)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.expr(_MODEL_OF).alias("model"),
        F.expr(_SPLIT_OF).alias("split"),
        (F.col("event_id") % 500).alias("n"),
        F.col("value").alias("cer"),
        "ts",
        "event_id",
    )


@query("f02_keep_last_per_key", sql("select model, split, n, cer, event_id from last_rows", LOG))
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = keep.last_per_key(log(spark, sf_dir), ["model", "split"], LOG_ORDER)
    return last.select("model", "split", "n", "cer", "event_id")


# A model runs on several splits here, so there is something to prefer; models of type `view` have no test rows.
_TYPED_MODEL = "concat(event_type, '_', cast(user_id % 40 as varchar(20)))"
_TYPED_SPLIT = """case when user_id % 4 = 0 and event_type <> 'view' then 'test' when user_id % 5 = 0 then 'val'
  when user_id % 7 = 0 then 'train' else concat('extra', cast(user_id % 3 as varchar(20))) end"""
_TYPED = f"""
typed as (select {_TYPED_MODEL} as model, {_TYPED_SPLIT} as split, event_id % 500 as n, value as cer, ts, event_id from events),
typed_last as (select *, min(struct_pack(a := ts, b := event_id)) over (partition by model, split) as seen from typed
  qualify row_number() over (partition by model, split order by ts desc, event_id desc) = 1)"""


def typed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.expr(_TYPED_MODEL).alias("model"),
        F.expr(_TYPED_SPLIT).alias("split"),
        F.expr("event_id % 500").alias("n"),
        F.col("value").alias("cer"),
        "ts",
        "event_id",
    )


@query(
    "f03_split_preference",
    sql(
        """
select model, split, n, cer, event_id from typed_last
qualify row_number() over (partition by model order by case split when 'test' then 0 when 'val' then 1 when 'train' then 2
  else 3 end, seen) = 1""",
        _TYPED,
    ),
)
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep.prefer_split(typed_log(spark, sf_dir), LOG_ORDER).select("model", "split", "n", "cer", "event_id")


@query("f05_latest_row_for_model", sql("select model, split, n, event_id from log where model = 'click_7' order by ts desc, event_id desc limit 1", LOG))
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep.latest_for(log(spark, sf_dir), "click_7", LOG_ORDER).select("model", "split", "n", "event_id")


@query("c08_model_row_filter", sql("select split, n, cer, event_id from log where model = 'click_7' order by ts desc, event_id desc limit 5", LOG))
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["split", "n", "cer", "der", "der_n", "event_id"]
    return keep.recent_rows(log(spark, sf_dir), "click_7", wanted, LOG_ORDER)


@query("h05_distinct_splits", sql("select distinct coalesce(nullif(split, 'other'), 'test') as split from log", LOG))
def h05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).withColumn("split", F.nullif(F.col("split"), F.lit("other")))
    return audit.distinct_splits(rows)


# --- provenance -----------------------------------------------------------------------------------------------

# A document is a metrics row; its label row, if any, is its sidecar; the page of its number, if any, its checkpoint.
# Every 7th log row says phantom itself, and every 11th sidecar is unreadable.
_AUDIT = """
audited as (
  select d.doc_id, l.doc_id is not null as has_file, l.doc_id is not null and d.doc_id % 11 <> 0 as has_meta,
    d.doc_id % 7 = 0 as says_phantom, l.toxic = 1 as meta_phantom, l.quality,
    p.page_id is null as gone
  from documents d left join labels l on d.doc_id = l.doc_id left join pages p on p.page_id = d.doc_id
),
judged as (
  select *, case when has_file and not has_meta then 'no_meta' when not has_file and says_phantom then 'phantom'
    when not has_file then 'no_meta' when meta_phantom then 'phantom' when gone then 'stale' else 'ok' end as status,
    array_to_string(list_filter([
      case when not has_file and says_phantom then 'log says phantom but there is no sidecar' end,
      case when has_file and not has_meta then 'unreadable sidecar' end,
      case when has_meta and meta_phantom then 'head weights not restored: ' || (quality + 1) end,
      case when has_meta and gone then 'checkpoint missing on disk: ckpt/' || doc_id || '.pdparams' end],
      lambda x: x is not null), '; ') as notes
  from audited
)"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("model"),
        F.lit("test").alias("split"),
        F.expr("if(doc_id % 7 = 0, 'TRUE ', 'false')").alias("phantom"),
        "doc_id",
    )
    readable = F.expr("doc_id % 11 <> 0")
    sidecars = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("model"),
        F.lit("test").alias("split"),
        readable.alias("readable"),
        F.when(readable, F.expr("if(toxic = 1, 'true', 'false')")).alias("meta_phantom"),
        F.when(readable, F.expr("concat('ckpt/', doc_id, '.pdparams')")).alias("checkpoint_path"),
        F.when(readable, F.col("quality") + 1).alias("bad_head"),
    )
    files = table(spark, sf_dir, "pages").select(F.expr("concat('ckpt/', page_id, '.pdparams')").alias("path"))
    return audit.provenance_audit(rows, sidecars, files)


@query("j04_provenance_audit", sql("select doc_id, status, notes from judged", _AUDIT))
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).select("doc_id", "status", F.array_join("notes", "; ").alias("notes"))


@query(
    "d18_audit_status_counts",
    sql("select s.status, count(j.doc_id) as n from (values ('ok'), ('phantom'), ('no_meta'), ('stale')) as s(status) "
        "left join judged j on j.status = s.status group by s.status", _AUDIT),
)
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.status_counts(audited(spark, sf_dir))


@query("e02_metrics_meta_join", "select d.doc_id, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id")
def e02(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.lit("test").alias("split")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("model"), split)
    sidecars = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("model"), split, "quality", "toxic")
    return audit.join_sidecars(rows, sidecars).select(F.col("model").alias("doc_id"), "quality", "toxic")


@query("e03_stale_artifact_join", sql("select doc_id from judged where has_meta and gone", _AUDIT))
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).where("ckpt_missing").select("doc_id")


@query(
    "c11_phantom_flag",
    """
select doc_id, case when doc_id % 13 = 0 then 'unknown' when source in ('src1', 'src2') then 'n/a'
  when doc_id % 6 = 0 then 'unknown' when coalesce(quality, 0) + coalesce(toxic, 0) > 0 then 'true' else 'false' end as phantom
from documents left join labels using (doc_id)""",
)
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kind = F.when(F.col("source") == "src1", "tesseract").when(F.col("source") == "src2", "qwen_vl").otherwise("crnn")
    flag = phantom_flag(
        F.expr("doc_id % 13 <> 0"), kind, F.expr("doc_id % 6 <> 0"), F.col("quality"), F.col("toxic")
    )
    return rows.select("doc_id", flag.alias("phantom"))


@query("d24_phantom_row_count", "select count(*) filter (toxic = 1) as n_phantom from labels")
def d24(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("phantom", F.expr("if(toxic = 1, 'true', 'n/a')"))
    return runs.phantom_count(rows)


# --- alignment and reconciliation -----------------------------------------------------------------------------

_ALIGN = """
expected as (select case l_linenumber % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split, count(*) as expected_pairs
  from lineitem group by 1),
reports as (
  select cast(o_orderkey as varchar) as model,
    case o_custkey % 4 when 0 then 'train' when 1 then 'val' when 2 then 'test' else 'dev' end as split,
    case when o_orderkey % 9 = 0 then '' when o_orderkey % 10 = 0 then 'n/a'
      when o_orderkey % 2 = 0 then cast((select expected_pairs from expected where split = case o_custkey % 4 when 0 then 'train'
        when 1 then 'val' else 'test' end) as varchar) else cast(o_orderkey as varchar) end as n
  from orders
),
mismatches as (
  select model, r.split, coalesce(try_cast(nullif(n, '') as bigint), 0) as reported_n, expected_pairs
  from reports r join expected e on r.split = e.split
  where (n = '' or try_cast(n as bigint) is not null) and coalesce(try_cast(nullif(n, '') as bigint), 0) <> expected_pairs
)"""


def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs_per_split = table(spark, sf_dir, "lineitem").select(
        F.expr("case l_linenumber % 3 when 0 then 'train' when 1 then 'val' else 'test' end").alias("split")
    )
    expected = audit.expected_counts(pairs_per_split)
    reports = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"),
        F.col("o_orderkey").cast("string").alias("model"),
        F.expr("case o_custkey % 4 when 0 then 'train' when 1 then 'val' when 2 then 'test' else 'dev' end").alias("split"),
    )
    right = expected.select("split", F.col("expected_pairs").cast("string").alias("right_n"))
    n = (
        F.when(F.col("o_orderkey") % 9 == 0, "")
        .when(F.col("o_orderkey") % 10 == 0, "n/a")
        .when(F.col("o_orderkey") % 2 == 0, F.col("right_n"))
        .otherwise(F.col("model"))
    )
    reports = reports.join(right, "split", "left").withColumn("n", n)
    return audit.alignment_mismatches(reports, expected)


@query("e04_alignment_join", sql("select * from mismatches", _ALIGN))
def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mismatches(spark, sf_dir)


@query(
    "g08_first10_mismatches",
    sql("select *, greatest((select count(*) from mismatches) - 10, 0) as more from mismatches order by reported_n, model limit 10", _ALIGN),
)
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.first_mismatches(mismatches(spark, sf_dir), ["reported_n", "model"])


@query("j05_alignment_check", sql("select e.split, e.expected_pairs, (select count(*) from mismatches m where m.split = e.split) as mismatches from expected e", _ALIGN))
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mismatches(spark, sf_dir).groupBy("split", "expected_pairs").agg(F.count("*").alias("mismatches"))
    expected = audit.expected_counts(
        table(spark, sf_dir, "lineitem").select(
            F.expr("case l_linenumber % 3 when 0 then 'train' when 1 then 'val' else 'test' end").alias("split")
        )
    )
    return expected.join(counted, ["split", "expected_pairs"], "left").fillna(0)


# The wanted state has one key per customer, the found state one per customer with orders and some keys of its own.
_STATE = """
names as (select k, case k % 5 when 0 then 'head.fc.' when 1 then 'Backbone.conv.' when 2 then 'neck.encoder.'
  when 3 then 'student.ctc_head.w' else 'loss.' end || k as key from (select distinct k from (
    select c_custkey as k from customer union all select o_custkey + o_custkey % 3 as k from orders))),
wanted as (select key, [k % 7, 3] as shape from customer join names on c_custkey = k),
found as (select key, [case when k % 8 = 0 then 99 else k % 7 end, 3] as shape
  from (select distinct o_custkey + o_custkey % 3 as k from orders) join names using (k)),
reconciled as (
  select key, case when f.shape is null then 'missing' when w.shape is null then 'extra' when w.shape = f.shape then 'restored'
    else 'shape_mismatch' end as status,
    case when regexp_matches(lower(key), '^head|\\.head\\.|\\.ctc_head\\.|ctc_encoder') then 'head'
      when regexp_matches(lower(key), '^(backbone|neck)') then 'backbone' else 'other' end as component
  from wanted w full join found f using (key)
)"""

_KEY = """concat(case k % 5 when 0 then 'head.fc.' when 1 then 'Backbone.conv.' when 2 then 'neck.encoder.'
  when 3 then 'student.ctc_head.w' else 'loss.' end, cast(k as string))"""


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    found = table(spark, sf_dir, "orders").select(F.expr("o_custkey + o_custkey % 3").alias("k")).distinct()
    return audit.reconcile(
        wanted.select(F.expr(_KEY).alias("key"), F.expr("array(k % 7, 3L)").alias("shape")),
        found.select(F.expr(_KEY).alias("key"), F.expr("array(if(k % 8 = 0, 99L, k % 7), 3L)").alias("shape")),
    )


@query("e07_state_reconcile", sql("select key, status, component from reconciled", _STATE))
def e07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled(spark, sf_dir).select("key", "status", "component")


@query("c13_classify_param", sql("select component, count(*) as n from reconciled where status <> 'extra' group by component", _STATE))
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select(F.expr(_KEY).alias("key"))
    return keys.groupBy(classify_param(F.col("key")).alias("component")).agg(F.count("*").alias("n"))


@query(
    "d21_component_counts",
    sql("select status, " + ", ".join(f"count(*) filter (component = '{c}') as {c}" for c in ("head", "backbone", "other"))
        + " from reconciled group by status", _STATE),
)
def d21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.component_counts(reconciled(spark, sf_dir))


@query(
    "j06_restoration_gate",
    sql("""
select count(*) filter (status <> 'extra') as n_wanted, count(*) filter (status <> 'missing') as n_found,
  count(*) filter (status = 'restored') as n_restored, count(*) filter (status = 'missing') as n_missing,
  count(*) filter (status = 'shape_mismatch') as n_shape_mismatch, count(*) filter (status = 'extra') as n_extra,
  count(*) filter (status = 'missing' and component = 'head') as head_missing,
  count(*) filter (status = 'shape_mismatch' and component = 'head') as head_shape_mismatch
from reconciled""", _STATE),
)
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.reconcile_summary(reconciled(spark, sf_dir))


@query(
    "e10_completeness_check",
    """
select d.doc_id as path, coalesce(quality + 1, 0)::bigint as items, l.doc_id is not null as present
from documents d left join labels l on l.doc_id = d.doc_id""",
)
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), (F.col("quality") + 1).alias("items"))
    return audit.completeness(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path")), found)


# --- images and inventory -------------------------------------------------------------------------------------


@query("e01_image_exists_join", sql("select line_no, has_image from labels"))
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels(spark, sf_dir).drop("has_image").withColumn("path", F.col("line_no").cast("string"))
    listing = labels(spark, sf_dir).where("has_image").select(F.col("line_no").cast("string").alias("path"))
    return images.flag_existing_image(rows, listing).select("line_no", "has_image")


@query("a03_file_listing", sql("select split, count(*) filter (has_image) as present, count(*) filter (not has_image) as missing from labels group by split"))
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels(spark, sf_dir).select("split", F.col("line_no").alias("path"))
    listing = labels(spark, sf_dir).where("has_image").select(F.col("line_no").alias("path"))
    there = images.with_existing_image(rows, listing).groupBy("split").agg(F.count("*").alias("present"))
    gone = images.with_missing_image(rows, listing).groupBy("split").agg(F.count("*").alias("missing"))
    return there.join(gone, "split", "full_outer").fillna(0)


@query(
    "a04_image_dims",
    sql("select line_no, width, height from labels"),
)
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is the head of a file of some format, where its size fits that format; without a size it is no image."""

    def big(c, n: int):
        return F.unhex(F.lpad(F.hex(c.cast("long")), 2 * n, "0"))

    def little(c, n: int):
        return F.unhex(F.concat(*(F.lpad(F.hex(F.pmod(F.shiftright(c.cast("long"), 8 * k), F.lit(256))), 2, "0") for k in range(n))))

    def plain(digits: str):
        return F.unhex(F.lit(digits))

    w, h = F.col("width"), F.col("height")
    exif = F.concat(plain("FFD8FFE1"), big(F.length("text") % 60000 + 2, 2), F.substring("text", F.lit(1), F.length("text") % 60000).cast("binary"))
    heads = [
        F.concat(plain("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4)),
        F.concat(plain("424D" + 12 * "00" + "28000000"), little(w, 4), little(-h, 4)),
        F.concat(plain("52494646000000005745425056503858" + 8 * "00"), little(w - 1, 3), little(h - 1, 3)),
        F.concat(plain("49492A00080000000200" + "0001040001000000"), little(w, 4), plain("0101040001000000"), little(h, 4)),
        F.concat(plain("474946383961"), little(w, 2), little(h, 2)),
        F.concat(exif, plain("FFC2000B08"), big(h, 2), big(w, 2), plain("01")),
    ]
    kind = F.col("line_no") % F.when(w < 65536, 6).otherwise(4)
    content = F.coalesce(*(F.when(kind == k, head) for k, head in enumerate(heads)), F.col("text").cast("binary"))
    sized = labels(spark, sf_dir).select("line_no", images.content_size(content).alias("size"))
    return sized.select("line_no", "size.width", "size.height")


ALL_LINES = LINES + """,
every_line as (select *, case when contains(value, chr(9)) then substr(value, strpos(value, chr(9)) + 1) end as text,
  case when contains(value, chr(9)) then split_part(value, chr(9), 1) end as rel_path from lines)"""
INVENTORY = ALL_LINES + """,
parsed as (select * from every_line where value <> '')"""


def parsed_lines(spark: SparkSession, sf_dir: str, split=label_sources.label_parts) -> DataFrame:
    parts = split(label_lines(spark, sf_dir))
    good = F.size("parts") == 2
    return parts.select(
        "split", "line_no", "has_image", F.when(good, F.col("parts")[0]).alias("rel_path"), F.when(good, F.col("parts")[1]).alias("text")
    )


@query(
    "d20_inventory_summary",
    sql(
        f"""
select split, count(*) as lines_in_file, count(text) as tab_parsed_rows, count(text) filter (has_image) as pairs_with_existing_image,
  count(text) filter (not has_image) as missing_image, (min(length(text)) filter (has_image))::int as char_len_min,
  (max(length(text)) filter (has_image))::int as char_len_max, {rounded('avg(length(text)) filter (has_image)', 4)} as char_len_mean
from every_line group by split""",
        ALL_LINES,
    ),
)
def d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.inventory(parsed_lines(spark, sf_dir, label_sources.line_parts), ["split"])


# --- export ---------------------------------------------------------------------------------------------------

PROMPT = "Transcribe the line."


@query(
    "b07_sft_jsonl_export",
    sql(
        """
select split, regexp_replace(regexp_replace(rel_path, '.*/', ''), '[.]png$', '') as id, rel_path as source_relative,
  'data/' || rel_path as source_image, text as gt, 'image' as first_part, 2 as turns
from parsed where text is not null and has_image""",
        INVENTORY,
    ),
)
def b07(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = export.chat_samples(parsed_lines(spark, sf_dir), "/repo/data", "/repo", PROMPT)
    path = scratch_dir(spark, "chat")
    corpus_sinks.chat_sink(samples, path)
    record = F.col("value")
    rows = spark.read.text(path).where(F.length("value") > 0)

    def field(json_path: str):
        return F.get_json_object(record, json_path)

    return rows.select(
        "split",
        field("$.id").alias("id"),
        field("$.source_relative").alias("source_relative"),
        field("$.source_image").alias("source_image"),
        field("$.messages[1].content").alias("gt"),
        field("$.messages[0].content[0].type").alias("first_part"),
        F.size(F.from_json(field("$.messages"), "array<struct<role: string>>")).alias("turns"),
    )


@query(
    "b07_skipped_lines",
    sql(
        """
select split, line_no as line, case when text is null then 'not_two_tab_fields' else 'missing_image' end as reason, rel_path as path
from parsed where text is null or not has_image""",
        INVENTORY,
    ),
)
def b07_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.skipped_lines(parsed_lines(spark, sf_dir))


def digest_tree(source: str) -> str:
    """SQL of the digest tree over a table with `split`, `no`, `part`; its root is the table `t5`."""
    levels, below = [], source
    for k in range(1, export.LEVELS + 1):
        levels.append(
            f"t{k} as (select split, no // {export.FAN_IN} as no, sha256(string_agg(part, chr(10) order by no)) as part "
            f"from {below} group by split, no // {export.FAN_IN})"
        )
        below = f"t{k}"
    return ",\n".join(levels)


def flat_digest(source: str) -> str:
    """SQL of the flat digests as the table `flat`."""
    return f"flat as (select split, case when count(*) <= {export.FLAT} then sha256(string_agg(part, chr(10) order by no)) end as part from {source} group by split)"


@query(
    "b08_export_manifest",
    sql(
        """
select p.split, count(text) filter (has_image) as exported, count(*) filter (text is null) as skipped_malformed,
  count(text) filter (not has_image) as skipped_missing_image, any_value(t5.part) as ids_tree_sha256, any_value(flat.part) as ids_sha256
from parsed p left join t5 on t5.split = p.split left join flat on flat.split = p.split group by p.split""",
        INVENTORY
        + """,
ids as (select split, line_no as no, regexp_replace(regexp_replace(rel_path, '.*/', ''), '[.]png$', '') as part
  from parsed where text is not null and has_image),
"""
        + digest_tree("ids")
        + ",\n"
        + flat_digest("ids"),
    ),
)
def b08(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parsed_lines(spark, sf_dir)
    return export.export_manifest(lines, export.chat_samples(lines, "/repo/data", "/repo", PROMPT), export.FLAT)


_TURNS = "ids as (select role as split, {no} as no, conv_id || '-' || turn as part from conversations),\n"


def turn_ids(spark: SparkSession, sf_dir: str, no: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("role").alias("split"),
        F.expr(no).alias("line_no"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
    )


@query(
    "d19_ordered_ids_hash",
    "with " + _TURNS.format(no="conv_id * 1000 + turn").rstrip(",\n") + "\nselect split, sha256(string_agg(part, chr(10) order by no)) as ids_sha256 from ids group by split",
)
def d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.ids_digest(turn_ids(spark, sf_dir, "conv_id * 1000 + turn"))


@query("d19_ids_tree_digest", "with " + _TURNS.format(no="conv_id * 1000000000 + turn") + digest_tree("ids") + "\nselect split, part as ids_tree_sha256 from t5")
def d19_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.ids_tree_digest(turn_ids(spark, sf_dir, "conv_id * 1000000000 + turn"))


@query(
    "b11_review_sample",
    sql("""
select rel_path as relative_path, '/repo/data/' || rel_path as absolute_path, text as gt, cast(length(text) as int) as gt_char_len
from labels where has_image order by md5('42' || line_no), line_no limit 20"""),
)
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.review_sample(labels(spark, sf_dir).where("has_image"), "line_no", 20, 42, "/repo/data")


# --- file round trips -----------------------------------------------------------------------------------------


@query("a01_export_scan", sql("select distinct export_id, dir_name from labels"))
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.expr("if(doc_id % 10 = 3, concat('/raw/notes_', export_id, 'x/readme/train.txt'), null)")
    path = F.concat(F.lit("/raw/"), "dir_name", F.lit("/labels/"), "split", F.lit(".txt"))
    paths = labels(spark, sf_dir).select(F.explode(F.array_compact(F.array(path, other))).alias("path"))
    return label_sources.export_scan(paths)


@query("b01_label_sink", sql("select split, 'images/' || split || '/' || file_name as rel_path, text from accepted", ACCEPTED))
def b01(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "labels")
    corpus_sinks.label_sink(corpus(spark, sf_dir).accepted, path)
    return label_sources.parse_labels(label_sources.read_split_lines(spark, path)).select("split", "rel_path", "text")


@query("a09_label_count", sql("select split, count(*) filter (trim(value) <> '') as n from lines group by split", LINES))
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "lines")
    label_lines(spark, sf_dir).select("split", "value").write.partitionBy("split").text(path)
    out = None
    for split in ("train", "val", "test"):
        one = label_sources.label_count(spark.read.text(f"{path}/split={split}")).withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    return out.select("split", "n")


@query("b02_char_dict_sink", sql("select distinct ch from (select unnest(string_split(text, '')) as ch from accepted) where ch not in ('', ' ')", ACCEPTED))
def b02(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "dictionary")
    corpus_sinks.char_dict_sink(charset.char_dictionary(corpus(spark, sf_dir).accepted), path)
    return label_sources.read_char_dict(spark, path)


@query("a08_char_dict_scan", "select distinct ch from (select unnest(string_split(text, '')) as ch from benchmark) where ch not in ('', chr(10))")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "characters")
    chars = charset.char_counts(table(spark, sf_dir, "benchmark")).select(F.col("ch").alias("value"))
    chars.write.text(path)
    return label_sources.read_char_dict(spark, path)


@query(
    "b05_sample_jsonl_sink",
    sql("select pred, gt, round(cer, 6) as cer, round(wer, 6) as wer, round(der, 6) as der, count(*) as n from scored group by all", SCORED),
)
def b05(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "scored")
    corpus_sinks.scored_rows_sink(scoring.score_rows(pairs(spark, sf_dir)), path)
    rows = records.read_scored_rows(spark, path).withColumns({m: F.round(m, 6) for m in ("cer", "wer", "der")})
    return pair_counts(rows.select("pred", "gt", "cer", "wer", "der"), "n")


@query(
    "a06_sample_jsonl_scan",
    sql("select count(*) as n, 0::bigint as mismatches from pairs", PAIRS),
)
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "replayed")
    corpus_sinks.scored_rows_sink(scoring.score_rows(pairs(spark, sf_dir)), path)
    return scoring.replay_mismatches(records.read_scored_rows(spark, path)).select("n", "mismatches")


@query(
    "b03_report_sink",
    sql(
        """
select (select count(*) from accepted) as unique_images_total, (select count(*) from judged where reason = 'missing_image') as missing_image,
  true as stamped""",
        ACCEPTED,
    ),
)
def b03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linewright.plans.consolidate import report

    path = scratch_dir(spark, "report")
    corpus_sinks.report_sink(report(corpus(spark, sf_dir), labels(spark, sf_dir)), path)
    schema = "unique_images_total long, timestamp string, hygiene struct<drop_counts: map<string, long>>"
    return spark.read.schema(schema).json(path).select(
        "unique_images_total",
        F.col("hygiene.drop_counts")["missing_image"].alias("missing_image"),
        F.col("timestamp").isNotNull().alias("stamped"),
    )


_OLD_HEADER = ["model", "split", "n", "cer", "wer"]


@query(
    "b04_metrics_append",
    sql("select model, split, cast(n as varchar) as n, cast(null as varchar) as wer from log", LOG),
)
def b04(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "metrics")
    rows = log(spark, sf_dir).select("model", "split", "n", "cer", "event_id")
    # An older log without the newer columns comes first; the rows appended to it have to fit its header.
    run_sinks.align_columns(rows.where("event_id % 2 = 0"), _OLD_HEADER).write.csv(path, header=True, emptyValue="")
    run_sinks.metrics_append(rows.where("event_id % 2 <> 0").withColumn("phantom", F.lit("n/a")), path)
    return records.read_metrics_log(spark, path).drop("log_ord", "cer")


@query(
    "a05_metrics_csv_scan",
    sql("select model, split, n, cer from log", LOG),
)
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "log")
    log(spark, sf_dir).select("model", "split", "n", "cer").write.csv(path, header=True)
    return records.typed_metrics(records.read_metrics_log(spark, path)).select("model", "split", "n", "cer")


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("model"), F.lit("test").alias("split")).agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first")
    )
    nothing = F.lit(None).cast("double")
    metrics = rows.select(
        "model", "split", "n", nothing.alias("cer"), nothing.alias("wer"), nothing.alias("der"), F.lit(0).alias("der_n"),
        nothing.alias("der_insertion_rate"),
    )
    integrity = F.struct(
        F.concat(F.lit("ckpt/"), "model").alias("ckpt_prefix"),
        F.create_map(F.lit("head"), F.lit(2).cast("long")).alias("missing_by_component"),
        F.create_map(F.lit("head"), F.lit(0).cast("long")).alias("shape_mismatch_by_component"),
    )
    kind = F.when(F.col("first") % 2 == 0, "tesseract").otherwise("crnn")
    provenance = rows.select(
        "model",
        "split",
        F.struct(
            kind.alias("model_kind"), F.lit(None).cast("string").alias("ckpt_prefix"), F.lit("dict.txt").alias("dict_path"),
            F.lit(None).cast("string").alias("rec_config"), integrity.alias("checkpoint_integrity"),
        ).alias("provenance"),
    )
    digests = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("ckpt/"), "source", F.lit(".pdparams")).alias("path"), F.sha2("source", 256).alias("sha256"), F.lit(1).alias("lines")
    ).distinct()
    return run_sinks.sidecar_rows(metrics, provenance, digests)


@query(
    "b06_provenance_sink",
    """
select source as model, 'test' as split, count(*) as n, case when min(doc_id) % 2 = 0 then 'n/a' else 'true' end as phantom,
  sha256(source) as checkpoint_sha256, 2::bigint as bad_head
from documents group by source""",
)
def b06(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "meta")
    run_sinks.provenance_sink(_sidecars(spark, sf_dir), path)
    integrity = F.col("provenance.checkpoint_integrity")
    return records.read_sidecars(spark, f"{path}/*").select(
        "model", "split", F.col("metrics.n").alias("n"), "phantom",
        F.col("artifacts.checkpoint_sha256").alias("checkpoint_sha256"),
        (integrity["missing_by_component"]["head"] + integrity["shape_mismatch_by_component"]["head"]).alias("bad_head"),
    )


@query("a07_meta_json_scan", "select count(distinct source) as sidecars, 0::bigint as unreadable from documents")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "sidecars")
    run_sinks.provenance_sink(_sidecars(spark, sf_dir), path)
    return records.read_sidecars(spark, f"{path}/*").agg(
        F.count("*").alias("sidecars"),
        F.count_if(F.col("model").isNull() & F.col("_corrupt").isNotNull()).alias("unreadable"),
    )


@query(
    "b09_compiled_csv",
    f"""
select source as model_label, source as display_name, format('{{:.1f}}', (count(*) / 7.0::double) * 100) as cer_pct,
  '—' as wer_pct, '—' as der_pct, cast(count(*) as varchar) as n
from documents group by source""",
)
def b09(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "compiled")
    docs = table(spark, sf_dir, "documents")
    rows = docs.groupBy(F.col("source").alias("model")).agg(F.count("*").alias("n"), (F.count("*") / 7.0).alias("cer"))
    rows = rows.withColumns({"wer": F.lit(None).cast("string"), "der": F.lit("")})
    order = docs.select(F.col("source").alias("model")).distinct().select(
        "model", F.expr("cast(substring(model, 4) as int)").alias("ord"), F.lit(None).cast("string").alias("display")
    )
    runs.compiled_csv(runs.in_display_order(rows, order), path, f"{path}-alias")
    return spark.read.csv(f"{path}-alias", header=True)


@query("a02_numbered_lines", "select doc_id, len(string_split(text, chr(10))) as n from documents where text <> ''")
def a02_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "numbered")
    each = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    each.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "line").alias("value")).write.text(path)
    numbered = number_lines(read_lines(spark, path)).withColumn("doc_id", F.split("value", "\t", 2)[0].cast("long"))
    # The lines of a document are written together, so their numbers span exactly as many lines as there are.
    span = F.max("line_no") - F.min("line_no") + 1
    return numbered.groupBy("doc_id").agg(F.when(span == F.count_distinct("line_no"), span).cast("long").alias("n"))
