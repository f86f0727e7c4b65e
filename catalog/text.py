"""Queries on label texts: checks, normalisation, paths, code points, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import LABELS, documents, labels, rounded, sql, table
from linewright.constants import BLOCKS, FOREIGN_WORDS, MONTHS_AND_NUMERALS, OTHER_BLOCK, WHITELIST
from linewright.functions import text as t
from linewright.functions.unicode import combining_marks, nfc, register
from linewright.operators.charset import char_counts
from linewright.operators.hygiene import with_reason
from linewright.sources.labels import malformed_labels, parse_labels

# --- normalisation --------------------------------------------------------------------------------------------

# The given texts are composed; acute and grave letters are taken apart first so that there is something to compose.
_APART = {"é": "e\u0301", "è": "e\u0300", "ó": "o\u0301", "í": "i\u0301", "É": "E\u0301", "È": "E\u0300"}


def _apart(column):
    for letter, parts in _APART.items():
        column = F.replace(column, F.lit(letter), F.lit(parts))
    return column


def _apart_sql(expression: str) -> str:
    for letter, parts in _APART.items():
        spelled = f"'{parts[0]}' || chr({ord(parts[1])})"
        expression = f"replace({expression}, '{letter}', {spelled})"
    return expression


@query(
    "c01_nfc_text",
    f"""
select doc_id, sha256(nfc_normalize(t)) as digest, length(t) as chars_apart, length(nfc_normalize(t)) as chars
from (select doc_id, {_apart_sql('text')} as t from documents)""",
)
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("text", _apart(F.col("text")))
    docs = docs.withColumn("nfc", nfc(F.col("text")))
    return docs.select(
        "doc_id",
        F.sha2("nfc", 256).alias("digest"),
        F.length("text").cast("long").alias("chars_apart"),
        F.length("nfc").cast("long").alias("chars"),
    )


# Letters that stay composed have one mark each.
_WITH_MARK = "".join(letter for letter in "éóèñçêüäöíÉÈÑÓÇÄÊÜÖÍ" if letter not in _APART)


@query(
    "k01_unicode_udfs",
    f"""
select doc_id, sha256(nfc_normalize(t)) as digest, length(regexp_replace(t, '[^\u0300\u0301{_WITH_MARK}]', '', 'g')) as marks
from (select doc_id, {_apart_sql('text')} as t from documents)""",
)
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("text", _apart(F.col("text")))
    return docs.select(
        "doc_id",
        F.expr("sha2(nfc_text(text), 256)").alias("digest"),
        F.expr("cast(length(combining_marks(text)) as bigint)").alias("marks"),
    )


_LETTERS = "éóèñçêüäöíÉÈÑÓÇÄÊÜÖÍ"
_MARK_OF = "\u0301\u0301\u0300\u0303\u0327\u0302\u0308\u0308\u0308\u0301\u0301\u0300\u0303\u0301\u0327\u0308\u0302\u0308\u0308\u0301"


@query(
    "i04_combining_marks",
    sql(
        f"""
select doc_id, line_no, translate(regexp_replace(text, '[^{_LETTERS}]', '', 'g'), '{_LETTERS}', '{_MARK_OF}') as marks
from labels"""
    ),
)
def i04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("doc_id", "line_no", combining_marks(F.col("text")).alias("marks"))


# --- label lines and checks -----------------------------------------------------------------------------------

# A label line is path, tab, text; every 29th lost its tab, every 31st has a second tab inside the text, and every
# 37th is empty.
_LINE = """case when line_no % 37 = 0 then ''
  when line_no % 29 = 0 then concat(rel_path, ' ', text)
  when line_no % 31 = 0 then concat(rel_path, chr(9), text, chr(9), lang)
  else concat(rel_path, chr(9), text) end"""


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("doc_id", "split", "line_no", "has_image", F.expr(_LINE).alias("value"))


LINES = LABELS + f""",
lines as (select doc_id, split, line_no, has_image, {_LINE} as value from labels)"""


@query(
    "a02_label_scan",
    sql(
        """
select split, line_no, split_part(value, chr(9), 1) as rel_path, substr(value, strpos(value, chr(9)) + 1) as text
from lines where contains(value, chr(9))""",
        LINES,
    ),
)
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_labels(label_lines(spark, sf_dir)).select("split", "line_no", "rel_path", "text")


@query(
    "c02_malformed_filter",
    sql("select split, count(*) as n from lines where value <> '' and not contains(value, chr(9)) group by split", LINES),
)
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed_labels(label_lines(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"))


def _bounded(words) -> str:
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)})($|[^\p{{L}}\p{{N}}_])"


CHECKS = {
    "c03a_invalid_foreign_letter": (t.has_foreign_letter, "regexp_matches(text, '(?i)[cqvxz]')"),
    "c03b_invalid_fill_blank": (t.has_fill_blank, r"regexp_matches(text, '\.{3,}|_{3,}')"),
    "c03c_invalid_equals": (t.has_equals, "contains(text, '=')"),
    "c03d_invalid_month_roman": (t.has_month_or_numeral, f"regexp_matches(text, '{_bounded(MONTHS_AND_NUMERALS)}')"),
    "c03e_invalid_stopword": (t.has_foreign_word, f"regexp_matches(text, '{_bounded(FOREIGN_WORDS)}')"),
}
INVALID = "(" + " or ".join(condition for _, condition in CHECKS.values()) + ")"
_CLASS = "".join(chr(c) for c in sorted(WHITELIST) if chr(c) not in "\\]^-'") + "''\\\\\\]\\^\\-"
WHITELISTED = f"not regexp_matches(text, '[^{_CLASS}]')"


def _register_check(name, rule, condition):
    @query(name, sql(f"select split, lang, count(*) as n from labels where {condition} group by split, lang"))
    def check(spark: SparkSession, sf_dir: str) -> DataFrame:
        return labels(spark, sf_dir).where(rule(F.col("text"))).groupBy("split", "lang").agg(F.count("*").alias("n"))


for _name, (_rule, _condition) in CHECKS.items():
    _register_check(_name, _rule, _condition)


@query("c03_is_valid_text", sql(f"select line_no, text from labels where not {INVALID}"))
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).where(t.is_valid_text(F.col("text"))).select("line_no", "text")


@query(
    "c04_length_bounds",
    sql("""
select split, count(*) filter (length(text) < 3) as short, count(*) filter (length(text) > 100) as long,
  count(*) filter (length(text) between 3 and 100) as kept
from labels group by split"""),
)
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return labels(spark, sf_dir).groupBy("split").agg(
        F.count_if(n < 3).alias("short"), F.count_if(n > 100).alias("long"), F.count_if(n.between(3, 100)).alias("kept")
    )


@query("c05_charset_whitelist", sql(f"select line_no, text from labels where {WHITELISTED}"))
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).where(t.only_whitelisted(F.col("text"))).select("line_no", "text")


@query(
    "c06_height_bound",
    sql("""
select split, count(*) filter (height > 180) as tall, count(*) filter (height is null) as unknown,
  count(*) filter (coalesce(height <= 180, true)) as kept
from labels group by split"""),
)
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    tall = t.too_tall(F.col("height"), 180)
    return labels(spark, sf_dir).groupBy("split").agg(
        F.count_if(tall).alias("tall"),
        F.count_if(F.col("height").isNull()).alias("unknown"),
        F.count_if(~tall).alias("kept"),
    )


REASON = f"""case when not has_image then 'missing_image' when {INVALID} then 'invalid_yoruba'
  when length(text) < 3 then 'label_too_short' when length(text) > 100 then 'label_too_long'
  when not ({WHITELISTED}) then 'non_whitelisted_codepoint' when coalesce(height > 180, false) then 'image_too_tall' end"""
JUDGED = LABELS + f""",
judged as (select *, {REASON} as reason from labels)"""


@query("c07_reject_reason", sql("select line_no, file_name, coalesce(reason, '') as reason from judged", JUDGED))
def c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_reason(labels(spark, sf_dir)).select("line_no", "file_name", F.coalesce("reason", F.lit("")).alias("reason"))


# --- projections ----------------------------------------------------------------------------------------------


@query(
    "c09_path_projection",
    sql("""
select line_no, file_name, 'p' || (doc_id // 3) || '_line' || pos as sample_id,
  replace(replace(rel_path, '/', chr(92)), chr(92), '/') as source_relative,
  case when split = 'test' then '/elsewhere/' || rel_path else 'data/' || rel_path end as source_image
from labels"""),
)
def c09(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.when(F.col("split") == "test", "/elsewhere/").otherwise("/repo/data/")
    windows = F.translate("rel_path", "/", "\\")
    return labels(spark, sf_dir).select(
        "line_no",
        t.file_name(F.col("rel_path")).alias("file_name"),
        t.sample_id(F.col("rel_path")).alias("sample_id"),
        t.forward_slashes(windows).alias("source_relative"),
        t.portable_path(F.concat(root, "rel_path"), "/repo").alias("source_image"),
    )


# Answers come bare, fenced, fenced with a language name, fenced on one line, or framed by no-break spaces.
_ANSWER = """case turn % 5 when 0 then text
  when 1 then concat('```', chr(10), text, chr(10), '```')
  when 2 then concat('```text', chr(10), text, chr(10), '```')
  when 3 then concat('```', text, '```')
  else concat({nbsp}, ' ', text, {nbsp}) end"""


@query(
    "c10_clean_transcript",
    rf"""
with answers as (select conv_id, turn, {_ANSWER.format(nbsp='chr(160)')} as raw from conversations),
stripped as (select conv_id, turn, regexp_replace(raw, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') as s from answers),
bare as (select conv_id, turn, case when contains(s, '```')
  then regexp_replace(regexp_replace(s, '^```[a-zA-Z0-9]*[\s\x{{a0}}]*', ''), '[\s\x{{a0}}]*```$', '') else s end as s
  from stripped)
select conv_id, turn, nfc_normalize(regexp_replace(split_part(s, chr(10), 1), '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'))
  as transcript
from bare""",
)
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _ANSWER.format(nbsp="'\u00a0'").replace("chr(10)", "'\n'")
    answers = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(raw).alias("raw"))
    return answers.select("conv_id", "turn", t.clean_transcript(F.col("raw")).alias("transcript"))


_BLOCK_SQL = (
    "case "
    + " ".join(f"when cp between {first} and {last} then '{label}'" for first, last, label in BLOCKS)
    + f" else '{OTHER_BLOCK}' end"
)


@query(
    "c14_unicode_block",
    f"""
select part_no, cp, {_BLOCK_SQL} as block
from (select p_partkey as part_no, (p_partkey * 37) % 66000 as cp from part)""",
)
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_no"), F.expr("(p_partkey * 37) % 66000").alias("cp"))
    return part.select("part_no", "cp", t.unicode_block(F.col("cp")).alias("block"))


@query(
    "c15_column_relabel",
    sql("""
select case when ch = ' ' then '(space)' else ch end as "Character", count(*) as "Count"
from (select unnest(string_split(text, '')) as ch from labels) where ch <> '' group by ch"""),
)
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = char_counts(labels(spark, sf_dir)).withColumn("ch", t.space_label(F.col("ch")))
    return counts.withColumnsRenamed({"ch": "Character", "n": "Count"})


# --- scalar functions -----------------------------------------------------------------------------------------


@query(
    "i05_char_and_word_len",
    sql("""
select line_no, cast(length(text) as int) as chars, cast(len(list_filter(string_split(text, ' '), lambda x: x <> '')) as int) as words
from labels"""),
)
def i05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("line_no", F.length("text").alias("chars"), t.word_len(F.col("text")).alias("words"))


@query(
    "i06_codepoint",
    sql("""
select ch, unicode(ch) as cp, printf('U+%04X', unicode(ch)) as label
from (select distinct unnest(string_split(text, '')) as ch from labels) where ch <> ''"""),
)
def i06(spark: SparkSession, sf_dir: str) -> DataFrame:
    cp = t.codepoint(F.col("ch"))
    return char_counts(labels(spark, sf_dir)).select("ch", cp.alias("cp"), t.codepoint_label(cp).alias("label"))


@query(
    "i07_codepoint_label",
    sql("""
select printf('U+%04X', unicode(ch)) as label, count(*) as n
from (select unnest(string_split(text, '')) as ch from labels) where ch <> '' group by ch"""),
)
def i07(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = char_counts(labels(spark, sf_dir))
    return counts.select(t.codepoint_label(t.codepoint(F.col("ch"))).alias("label"), "n")


@query("i09_sha256", "select doc_id, sha256(text) as digest from documents")
def i09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(
    "i10_round_n",
    f"""
select l_orderkey, l_linenumber, {rounded('l_extendedprice / l_quantity / 8', 2)} as two,
  {rounded('l_discount / 7', 4)} as four
from lineitem""",
)
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity") / 8
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", t.round_n(price, 2).alias("two"), t.round_n(F.col("l_discount") / 7, 4).alias("four")
    )


@query(
    "i11_empty_guard",
    f"""
select o_orderkey, {rounded('100.0::double * min(o_shippriority) / greatest(count(l_orderkey), 1)', 2)} as pct
from (select o_orderkey, 1 as o_shippriority from orders) left join lineitem on o_orderkey = l_orderkey
group by o_orderkey""",
)
def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Items are counted before the join, so an order is joined to one row at most.
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    n = F.coalesce("n", F.lit(0))
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", t.round_n(F.lit(100.0) / t.at_least_one(n), 2).alias("pct")
    )


@query(
    "i12_json_access",
    """
select event_id, coalesce(json_extract_string(props, '$.k'), '') as k,
  coalesce(json_extract_string(props, '$.absent.head'), '0') as head
from events""",
)
def i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"),
        F.coalesce(F.get_json_object("props", "$.absent.head"), F.lit("0")).alias("head"),
    )


@query("i13_preview_text", sql("select line_no, substr(text, 1, 80) || '...' as preview from labels where length(text) > 100"))
def i13(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = labels(spark, sf_dir).where(F.length("text") > 100)
    return long.select("line_no", t.preview(F.col("text")).alias("preview"))


# The stamp of a query lies between its start and its end; tests hold it against the clock.
@query("i14_utc_timestamp", "select count(*) as n, count(*) as stamped, 1::bigint as stamps from documents")
def i14(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id").withColumn("timestamp", t.utc_timestamp())
    well_formed = F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}(Z|[+-]\d\d:\d\d)$")
    return docs.agg(F.count("*").alias("n"), F.count_if(well_formed).alias("stamped"), F.countDistinct("timestamp").alias("stamps"))
