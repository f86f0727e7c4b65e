"""Queries on consolidation and profiling: drops, duplicates, lengths, characters, samples, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.text import JUDGED, WHITELISTED
from catalog.views import LABELS, ORDER, documents, labels, rounded, sql, table
from linewright.constants import BLOCKS, MARK_NAMES, OTHER_BLOCK, PRECOMPOSED
from linewright.functions.text import word_len
from linewright.operators import charset, hygiene, lengths, sampling
from linewright.operators.audit import leaks
from linewright.plans.consolidate import consolidate, report

# --- consolidation --------------------------------------------------------------------------------------------

ACCEPTED = JUDGED + """,
accepted as (
  select * from judged where reason is null
  qualify row_number() over (partition by file_name order by export_id desc, dir_name, split_ord, line_no) = 1
)"""


def corpus(spark: SparkSession, sf_dir: str):
    return consolidate(labels(spark, sf_dir), ORDER)


@query(
    "d01_drop_counts",
    sql(
        """
select r.reason, count(j.line_no) as n
from (values ('missing_image'), ('invalid_yoruba'), ('label_too_short'), ('label_too_long'),
  ('non_whitelisted_codepoint'), ('image_too_tall')) as r(reason) left join judged j on j.reason = r.reason
group by r.reason""",
        JUDGED,
    ),
)
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.drop_counts(hygiene.with_reason(labels(spark, sf_dir)))


@query(
    "f01_dedup_last_export",
    sql("select file_name, export_id, dir_name, split, line_no, text from accepted", ACCEPTED),
)
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).accepted.select("file_name", "export_id", "dir_name", "split", "line_no", "text")


@query(
    "d02_split_counts",
    sql(
        """
select s.split, count(a.line_no) as n from (values ('train'), ('val'), ('test')) as s(split)
left join accepted a on a.split = s.split group by s.split""",
        ACCEPTED,
    ),
)
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.split_counts(corpus(spark, sf_dir).accepted)


@query(
    "d02_consolidation_report",
    sql(
        """
select (select string_agg(distinct export_id, ',' order by export_id) from labels) as export_ids,
  (select count(*) from accepted) as unique_images_total,
  (select count(distinct ch) from (select unnest(string_split(text, '')) as ch from accepted) where ch not in ('', ' '))
    as char_dict_size,
  (select count(*) from judged where reason = 'invalid_yoruba') as invalid_yoruba,
  (select count(*) from accepted where split = 'test') as test""",
        ACCEPTED,
    ),
)
def d02_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels(spark, sf_dir)
    one = report(consolidate(rows, ORDER), rows)
    return one.select(
        F.array_join(F.transform("export_ids", lambda x: x.cast("string")), ",").alias("export_ids"),
        "unique_images_total",
        "char_dict_size",
        F.col("hygiene.drop_counts")["invalid_yoruba"].alias("invalid_yoruba"),
        F.col("split_counts")["test"].alias("test"),
    )


@query(
    "d16_char_dictionary",
    sql("select distinct ch from (select unnest(string_split(text, '')) as ch from accepted) where ch not in ('', ' ')", ACCEPTED),
)
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.char_dictionary(corpus(spark, sf_dir).accepted)


@query(
    "j07_leakage_check",
    sql("""
select file_name, min(split) as first_split, max(split) as last_split, count(*) as n
from labels group by file_name having count(distinct split) > 1"""),
)
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(labels(spark, sf_dir), "file_name")


@query(
    "j07_text_leakage",
    sql(
        """
select text, min(split) as first_split, max(split) as last_split, count(*) as n
from accepted group by text having count(distinct split) > 1""",
        ACCEPTED,
    ),
)
def j07_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(corpus(spark, sf_dir).accepted, "text")


@query("h01_union_exports", sql("select export_id, dir_name, split, count(*) as n from labels group by all"))
def h01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).groupBy("export_id", "dir_name", "split").agg(F.count("*").alias("n"))


@query("h02_union_splits", sql("select count(*) as n, sum(length(text))::bigint as chars from labels"))
def h02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# --- would-drop accounting ------------------------------------------------------------------------------------

_RULES = f"""
rules as (
  select split, 'label_too_short' as rule, length(text) < 3 as hit, * exclude (split) from labels union all
  select split, 'label_too_long', length(text) > 100, * exclude (split) from labels union all
  select split, 'image_too_tall', coalesce(height > 180, false), * exclude (split) from labels union all
  select split, 'non_yoruba_codepoint', not ({WHITELISTED}), * exclude (split) from labels
)"""
RULES = LABELS + "," + _RULES


@query(
    "d10_would_drop",
    sql("select split, rule, count(*) as n, count(*) filter (hit) as would_drop from rules group by split, rule", RULES),
)
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.would_drop(labels(spark, sf_dir))


@query("d11_audit_totals", sql("select rule, count(*) filter (hit) as would_drop from rules group by rule", RULES))
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.audit_totals(labels(spark, sf_dir))


@query(
    "f08_first_n_examples",
    sql(
        f"""
select rule, split, cast(rank as int) as rank, case rule when 'label_too_long' then substr(text, 1, 80) || '...'
    when 'image_too_tall' then cast(height as varchar) else text end as shown,
  case when rule = 'non_yoruba_codepoint' then array_to_string(list_sort(list_distinct(list_filter(string_split(text, ''),
    lambda x: not ({WHITELISTED.replace('text', 'x')})))), '') end as offenders
from (
  select *, row_number() over (partition by rule, split order by dir_name, split_ord, line_no) as rank from rules where hit
)
where rank <= case rule when 'image_too_tall' then 10 when 'non_yoruba_codepoint' then 20 else 5 end""",
        RULES,
    ),
)
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.example_rows(labels(spark, sf_dir), ORDER)


# --- lengths --------------------------------------------------------------------------------------------------

_WORDS = "len(list_filter(string_split(text, ' '), lambda x: x <> ''))"


@query(
    "d03_length_stats",
    sql(f"""
select split, count(*) as count, min(n)::int as min, max(n)::int as max, {rounded('avg(n)', 2)} as mean,
  list_sort(list(n))[1 + count(*) // 2]::int as median, list_sort(list(n))[1 + cast(floor(count(*) * 0.95::double) as bigint)]::int as p95
from (select split, length(text) as n from labels) group by split"""),
)
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_stats(labels(spark, sf_dir), ["split"], F.length("text"))


def _profile_sql(value: str) -> str:
    def at(q: str) -> str:
        return f"cast(list_sort(list(n))[1 + cast(floor({q}::double * (count(*) - 1)) as bigint)] as double)"

    return sql(f"""
select split, cast(min(n) as double) as min, median(n)::double as p50, {at('0.90')} as p90, {at('0.95')} as p95,
  {at('0.99')} as p99, cast(max(n) as double) as max
from (select split, {value} as n from labels) where n is not null group by split""")


PROFILES = {
    "d04_chars_profile": ("length(text)", lambda: F.length("text")),
    "d04_words_profile": (_WORDS, lambda: word_len(F.col("text"))),
    "d04_width_profile": ("width", lambda: F.col("width")),
    "d04_height_profile": ("height", lambda: F.col("height")),
}


def _register_profile(name, expression, value):
    @query(name, _profile_sql(expression))
    def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lengths.quantile_profile(labels(spark, sf_dir), ["split"], value())


for _name, (_expression, _value) in PROFILES.items():
    _register_profile(_name, _expression, _value)


@query(
    "f06_rank_value",
    sql("""
select lang, rank, list_sort(list(length(text)))[rank + 1]::int as value
from labels, (values (0), (9), (99)) as r(rank) group by lang, rank"""),
)
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = (0, 9, 99)
    ranked = lengths.with_ranks(lengths.value_counts(labels(spark, sf_dir), ["lang"], F.length("text")), ["lang"])
    wide = ranked.groupBy("lang").agg(*[lengths.at_rank(F.lit(r)).alias(str(r)) for r in ranks])
    return wide.unpivot(["lang"], [str(r) for r in ranks], "rank", "value").withColumn("rank", F.col("rank").cast("int"))


@query(
    "d23_length_histogram",
    sql("""
select split, case when hi = lo then 1
    else least(cast(floor((n - lo) * 30.0::double / (hi - lo)) as bigint) + 1, 30) end as bin, count(*) as n
from (select split, length(text) as n, min(length(text)) over (partition by split) as lo,
  max(length(text)) over (partition by split) as hi from labels)
group by 1, 2"""),
)
def d23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_histogram(labels(spark, sf_dir), ["split"], F.length("text"))


# --- characters -----------------------------------------------------------------------------------------------

CHARS = LABELS + """,
chars as (
  select * from (
    select split, dir_name, split_ord, line_no, i as pos, parts[i] as ch
    from (select *, string_split(text, '') as parts from labels), unnest(range(1, len(parts) + 1)) as t(i))
  where ch <> ''
)"""
_BLOCK = (
    "case "
    + " ".join(f"when unicode(ch) between {first} and {last} then '{label}'" for first, last, label in BLOCKS)
    + f" else '{OTHER_BLOCK}' end"
)


@query("d05_char_frequency", sql("select split, ch, count(*) as n from chars group by split, ch", CHARS))
def d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.char_counts(labels(spark, sf_dir), ["split"])


_LETTERS = "éóèñçêüäöíÉÈÑÓÇÄÊÜÖÍ"
_CODES = [0x301, 0x301, 0x300, 0x303, 0x327, 0x302, 0x308, 0x308, 0x308, 0x301, 0x301, 0x300, 0x303, 0x301, 0x327, 0x308,
          0x302, 0x308, 0x308, 0x301]
_NAMED = ", ".join(
    f"('{letter}', '{MARK_NAMES.get(chr(code), f'U+{code:04X}')}')" for letter, code in zip(_LETTERS, _CODES)
)


@query(
    "d06_combining_counts",
    sql(
        f"""
select coalesce(mark, 'total') as mark, count(*) as n
from chars join (values {_NAMED}) as m(letter, mark) on m.letter = ch group by rollup (mark)""",
        CHARS,
    ),
)
def d06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.mark_counts(charset.char_counts(labels(spark, sf_dir)))


@query(
    "d07_precomposed_counts",
    sql(
        f"""
select coalesce(ch, 'total') as letter, count(*) as n from chars where contains('{PRECOMPOSED}', ch) group by rollup (ch)""",
        CHARS,
    ),
)
def d07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.precomposed_counts(charset.char_counts(labels(spark, sf_dir)))


@query("d08_block_histogram", sql(f"select split, {_BLOCK} as block, count(*) as n from chars group by all", CHARS))
def d08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.block_counts(charset.char_counts(labels(spark, sf_dir), ["split"]), ["split"])


_OFFENDING = f"not ({WHITELISTED.replace('text', 'ch')})"
_NAMES = {
    "ñ": "LATIN SMALL LETTER N WITH TILDE", "Ñ": "LATIN CAPITAL LETTER N WITH TILDE",
    "ç": "LATIN SMALL LETTER C WITH CEDILLA", "Ç": "LATIN CAPITAL LETTER C WITH CEDILLA",
    "ê": "LATIN SMALL LETTER E WITH CIRCUMFLEX", "Ê": "LATIN CAPITAL LETTER E WITH CIRCUMFLEX",
    "ü": "LATIN SMALL LETTER U WITH DIAERESIS", "Ü": "LATIN CAPITAL LETTER U WITH DIAERESIS",
    "ä": "LATIN SMALL LETTER A WITH DIAERESIS", "Ä": "LATIN CAPITAL LETTER A WITH DIAERESIS",
    "ö": "LATIN SMALL LETTER O WITH DIAERESIS", "Ö": "LATIN CAPITAL LETTER O WITH DIAERESIS",
    "ß": "LATIN SMALL LETTER SHARP S",
}
_NAME = "case ch " + " ".join(f"when '{c}' then '{n}'" for c, n in _NAMES.items()) + " else '<unnamed>' end"


@query(
    "d09_offending_codepoints",
    sql(
        f"""
select split, printf('U+%04X', unicode(ch)) as codepoint, ch as char, count(*) as n, {_NAME} as name, {_BLOCK} as block
from chars where {_OFFENDING} group by split, ch""",
        CHARS,
    ),
)
def d09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.offending_codepoints(charset.char_counts(labels(spark, sf_dir), ["split"]))


@query("e08_codepoint_name_join", sql(f"select ch as char, {_NAME} as name from (select distinct ch from chars where {_OFFENDING})", CHARS))
def e08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.offending_codepoints(charset.char_counts(labels(spark, sf_dir))).select("char", "name")


@query(
    "f07_first_seen_tie_order",
    sql(
        """
select ch, n, cast(row_number() over (order by n desc, seen) as int) as place from (
  select ch, count(*) as n, min(struct_pack(a := dir_name, b := split_ord, c := line_no, d := pos)) as seen from chars group by ch)""",
        CHARS,
    ),
)
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = charset.char_counts(labels(spark, sf_dir), order=ORDER)
    # One row per distinct character is ranked here, never one per label row.
    place = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("first_seen")))
    return counts.select("ch", "n", place.alias("place"))


def _top_sql(n: int, condition: str = "true") -> str:
    return sql(
        f"""
select ch, count(*) as n from chars where {condition} group by ch
order by n desc, min(struct_pack(a := dir_name, b := split_ord, c := line_no, d := pos)) limit {n}""",
        CHARS,
    )


@query("g02_top50_chars", _top_sql(50))
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.top_chars(charset.char_counts(labels(spark, sf_dir), order=ORDER), 50).select("ch", "n")


@query("g03_top25_offenders", _top_sql(25, _OFFENDING))
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = charset.char_counts(labels(spark, sf_dir), order=ORDER)
    offending = charset.offending_codepoints(counts)
    return charset.top_chars(offending, 25).select(F.col("char").alias("ch"), "n")


@query("g04_top30_chars", _top_sql(30))
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.top_chars(charset.char_counts(labels(spark, sf_dir), order=ORDER), 30).select("ch", "n")


@query("g05_codepoint_order", sql("select ch, cast(row_number() over (order by unicode(ch)) as int) as place from (select distinct ch from chars)", CHARS))
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = charset.char_counts(labels(spark, sf_dir))
    return chars.select("ch", F.row_number().over(Window.orderBy("ch")).alias("place"))


@query("g01_order_by_stem", sql("select split, file_name, text from accepted order by split, file_name", ACCEPTED))
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).accepted.select("split", "file_name", "text").orderBy("split", "file_name")


# --- dictionary and sets --------------------------------------------------------------------------------------

DICTIONARY = CHARS + """,
dictionary as (select distinct ch from (select unnest(string_split(text, '')) as ch from benchmark) where ch not in ('', ' '))"""


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.char_dictionary(table(spark, sf_dir, "benchmark"))


@query(
    "d17_vocab_coverage",
    sql(
        f"""
select (select count(*) from dictionary) as dict_size, count(*) as unique_chars_in_data, count(d.ch) as chars_in_dict,
  coalesce(string_agg(c.ch, '' order by c.ch) filter (d.ch is null), '') as chars_not_in_dict,
  {rounded('100 * count(d.ch) / greatest(count(*), 1)::double', 2)} as coverage_pct
from (select distinct ch from chars) c left join dictionary d on c.ch = d.ch""",
        DICTIONARY,
    ),
)
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.vocab_coverage(charset.char_counts(labels(spark, sf_dir)), dictionary(spark, sf_dir))


@query("h03_charset_difference", sql("select ch from chars except select ch from dictionary", DICTIONARY))
def h03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.chars_not_in_dict(charset.char_counts(labels(spark, sf_dir)), dictionary(spark, sf_dir))


@query("h04_charset_intersection", sql("select ch from chars intersect select ch from dictionary", DICTIONARY))
def h04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.chars_in_dict(charset.char_counts(labels(spark, sf_dir)), dictionary(spark, sf_dir))


# --- samples --------------------------------------------------------------------------------------------------


@query("g06_max_samples_cap", "select doc_id, lang from documents order by doc_id limit 100")
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_rows(documents(spark, sf_dir, "doc_id", "lang"), ["doc_id"], 100)


FRACTIONS = {"025pct": 0.25, "050pct": 0.5, "075pct": 0.75, "100pct": 1.0}


def _register_fraction(name, fraction):
    @query(
        f"g09_fraction_sample_{name}",
        sql(f"""
select line_no, text from labels
qualify row_number() over (order by md5('42' || line_no), line_no) <= greatest(1, floor(count(*) over () * {fraction}::double))"""),
    )
    def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sampling.fraction_sample(labels(spark, sf_dir).select("line_no", "text"), "line_no", fraction, 42)


for _name, _fraction in FRACTIONS.items():
    _register_fraction(_name, _fraction)


@query("g10_n_sample", sql("select line_no, text from labels order by md5('42' || line_no), line_no limit 20"))
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.n_sample(labels(spark, sf_dir).select("line_no", "text"), "line_no", 20, 42)
