"""Label rows, recogniser outputs and run records derived from the given tables, in Spark and in SQL.

A document is an annotation batch page: each of its sentences or lines is one label row. Three consecutive documents
annotate the same page, so file names meet across exports, and a source number is the export id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.sources.labels import split_rank

ORDER = ["dir_name", "split_ord", "line_no"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "lang", "source", "text")
    split = F.expr("case doc_id % 10 when 8 then 'val' when 9 then 'test' else 'train' end")
    export_id = F.expr("cast(substring(source, 4) as bigint)")
    rows = docs.select(
        "doc_id",
        "lang",
        export_id.alias("export_id"),
        F.concat(F.lit("batch_"), export_id.cast("string"), F.expr("if(doc_id % 2 = 1, '_b', '')")).alias("dir_name"),
        split.alias("split"),
        split_rank(split).alias("split_ord"),
        F.posexplode(F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n")).alias("pos", "text"),
    )
    name = F.concat(
        F.lit("p"), F.expr("doc_id div 3").cast("string"), F.lit("_line"), F.col("pos").cast("string"), F.lit(".png")
    )
    return rows.select(
        "*",
        (F.col("doc_id") * 1000000 + F.col("pos") + 1).alias("line_no"),
        name.alias("file_name"),
        F.concat(F.lit("images/"), "split", F.lit("/"), name).alias("rel_path"),
        F.expr("(doc_id * 31 + pos) % 23 <> 0").alias("has_image"),
        F.expr("if(doc_id % 17 = 0, null, cast(40 + (length(text) * 7 + pos) % 200 as int))").alias("height"),
        F.expr("if(doc_id % 17 = 0, null, cast(200 + length(text) * 9 as int))").alias("width"),
    )


LABELS = """
labels as (
  select *, doc_id * 1000000 + pos + 1 as line_no,
    'p' || (doc_id // 3) || '_line' || pos || '.png' as file_name,
    'images/' || split || '/p' || (doc_id // 3) || '_line' || pos || '.png' as rel_path,
    (doc_id * 31 + pos) % 23 <> 0 as has_image,
    case when doc_id % 17 = 0 then null else cast(40 + (length(text) * 7 + pos) % 200 as int) end as height,
    case when doc_id % 17 = 0 then null else cast(200 + length(text) * 9 as int) end as width
  from (
    select doc_id, lang, cast(substr(source, 4) as bigint) as export_id,
      'batch_' || cast(substr(source, 4) as bigint) || case when doc_id % 2 = 1 then '_b' else '' end as dir_name,
      case doc_id % 10 when 8 then 'val' when 9 then 'test' else 'train' end as split,
      case doc_id % 10 when 8 then 2 when 9 then 3 else 1 end as split_ord,
      i - 1 as pos, parts[i] as text
    from (select *, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) as parts from documents),
      unnest(range(1, len(parts) + 1)) as t(i)
  )
)"""

SYSTEMS = ("identity", "fold", "noisy", "empty", "spurious")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label row as reference text of five made-up recognisers."""
    gt = F.col("text")
    fold = gt
    for letter in "éèê":
        fold = F.replace(fold, F.lit(letter), F.lit("e"))
    noisy = F.replace(fold, F.lit("the "), F.lit("te "))
    spurious = F.replace(gt, F.lit(" "), F.lit(" é"))
    answers = dict(zip(SYSTEMS, (gt, fold, noisy, F.lit(""), spurious)))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("pred")) for m, p in answers.items()]))
    return (
        labels(spark, sf_dir)
        .select("split", "lang", "line_no", gt.alias("gt"), each.alias("_s"))
        .select("_s.model", "split", "lang", "line_no", "_s.pred", "gt")
    )


PAIRS = (
    LABELS
    + """,
pairs as (
  select s.model, split, lang, line_no, gt, case s.model
      when 'identity' then gt
      when 'fold' then translate(gt, 'éèê', 'eee')
      when 'noisy' then replace(translate(gt, 'éèê', 'eee'), 'the ', 'te ')
      when 'empty' then ''
      else replace(gt, ' ', ' é') end as pred
  from (select split, lang, line_no, text as gt from labels),
    (values ('identity'), ('fold'), ('noisy'), ('empty'), ('spurious')) as s(model)
)"""
)

_LETTERS = "éóèñçêüäöíÉÈÑÓÇÄÊÜÖÍ"
_MARKS = "AAGTCXUUUAAGTACUXUUA"

# The edit distance of the SQL side compares bytes, so each accented letter becomes one control character. Each word
# both sides have becomes one character; words of one side only match nothing, so one character stands for all of them.
# Pairs that share more words than there are one-byte characters get a plain distance table instead.
SCORED = (
    PAIRS
    + f""",
tokens as (
  select *,
    list_filter(string_split(pred, ' '), lambda x: x <> '') as pw,
    list_filter(string_split(gt, ' '), lambda x: x <> '') as gw,
    translate(regexp_replace(pred, '[^{_LETTERS}]', '', 'g'), '{_LETTERS}', '{_MARKS}') as pm,
    translate(regexp_replace(gt, '[^{_LETTERS}]', '', 'g'), '{_LETTERS}', '{_MARKS}') as gm
  from pairs
),
vocabulary as (select *, list_intersect(pw, gw) as cw from tokens),
wide as (select row_number() over (order by model, line_no) as id, model, line_no, pw, gw from vocabulary
  where len(cw) > 90 and pred <> gt),
steps(id, i, j, d) as (
  select id, 0, j, j from wide, unnest(range(0, len(gw) + 1)) as b(j)
  union all
  select id, i, j, j + min(x - j) over (partition by id order by j)
  from (
    select p.id, p.i + 1 as i, p.j,
      least(p.d + 1, coalesce(lag(p.d) over (partition by p.id order by p.j) + case when w.pw[p.i + 1] = w.gw[p.j]
        then 0 else 1 end, p.d + 1)) as x
    from steps p join wide w on p.id = w.id where p.i < len(w.pw)
  )
),
wide_edits as (
  select w.model, w.line_no, s.d as word_edits from wide w join steps s on s.id = w.id and s.i = len(w.pw) and s.j = len(w.gw)
),
edits as (
  select v.model, v.split, v.lang, v.line_no, v.pred, v.gt, length(v.gt) as gt_chars, len(v.pw) as pred_words,
    len(v.gw) as gt_words,
    case when v.pred = v.gt then 0
      else levenshtein(translate(v.pred, '{_LETTERS}ß', src), translate(v.gt, '{_LETTERS}ß', src)) end as char_edits,
    case when v.pred = v.gt then 0
      when len(v.pw) = 0 or len(v.gw) = 0 then greatest(len(v.pw), len(v.gw))
      when len(v.cw) <= 90 then levenshtein(
        array_to_string(list_transform(v.pw, lambda x: chr(coalesce(34 + nullif(list_position(v.cw, x), 0), 33)::int)), ''),
        array_to_string(list_transform(v.gw, lambda x: chr(coalesce(34 + nullif(list_position(v.cw, x), 0), 34)::int)), ''))
      else w.word_edits end as word_edits,
    levenshtein(v.pm, v.gm) as mark_edits, length(v.gm) as gt_marks, length(v.pm) as pred_marks
  from vocabulary v left join wide_edits w on v.model = w.model and v.line_no = w.line_no,
    (select array_to_string([chr(x::int) for x in range(1, 22)], '') as src)
),
scored as (
  select *,
    case when gt_chars = 0 then case when pred = '' then 0.0::double else 1.0::double end
      else char_edits / gt_chars::double end as cer,
    case when gt_words = 0 then case when pred_words = 0 then 0.0::double else 1.0::double end
      else word_edits / gt_words::double end as wer,
    case when gt_marks = 0 then case when pred_marks = 0 then 0.0::double else 1.0::double end
      else mark_edits / gt_marks::double end as der
  from edits
)"""
)


def sql(query: str, views: str = LABELS) -> str:
    """A query over the derived views."""
    return f"with recursive {views.lstrip()}\n{query}"


def rounded(expression: str, digits: int) -> str:
    """SQL that rounds on the exact binary value."""
    return f"cast(format('{{:.{digits}f}}', {expression}) as double)"
