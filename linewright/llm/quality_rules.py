"""Quality rules on documents and on the hosts they come from.

Each document is measured and held against a few rules. Per host (`source`) and rule, failures are counted, and the
host's rate is shrunk towards all hosts' by a beta prior whose two parameters are estimated from the hosts' own rates:
with few documents the rate stays near the corpus, with many it is the host's own. A host whose shrunk rate of any rule
is above `MAX_RATE` is rejected with everything on it; elsewhere a document goes only if it fails the base rules itself.

Measuring reads each text once; the measures are written to the shared folder, because both the counts per host and the
result need them. Counts are combined before the shuffle, so a host with a third of all documents is one row per task.
The rejected hosts are a written table as well: the planner knows its size, broadcasts it if small and else joins by
shuffle, with adaptive splitting of hot hosts.

Repeated three-word windows are found inside the row: 64-bit hashes of the windows are sorted with their positions, and
equal neighbours mark the words they cover. Texts without any equal pair, most of them, skip the sort.

Defined results: a null or empty text has no words and fails; a document without a source belongs to no host and is judged
by itself; repeated rows are judged (and counted) each; an empty table gives an empty result. Columns with the names of
the measures are replaced in the measures and kept as they are in `kept_documents`. Equal rates tie without effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.registry import query
from linewright.llm.shared import SPACES, staged

#: A host is rejected if its shrunk rate of failures of one rule is above this.
MAX_RATE = 0.5
#: Strength of the prior in documents: bounds for the estimate.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule name -> condition of failing, over the measures.
RULES = {
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Number of words that lie in a window of three words found twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(run: Column) -> Column:
            equal = F.filter(run, lambda x, k: (F.get(run, k - 1)["h"] == x["h"]) | (F.get(run, k + 1)["h"] == x["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(equal, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bound(placed, starts))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(bound(windows, covered))


def measures(text: Column) -> Column:
    """Struct of the measures of one text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def fields(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        )

    return bound(words, fields)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the columns of MEASURES, replacing columns of these names."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    return docs.select(*kept, measures(F.col(text)).alias("m*")).select(
        *kept,
        *(F.col("`m*`")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")),
        F.col("`m*`")["lines"]["n"].alias("n_lines"),
        F.col("`m*`")["lines"]["dup"].alias("n_dup_lines"),
    )


def host_rates(counted: DataFrame, host: str = "source") -> DataFrame:
    """host, rule, n_docs, n_failed, rate (shrunk). counted: host and MEASURES, one row per document."""
    failed = [F.sum(F.when(F.expr(f), 1).otherwise(0)).alias(name) for name, f in RULES.items()]
    hosts = counted.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *failed)
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n_failed")) for name in RULES))
    rates = hosts.select("host", "n_docs", F.inline(pairs))
    prior = (
        rates.groupBy("rule")
        .agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.var_pop(F.col("n_failed") / F.col("n_docs")).alias("spread"))
        .withColumn("strength", F.when(F.col("spread") > 0, F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1).otherwise(F.lit(MOST_STRENGTH)))
        .withColumn("strength", F.least(F.greatest("strength", F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)))
    )
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return rates.join(prior, "rule").select("host", "rule", "n_docs", "n_failed", shrunk.alias("rate"))


def rejected_hosts(counted: DataFrame, host: str = "source") -> DataFrame:
    """Hosts to reject, each once, as a written table."""
    return staged(host_rates(counted, host).where(F.col("rate") > MAX_RATE).select("host").distinct(), "rejected-hosts")


def judge_documents(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, source. Returns doc_id, source, MEASURES, base_failed, host_failed, kept."""
    counted = staged(measured(docs.select("doc_id", "source", "text")).drop("text"), "quality-measures")
    hosts = rejected_hosts(counted).withColumnRenamed("host", "source").withColumn("host_failed", F.lit(True))
    return (
        counted.withColumn("base_failed", F.expr(RULES["base"]))
        .join(hosts, "source", "left")
        .withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
        .select("doc_id", "source", *MEASURES, "base_failed", "host_failed", "kept")
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns. The texts are written once with their measures and not shuffled."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    both = docs.select(F.struct(*own).alias("doc"), F.col("text"), F.col("source"))
    counted = staged(measured(both).drop("text"), "quality-documents")
    kept = counted.where(~F.expr(RULES["base"])).join(rejected_hosts(counted).withColumnRenamed("host", "source"), "source", "left_anti")
    return kept.select("doc.*")


SQL = r"""
WITH cut AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, row_number() OVER () AS rn
  FROM documents),
windows AS (
  SELECT rn, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS k
  FROM cut WHERE len(w) >= 3),
twice AS (
  SELECT rn, k FROM windows GROUP BY rn, k HAVING count(*) > 1),
keyed AS (
  SELECT rn, i FROM windows JOIN twice USING (rn, k)),
repeated AS (
  SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p FROM keyed) GROUP BY rn),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS wc,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM cut LEFT JOIN repeated r USING (rn)),
d AS (
  SELECT *, coalesce(wc, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
hosts AS (
  SELECT source, count(*) AS n, unnest(['base', 'symbols', 'lines', 'word_length']) AS rule, unnest([
    count(*) FILTER (base_failed), count(*) FILTER (10 * n_symbols > 3 * n_words), count(*) FILTER (10 * n_dup_lines > 3 * n_lines),
    count(*) FILTER (word_chars < 2 * n_words OR word_chars > 20 * n_words)]) AS f
  FROM d WHERE source IS NOT NULL GROUP BY source),
prior AS (
  SELECT rule, sum(f) / sum(n) AS mean, var_pop(f / n) AS spread FROM hosts GROUP BY rule),
strong AS (
  SELECT rule, mean, least(greatest(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE 1000.0 END, 1.0), 1000.0) AS k FROM prior),
bad AS (
  SELECT DISTINCT source FROM hosts JOIN strong USING (rule) WHERE (f + mean * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, bad.source IS NOT NULL AS host_failed,
  NOT base_failed AND bad.source IS NULL AS kept
FROM d LEFT JOIN bad ON d.source = bad.source
"""


@query("op2_quality_rules", SQL)
def op2_quality_rules(spark, sf_dir):
    """Measures, base rules and the verdict with host rates, per document."""
    return judge_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
