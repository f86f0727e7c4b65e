"""Credentials in documents: candidates by pattern, false positives removed by a random forest.

Candidates are private keys from BEGIN to END (without an END: with the lines of key characters behind BEGIN), the known
prefixes of cloud keys, values of 8 or more characters assigned to a secret's name, whatever their characters (in quotes up
to the closing quote of the line, else up to white space), and other runs of key characters with a digit: 16 or more, or 8
behind `=` or `:`. Runs without a digit that no secret's name stands before are not candidates. Each is described by its
length, character classes and transitions, the share covered by frequent words, signs of a path or an address around it,
and the words beside it. A random forest gives the share of its trees that vote for a secret.

The forest is always trained, on the labelled findings of `secret_examples` and on those that are given besides: texts with
a value and its label, described in the same way. It never learns from the documents that it judges.

Everything stays in the row: the candidates of a text are an array, their features and the trees are column expressions,
so texts are neither shuffled nor joined, and no Python runs on the executors. Every text is searched once: the described
candidates are written to the shared folder and judged from there. What is gathered is bounded: `DICTIONARY` frequent words
(their counts cover the whole corpus) and at most `SAMPLE` labelled findings of each class.

Defined results: a null or empty text has no candidates; candidates repeated in a text are findings each; ties of votes
(score 0.5) are secrets; repeated rows and null ids are scanned like others; empty tables give empty results; columns named
like results are kept by `redacted` and left out by `findings`. Texts are scanned whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import trees
from linewright.llm.registry import query
from linewright.llm.secret_examples import WORDS, examples
from linewright.llm.shared import SPACES, small_table, staged

SAMPLE = 10_000
DICTIONARY = 500
MASK = "[SECRET]"

RUN = "A-Za-z0-9+/_-"
SECRET_NAME = r"(?i)(?:passw|pwd|secret|token|api.?key|access.?key|auth|credential|bearer)"
PRIVATE_KEY = (
    r"-----BEGIN [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:[^-]++|-(?!----)){0,200}-----END [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----|(?:\s{0,4}[A-Za-z0-9+/=]{16,}+){0,400})"
)
#: Behind a secret's name and an assignment: up to the closing quote, or up to white space without closing punctuation.
NAMED = (
    r"(?<=[=:>\s\"'`])(?<=[=:>][ \t]{0,4}[\"'`]?)"
    rf"(?<={SECRET_NAME}[A-Za-z0-9_.-]{{0,200}}[\"'`)\]]{{0,2}}[ \t]{{0,4}}[=:]{{1,3}}>?[ \t]{{0,4}}[\"'`]?)"
    r"(?:(?<=\")(?=(?:\\.|[^\"\\\n]){8})[^\"\\\n]*+(?:\\.[^\"\\\n]*+){0,400}(?=\")"
    r"|(?<=')(?=(?:\\.|[^'\\\n]){8})[^'\\\n]*+(?:\\.[^'\\\n]*+){0,400}(?=')|(?<=`)[^`\n]{8,}+(?=`)"
    # a quote that is not closed on its line stands before a value without quotes
    r"|(?:(?<![\"'`])|(?<=\")(?![^\"\n]*+\")|(?<=')(?![^'\n]*+')|(?<=`)(?![^`\n]*+`))(?![=:>\"'`])\S{8,}?(?=[.,;:)\]}>\"'`]{0,3}(?:\s|$)))"
)
CANDIDATE = (
    rf"(?:{PRIVATE_KEY}|(?<![{RUN}])(?:(?:AKIA|ASIA)[A-Z0-9]{{16}}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{{30,}})|{NAMED}"
    rf"|(?<![{RUN}])(?=[A-Za-z+/_-]*+[0-9])(?:[{RUN}]{{16,}}|(?<=[=:][\"' ]{{0,3}})[{RUN}]{{8,}}))={{0,2}}"
)
OTHER_NAME = r"(?i)(?:card|visa|phone|tel|order|invoice|isbn|iban|commit|sha|md5|uuid|hash|version|revision|number)"

FEATURES = ("length", "digits", "upper", "lower", "transitions", "vowel_steps", "distinct", "covered", "slashes", "in_path", "assigned", "quoted", "secret_name", "other_name")


def frequent_words(docs: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The most frequent words of 3 to 12 letters of all documents (ties: in order)."""
    words = docs.select(F.explode(F.split(F.lower("text"), SPACES)).alias("word")).where(F.col("word").rlike("^[a-z]{3,12}$"))
    return sorted(r.word for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).collect())


FOUND = "array<struct<value:string,start:int,before:string,after:string>>"


def candidates(text: Column) -> Column:
    """array<struct<value, start, before, after>> of a text; start counts code points from 0.

    Values and the gaps between them are cut out once, and the places are counted in one go over them.
    """
    cut = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("values"), F.split(text, CANDIDATE, -1).alias("gaps"))

    def placed(c: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            gap, behind = F.get(c["gaps"], i), F.get(c["gaps"], i + 1)
            return F.struct(value.alias("value"), F.length(gap).alias("gap"), F.substring(gap, -60, 60).alias("before"), F.substring(behind, 1, 60).alias("after"))

        def add(sum_: Column, x: Column) -> Column:
            start = (sum_["at"] + x["gap"]).alias("start")
            own = F.struct(x["value"].alias("value"), start, x["before"].alias("before"), x["after"].alias("after"))
            return F.struct((sum_["at"] + x["gap"] + F.length(x["value"])).alias("at"), F.concat(sum_["out"], F.array(own)).alias("out"))

        nothing = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {FOUND})").alias("out"))
        return F.aggregate(F.transform(c["values"], one), nothing, add, lambda sum_: sum_["out"])

    return F.when(text.rlike(CANDIDATE), F.transform(F.array(cut), placed)[0]).otherwise(F.expr(f"CAST(array() AS {FOUND})"))


def features(c: Column, dictionary: list[str]) -> Column:
    """Struct of FEATURES (doubles) of one candidate."""
    value = c["value"]
    size = F.length(value)

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / size

    covered = F.lit(0.0)
    if dictionary:
        rest = F.regexp_replace(F.lower(value), "|".join(sorted(dictionary, key=lambda w: (-len(w), w))), "")
        covered = (size - F.length(rest)) / size
    near = F.concat(F.regexp_extract(c["before"], r"(\S*\s*\S*\s*\S*)$", 1), F.lit(" "), F.regexp_extract(c["after"], r"^\W*(\w*)", 1))
    found = {
        "length": size,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "transitions": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "vowel_steps": share("(?i)[aeiouy](?=[b-df-hj-np-tv-xz])"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "covered": covered,
        "slashes": share("[/_-]"),
        "in_path": c["before"].rlike(r"(?:://\S*|[/\\.@])$") | c["after"].rlike(r"^[/\\.@]\w"),
        "assigned": c["before"].rlike(r"(?:[=:][\"' ]{0,3}|[=:]>?[ \t]{0,4}[\"'`]?)$"),
        "quoted": c["before"].rlike("[\"'`]$"),
        "secret_name": near.rlike(SECRET_NAME),
        "other_name": near.rlike(OTHER_NAME),
    }
    return F.struct(*(F.coalesce(found[name].cast("double"), F.lit(0.0)).alias(name) for name in FEATURES))


def described(text: Column, dictionary: list[str]) -> Column:
    """The candidates of a text with their features."""

    def one(c: Column) -> Column:
        return F.struct(*(c[n].alias(n) for n in ("value", "start", "before", "after")), features(c, dictionary).alias("f"))

    return F.transform(candidates(text), one)


def labelled(spark: SparkSession, dictionary: list[str], more: DataFrame | None = None) -> DataFrame:
    """value, f, label of the examples, and of `more` (text, value, label): candidates that are the labelled value."""
    made = examples()
    columns = {"text": [e.text for e in made], "value": [e.value for e in made], "label": [e.label for e in made]}
    texts = small_table(spark, columns, {"text": pa.string(), "value": pa.string(), "label": pa.int32()})
    if more is not None:
        texts = texts.unionByName(more.select("text", "value", F.col("label").cast("int")))
    own = texts.select(F.col("value").alias("wanted"), "label", F.inline(described(F.col("text"), dictionary)))
    return own.where("value = wanted AND label IN (0, 1)").select("value", "f", "label")


def trained(labels: DataFrame, seed: int = 7) -> list[trees.Node]:
    """A forest from labelled findings: value, f, label.

    Of each class, the SAMPLE findings with the lowest hash are used: the bound of what is gathered.
    """
    flat = labels.select("label", *(F.col("f")[n].alias(n) for n in FEATURES), F.xxhash64("value").alias("h"))
    own = [flat.where(F.col("label") == label).orderBy("h", *FEATURES).limit(SAMPLE) for label in (0, 1)]
    sample = staged(own[0].unionByName(own[1]).withColumn("label", F.col("label").cast("double")), "secret-labels")
    model = RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed, featuresCol="x").fit(sample.select("label", array_to_vector(F.array(*FEATURES)).alias("x")))
    return trees.forest(model)


def scanned(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """docs without their text, with a column `found`: array<struct<value, start, before, after, f, score, is_secret>>."""
    words = frequent_words(docs)
    dictionary = sorted({*words, *WORDS})
    found = staged(docs.withColumn("found", described(F.col("text"), dictionary)).drop("text"), "secret-candidates")
    grown = trained(labelled(docs.sparkSession, dictionary, labels))

    def judged(c: Column) -> Column:
        score = trees.share_of_votes(grown, [c["f"][n] for n in FEATURES])
        return c.withField("score", score).withField("is_secret", score >= 0.5)

    return found.withColumn("found", F.transform("found", judged))


def findings(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """docs: doc_id, text. One row per candidate: doc_id, no, start, value, score, is_secret."""
    return scanned(docs.select("doc_id", "text"), labels).select("doc_id", F.posexplode("found").alias("no", "c")).select("doc_id", "no", "c.start", "c.value", "c.score", "c.is_secret")


def masked(text: Column, found: Column) -> Column:
    """A text with MASK at the place of every secret, and then wherever else a secret's value stands, longer ones first."""
    cut = F.struct(F.split(text, CANDIDATE, -1).alias("gaps"), found.alias("found"))

    def at_places(c: Column) -> Column:
        pieces = F.transform(c["found"], lambda x, i: F.concat(F.get(c["gaps"], i), F.when(x["is_secret"], F.lit(MASK)).otherwise(x["value"])))
        return F.concat(F.array_join(pieces, ""), F.get(c["gaps"], F.size(c["found"])))

    values = F.transform(F.filter(found, lambda x: x["is_secret"]), lambda x: F.struct((-F.length(x["value"])).alias("size"), x["value"].alias("value")))
    return F.aggregate(F.array_sort(F.array_distinct(values)), F.transform(F.array(cut), at_places)[0], lambda rest, x: F.replace(rest, x["value"], F.lit(MASK)))


def redacted(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The documents with MASK in place of every secret, wherever its value stands; other columns as they are."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    both = scanned(docs.select(F.struct(*own).alias("doc"), "text"), labels)
    any_secret = F.exists("found", lambda c: c["is_secret"])
    clean = F.col("doc").withField("text", masked(F.col("doc")["text"], F.col("found")))
    return both.select(F.when(any_secret, clean).otherwise(F.col("doc")).alias("doc")).select("doc.*")


@query("op10_secret_scans")
def op10_secret_scans(spark, sf_dir):
    """Every candidate of every document with its place, digest and verdict."""
    found = findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "no", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
