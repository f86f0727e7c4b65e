"""Block and allow rules for URLs, found by the rarest literal token of each rule.

A rule list may be long, so no URL is tried against all of it. Every rule is filed under one token that any URL it fits
must contain whole: of the rule's tokens, the one that fewest URLs have. A URL's own tokens fetch the rules filed under
them, and only those run their regular expression. Rules and URLs meet in an ordinary equality join, so the planner
broadcasts a short rule list and shuffles a long one.

Two kinds of rules:

* host rules `example.net/en/`: the host and all its subdomains, if the path starts with the rule's path. They decide.
* patterns, used where no host rule fits: literal text with `*` (anything), `^` (a separator or the end), a leading `||`
  (start of the host or of one of its labels), a leading or trailing `|` (start or end of the URL). Case of A-Z is ignored.

Of the rules of one kind that fit, the longest wins, of equally long ones `allow`, then the first in code point order.
A pattern without any whole token cannot be filed; up to `MAX_UNFILED` of those are tried on every URL, more are refused.

Defined results: a null URL, or one without `://`, has an empty host and path; a null URL fits no rule. Repeated rows keep
their number, null and repeated page ids are passed through, an empty table gives an empty result, and columns besides
`page_id` and `url` are left out, whatever their names. Very long URLs are judged whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.registry import query
from linewright.llm.shared import ascii_lower, small_table

MAX_UNFILED = 64
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    action: str
    text: str
    is_host: bool = False

    def __post_init__(self) -> None:
        if self.action not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {self.action}")
        if self.is_host and (not self.text or self.text.startswith("/")):
            raise ValueError(f"a host rule starts with a host: {self.text!r}")

    def regex(self) -> str:
        """For host rules over host and path put together, for patterns over the whole URL with A-Z lower-cased."""
        if self.is_host:
            return r"^(?:[^/]*\.)?" + _quoted(self.text)
        text, start, end = _anchors(self.text)
        head = {"||": r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*\.)?", "|": "^", "": ""}[start]
        parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%\-]|$)"}
        return "(?s)" + head + "".join(parts.get(c) or _quoted(c) for c in _lower(text)) + ("$" if end else "")

    def tokens(self) -> list[str]:
        """Tokens that every URL which the rule fits has as whole tokens."""
        if self.is_host:
            text, open_start, open_end = _lower(self.text), False, "/" in self.text
        else:
            text, start, end = _anchors(_lower(self.text))
            open_start, open_end = start == "", not end
        found = set()
        for m in re.finditer(TOKEN, text):
            before = text[m.start() - 1] if m.start() else "*" if open_start else "^"
            after = text[m.end()] if m.end() < len(text) else "*" if open_end else "^"
            if "*" not in (before, after):
                found.add(m.group())
        return sorted(found)


def _lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def _anchors(text: str) -> tuple[str, str, bool]:
    start = "||" if text.startswith("||") else "|" if text.startswith("|") else ""
    text = text[len(start) :]
    return (text[:-1], start, True) if text.endswith("|") else (text, start, False)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", lambda m: "\\" + m.group() if ord(m.group()) < 128 else m.group(), text)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filed_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule with the one of its tokens that fewest URLs have (ties: the first in order).

    urls: tokens; rules: rule_no, tokens, and more columns, which are kept.
    """
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("n_urls"))
    rarest = (
        rules.select("rule_no", F.explode("tokens").alias("token"))
        .join(counts, "token", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("n_urls", F.lit(0)).alias("n_urls"), F.col("token"))).alias("rarest"))
    )
    return rules.join(rarest.select("rule_no", "rarest.token"), "rule_no")


def judge_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages: page_id, url. Returns page_id, url, host, path, rule (host rule or null), pattern (or null), verdict."""
    spark = pages.sparkSession
    filed = sorted({r for r in rules if r.tokens()}, key=lambda r: (r.is_host, r.text, r.action))
    unfiled = sorted({r for r in rules if not r.tokens()}, key=lambda r: (r.is_host, r.text, r.action))
    if len(unfiled) > MAX_UNFILED:
        raise ValueError(f"{len(unfiled)} rules have no whole token; at most {MAX_UNFILED} can be tried on every URL")
    pages = pages.select("page_id", "url")
    urls = (
        pages.select("url").where(F.col("url").isNotNull()).distinct()
        .withColumn("target", F.concat(host_of(F.col("url")), path_of(F.col("url"))))
        .withColumn("low", ascii_lower(F.col("url")))
        .withColumn("tokens", F.array_distinct(F.regexp_extract_all("low", F.lit(TOKEN), F.lit(0))))
    )
    columns = {
        "rule_no": list(range(len(filed))),
        "text": [r.text for r in filed],
        "action": [r.action for r in filed],
        "is_host": [r.is_host for r in filed],
        "regex": [r.regex() for r in filed],
        "tokens": [r.tokens() for r in filed],
    }
    types = {"rule_no": pa.int64(), "text": pa.string(), "action": pa.string(), "is_host": pa.bool_(), "regex": pa.string(), "tokens": pa.list_(pa.string())}
    index = filed_rules(urls, small_table(spark, columns, types)).drop("tokens")

    def rank(text: Column, action: Column, is_host: Column) -> Column:
        return F.struct(is_host.alias("is_host"), F.length(text).alias("length"), (action == "allow").alias("allows"), text.alias("text"), action.alias("action"))

    fetched = (
        urls.select("url", "target", "low", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where(F.expr("CASE WHEN is_host THEN target ELSE low END RLIKE regex"))
        .select("url", rank(F.col("text"), F.col("action"), F.col("is_host")).alias("fit"))
    )
    if unfiled:
        tried = F.array(*(F.when(F.col("target" if r.is_host else "low").rlike(r.regex()), rank(F.lit(r.text), F.lit(r.action), F.lit(r.is_host))) for r in unfiled))
        fetched = fetched.unionByName(urls.select("url", F.array_max(tried).alias("fit")).where("fit IS NOT NULL"))
    best = fetched.groupBy("url").agg(F.max("fit").alias("fit"))
    return pages.join(best, "url", "left").select(
        "page_id",
        "url",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.when(F.col("fit.is_host"), F.col("fit.text")).alias("rule"),
        F.when(~F.col("fit.is_host"), F.col("fit.text")).alias("pattern"),
        F.coalesce("fit.action", F.lit("allow")).alias("verdict"),
    )


#: The rules that the query applies.
HOST_RULES = [Rule("block", "net/", True), Rule("allow", "example.net/en/", True), Rule("block", "example.com/de/", True), Rule("allow", "org/fr/", True)]
PATTERNS = [
    Rule("block", "/cgi-bin/"),
    Rule("block", "/wp-login^"),
    Rule("block", "||ads.*"),
    Rule("block", "||tracker.*"),
    Rule("block", ".exe|"),
    Rule("allow", "/robots.txt|"),
]

SQL = r"""
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN regexp_matches(host || path, '^([^/]*\.)?example\.net/en/') THEN 'example.net/en/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?example\.com/de/') THEN 'example.com/de/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?org/fr/') THEN 'org/fr/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?net/') THEN 'net/' END AS rule
  FROM cut),
matched AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_matches(low, '/robots\.txt$') THEN '/robots.txt|'
    WHEN regexp_matches(low, '^[a-z][a-z0-9+.\-]*://([^/?#]*\.)?tracker\.') THEN '||tracker.*'
    WHEN regexp_matches(low, '/wp-login([^a-z0-9_.%\-]|$)') THEN '/wp-login^'
    WHEN contains(low, '/cgi-bin/') THEN '/cgi-bin/'
    WHEN regexp_matches(low, '^[a-z][a-z0-9+.\-]*://([^/?#]*\.)?ads\.') THEN '||ads.*'
    WHEN regexp_matches(low, '\.exe$') THEN '.exe|' END AS pattern
  FROM ruled)
SELECT page_id, host, path, rule, pattern, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN pattern IS NULL OR pattern = '/robots.txt|' THEN 'allow' ELSE 'block' END AS verdict
FROM matched
"""


@query("op1_url_filters", SQL)
def op1_url_filters(spark, sf_dir):
    """Host, path, host rule and verdict of every page's URL."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), HOST_RULES + PATTERNS).drop("url")
