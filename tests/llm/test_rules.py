"""URL filters and quality rules."""

import random
import re
from collections import Counter

import cases
import pytest
from linewright.llm import quality_rules, url_filters
from linewright.llm.url_filters import Rule
from pyspark.sql import functions as F

URLS = [
    (1, "http://tionsh.example.net/fr/25930"),
    (2, "https://blog.example.com/de/7198#top"),
    (3, "https://Blog.EXAMPLE.net/en/?x=1"),
    (4, "http://example.net"),
    (5, "http://notexample.com/de/1"),
    (6, "https://a.b.org/fr/x?y#z"),
    (7, None),
    (8, "no scheme/net/"),
    (9, ""),
    (10, "http://user@x.net:80/"),
    (11, "http://x.com/cgi-bin/run"),
    (12, "http://x.com/Robots.TXT"),
    (13, "http://x.com/robots.txt"),
    (14, "https://ads.x.com/robots.txt"),
    (15, "http://x.com/a.exe"),
    (16, "http://x.com/a.exe?b"),
    (17, "http://x.com/wp-login"),
    (18, "http://x.com/wp-logins"),
    (19, "http://x.com/" + "a/" * 20_000 + "cgi-bin/"),
    (2, "https://blog.example.com/de/7198#top"),
    (None, "http://y.net/"),
]


def fits(rule: Rule, url: str) -> bool:
    """A rule tried by hand, without its tokens."""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    host, path = (cases.lower(m[1]), m[2]) if m else ("", "")
    if rule.is_host:
        rule_host, _, rest = rule.text.partition("/")
        return (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rest)
    return re.search(rule.regex(), cases.lower(url)) is not None


def by_hand(url: str | None, rules: list[Rule]):
    fitting = [r for r in rules if url is not None and fits(r, url)]
    best = max(fitting, key=lambda r: (r.is_host, len(r.text), r.action == "allow", r.text), default=None)
    if best is None:
        return None, None, "allow"
    return (best.text, None, best.action) if best.is_host else (None, best.text, best.action)


def test_urls_like_every_rule_tried_on_every_url(spark):
    rules = url_filters.HOST_RULES + url_filters.PATTERNS + [Rule("block", "*x*"), Rule("allow", "|https://a."), Rule("block", "^z|")]
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit("own")).withColumn("fit", F.lit(1))
    got = Counter((r.page_id, r.url, r.rule, r.pattern, r.verdict) for r in url_filters.judge_urls(pages, rules).collect())
    assert got == Counter((i, u, *by_hand(u, rules)) for i, u in URLS)


def test_host_and_path_of_urls_without_scheme_are_empty(spark):
    rows = {r.page_id: (r.host, r.path) for r in url_filters.judge_urls(spark.createDataFrame(URLS, "page_id long, url string"), url_filters.HOST_RULES).collect()}
    assert rows[7] == rows[8] == rows[9] == ("", "")
    assert rows[3] == ("blog.example.net", "/en/") and rows[4] == ("example.net", "") and rows[10] == ("user@x.net:80", "/")


def test_rules_are_filed_under_their_rarest_whole_token(spark):
    urls = spark.createDataFrame([(["http", "com", "ads"],), (["http", "com"],), (["http", "rare"],)], "tokens array<string>")
    rules = spark.createDataFrame([(0, ["ads", "com"]), (1, ["com", "http"]), (2, ["never", "rare"])], "rule_no long, tokens array<string>")
    assert {r.rule_no: r.token for r in url_filters.filed_rules(urls, rules).collect()} == {0: "ads", 1: "com", 2: "never"}
    assert Rule("block", "ban*ner/ads").tokens() == [] and Rule("block", "/ads/x").tokens() == ["ads"] and Rule("block", "||ads.x^").tokens() == ["ads", "x"]


def test_urls_of_an_empty_table_and_too_many_rules_without_token(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge_urls(none, url_filters.HOST_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filters.judge_urls(none, [Rule("block", f"*{'a' * k}*") for k in range(1, 70)])


def measured_by_hand(text):
    w = cases.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if cases.WORD.search(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures_and_base_rules(spark):
    rows = cases.awkward() + [(400, "a b\na b\n\na b \nc #$% |x|", "src9", "en"), (401, "a b c a b c d", "src9", "en"), (402, "x\x0by\x0cz\rq\xa0r", "src9", "en")]
    got = Counter(tuple(r[c] for c in ("doc_id", *quality_rules.MEASURES, "base_failed")) for r in quality_rules.judge_documents(cases.frame(spark, rows, extra=True)).collect())
    want = Counter()
    for doc_id, text, _, _ in rows:
        m = measured_by_hand(text)
        want[(doc_id, *m, m[0] < 50 or 100 * m[5] > 50 * m[0])] += 1
    assert got == want


def test_hosts_are_rejected_by_their_shrunk_rate(spark):
    rng = random.Random(4)
    good = [(i, cases.prose(rng, 80), f"good{i % 5}", "en") for i in range(100)]
    bad = [(1000 + i, "spam " * 60 if i % 10 else cases.prose(rng, 80), "bad", "en") for i in range(200)]
    one = [(2000, "short", "tiny", "en"), (2001, cases.prose(rng, 80), None, "en")]
    got = {r.doc_id: (r.host_failed, r.kept) for r in quality_rules.judge_documents(cases.frame(spark, good + bad + one)).collect()}
    assert all(got[i] == (True, False) for i in range(1000, 1200))
    assert all(got[i] == (False, True) for i in range(100))
    # one failure of one document is shrunk towards all hosts
    rates = {r.host: r.rate for r in quality_rules.host_rates(quality_rules.measured(cases.frame(spark, good + bad + one))).where("rule = 'base'").collect()}
    assert rates["tiny"] < 1 and abs(rates["bad"] - 0.9) < 0.05 and "None" not in rates and got[2001] == (False, True)


def test_kept_documents_keep_their_own_columns(spark):
    docs = cases.frame(spark, cases.awkward(), extra=True)
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    judged = quality_rules.judge_documents(docs)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in judged.where("kept").collect())
    assert {r.score for r in kept.collect()} == {"own score"}
    assert quality_rules.kept_documents(docs.limit(0)).count() == 0 and quality_rules.judge_documents(docs.limit(0)).count() == 0
