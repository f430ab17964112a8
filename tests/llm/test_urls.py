"""The URL automaton against regular expressions and defined rows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pixelseek.llm import urls
from pixelseek.llm.urls import Automaton, Rule, judge_urls
from tests.llm.helpers import clash, rows

RULES = [
    Rule("allow", "org"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]
URLS = [
    "http://example.org/es/1?x=/",
    "https://WWW.Example.ORG/es/",
    "https://example.org/en/12",
    "https://notexample.org/es/9",
    "https://example.org",
    "https://example.org?x",
    "http://b.com/fr/1#x",
    "http://b.com/de/1",
    "http://b.com/DE/1",
    "http://b.net/x.org/es/",
    "http://b.net/a?u=http://example.org/es/",
    "example.org/es/",
    "",
    None,
    "://",
    "x://y://example.org/es/",
    "http://é.org/ü/",
    "http://example.org/es/" + "long/" * 30_000,
]


def fits(rule, host, path):
    """The rule as a regular expression on host and path."""

    def glob(text, run):
        return "".join({"*": run, "?": "[\\s\\S]" if run == "[\\s\\S]*" else "[^/]"}.get(c, re.escape(c)) for c in text)

    return bool(
        re.fullmatch(r"(?:[^/]*\.)?" + glob(rule.host, "[^/]*"), host)
        and re.match(glob(rule.path, "[\\s\\S]*"), path)
    )


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def expected(url, rules, unmatched="allow"):
    host, path = parts(url)
    fitting = [r for r in rules if fits(r, host, path)]
    best = min(fitting, key=lambda r: (-len(r.text), r.verdict != "block", r.text), default=None)
    return host, path, best and best.text, best.verdict if best else unmatched


def test_rules_against_regular_expressions(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").repartition(2)
    for unmatched in ("allow", "block"):
        got = judge_urls(pages, RULES, unmatched=unmatched).select("page_id", "host", "path", "rule", "verdict")
        assert sorted(map(tuple, got.collect())) == [(i, *expected(u, RULES, unmatched)) for i, u in enumerate(URLS)]


def test_random_globs_over_many_words():
    rng = random.Random(5)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    rules = [
        Rule(rng.choice(["allow", "block"]), word("ab.*?", 5), "/" + word("ab/*?", 5)) for _ in range(60)
    ]
    automaton = Automaton(rules)
    assert automaton.words > 5
    pairs = [(word("ab.", 8), rng.choice(["", "/"]) + word("ab/c", 9)) for _ in range(3000)]
    pairs = [(h, p if not p or p[0] == "/" else "/" + p) for h, p in pairs]
    at = automaton.winners(["." + h + p for h, p in pairs])
    hits = 0
    for (host, path), i in zip(pairs, at):
        want = expected(f"x://{host}{path}", rules)[2:]
        assert ((automaton.rules[i].text, automaton.rules[i].verdict) if i >= 0 else (None, "allow")) == want, (host, path)
        hits += i >= 0
    assert 300 < hits


def test_equal_rules_prefer_block():
    automaton = Automaton([Rule("allow", "a.org"), Rule("block", "a.org"), Rule("block", "?.org")])
    assert [automaton.rules[i].verdict for i in automaton.winners([".a.org/"])] == ["block"]


def test_defined_cases(spark, monkeypatch):
    pages = spark.createDataFrame([(1, None), (1, None), (None, "http://a.org/")], "page_id long, url string")
    assert rows(judge_urls(clash(pages, F), RULES), "page_id", "rule", "verdict", "h", "`a.b`") == [
        (1, None, "allow", "own", "own"),
        (1, None, "allow", "own", "own"),
        (None, "org/", "allow", "own", "own"),
    ]
    again = judge_urls(pages.withColumn("rule", F.lit(3)), [])
    assert again.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert {r.verdict for r in again.collect()} == {"allow"}
    assert judge_urls(pages.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        judge_urls(pages, [Rule("perhaps", "a.org")])
    monkeypatch.setattr(urls, "MAX_MASK_BYTES", 100)
    with pytest.raises(ValueError):
        Automaton(RULES)


def test_no_shuffle(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert "Exchange" not in judge_urls(pages, RULES)._jdf.queryExecution().executedPlan().toString()
