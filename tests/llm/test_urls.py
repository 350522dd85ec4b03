from __future__ import annotations

import math
import re

import pytest
from conftest_llm import fold
from pyspark.sql import functions as F

from scorebook.llm import urls

URLS = [
    "https://a.com/x", "https://a.com", "http://EXAMPLE.com/en/1", "http://www.Example.com/en/1", "http://m.example.com/en/", "http://xexample.com/en/",
    "http://b.net/es/9?x=1&y=2", "http://net/fr/#t", "http://b.net/en/", "http://b.net?q=/es/", "http://b.org/a/b/c.html", "//b.com/x", "b.com/x",
    "", None, "http://", "x://y.com:80/z", "http://a.com/?u=http://b.net/es/", "http://c.net/fr", "ftp://user@d.com/\nq", "http://über.com/ü",
    "http://a.com/" + "p/" * 3000, "http://e.net/es/1", "http://e.net/es/2",
]
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def plain(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (fold(m[1]), m[2]) if m else ("", "")
    best = None
    for rule in RULES:
        of, start = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == of or host.endswith("." + of)) and path.startswith(start) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(enumerate(URLS)) + [(None, URLS[0]), (1, URLS[1])], "page_id long, url string")


def test_hosts_paths_and_rules_equal_a_plain_version(pages):
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for i, url in enumerate(URLS):
        host, path, rule = plain(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == RULES[rule] if rule else got[i].verdict in ("allow", "block")
    assert got[None].verdict == "allow" and urls.judge(pages).count() == pages.count()


def test_entropy(spark):
    for text in ("", "a", "abab", "http://ü.com/aab?.*"):
        n = len(text)
        want = -sum(text.count(c) / n * math.log2(text.count(c) / n) for c in set(text))
        assert spark.range(1).select(urls.entropy(F.lit(text))).first()[0] == pytest.approx(want)


def test_trees_learn_from_labelled_urls(spark):
    def url(i, bad):
        return f"http://h{i % 40}.{'bad' if bad else 'good'}{i % 7}.org/" + ("a/b/c/d?x=1&y=2&z=3" if bad else "story-about-things")

    labelled = spark.createDataFrame([(url(i, i % 3 == 0), "block" if i % 3 == 0 else "allow") for i in range(600)], "url string, verdict string")
    fresh = spark.createDataFrame([(i, url(i + 1000, i % 2 == 0)) for i in range(100)], "page_id long, url string")
    got = urls.judge(fresh, rules=(), labelled=labelled).collect()
    right = sum((r.verdict == "block") == (r.page_id % 2 == 0) for r in got)
    assert right >= 97 and all(0 <= r.score <= 1 and r.rule is None for r in got)


def test_one_class_no_class_and_no_rows(spark):
    table = lambda *u: spark.createDataFrame(list(enumerate(u)), "page_id long, url string")
    one = urls.judge(table("http://a.net/es/", "http://b.org/"))
    assert [(r.verdict, r.score) for r in one.orderBy("page_id").collect()] == [("block", None)] * 2
    assert [r.verdict for r in urls.judge(table("http://b.org/", None)).collect()] == ["allow"] * 2
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_runs_agree_and_use_no_python(spark, pages):
    clashing = pages.withColumns({c: F.lit("own") for c in ("host", "path", "rule", "score", "_id", "depth")})
    first, second = urls.judge(pages), urls.judge(clashing.repartition(3))
    assert sorted(map(repr, first.collect())) == sorted(map(repr, second.collect()))
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_frequent_url_does_not_fill_its_class(spark):
    bad = [f"https://shop{i}.spam/buy/now/{i}{i * 7 % 1000}?id={i}&ref={i * 3}&x={i}" for i in range(60)]
    good = [f"https://paper{i}.org/essay/on-rivers" for i in range(60)]
    rows = [(u, "block") for u in [bad[0]] * 3000 + bad] + [(u, "allow") for u in good]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    asked = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    out = {r.page_id: r.verdict for r in urls.judge(asked, rules=[], labelled=labelled, train_rows=50).collect()}
    assert sum(out[i] == "block" for i in range(60)) > 50 and sum(out[i] == "allow" for i in range(60, 120)) > 50
