import random

import pytest

from inkwell.llm import url_filter
from inkwell.llm.queries import OP1_SQL, URL_RULES, op1_url_filter
from tests.oracle import differences

SCHEMA = "page_id long, url string"


def judged(spark, urls, rules, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), SCHEMA)
    found = url_filter.url_filter(pages, spark.createDataFrame(rules, url_filter.RULES), **options)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}


URLS = [
    None, "", "no scheme", "http://", "http://WWW.Example.COM/en/1?x=http://a.net/es/", "https://example.com/en/", "https://x.y.example.com/en/a#b", "http://badexample.com/en/",
    "http://a.net/es/1", "http://a.net/es", "http://net/fr/", "http://example.com?x=/en/", "http://a.net", "http://ÉX.com/é", "x://a..com/",
]


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_against_every_rule(spark, ranges):
    found = judged(spark, URLS * 5, URL_RULES, ranges=ranges)
    assert found == {i: url_filter.judged(u, URL_RULES) for i, u in enumerate(URLS * 5)}


def test_many_nested_rules_and_a_hot_host(spark):
    rng = random.Random(5)
    labels, parts = ["a", "b", "ab", "c"], ["", "/", "/a", "/a/", "/a/b", "/b"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), rng.choice(parts)) for _ in range(60))}.values())
    urls = [f"http://{host() if i % 3 else 'a.b.c'}{rng.choice(parts)}{rng.choice(['', 'x', '?q'])}" for i in range(900)]
    assert judged(spark, urls, rules, ranges=8) == {i: url_filter.judged(u, rules) for i, u in enumerate(urls)}


def test_odd_rules(spark):
    rules = [("com", "/", "allow"), ("com", "/", "block"), (None, "/", "block"), ("net", None, None), ("ORG", "/", "block")]
    found = judged(spark, ["http://x.com/", "http://y.net", "http://z.org/"], rules)
    assert [found[i][2:] for i in range(3)] == [("com/", "block"), ("net", "block"), ("org/", "block")]


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], "page_id long, url string, host int, `a.b` string")
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES)
    assert url_filter.url_filter(none, rules, keep=none.columns).columns == ["page_id", "url", "a.b", "host", "path", "rule", "verdict"]
    assert url_filter.url_filter(none, rules).count() == 0
    pages = spark.createDataFrame([(1, "http://a.com/", 5, "x"), (1, "http://a.com/", 5, "x"), (None, None, None, None)], none.schema)
    found = url_filter.url_filter(pages, spark.createDataFrame([], url_filter.RULES), keep=none.columns).collect()
    assert sorted((str(r["page_id"]), r.host, r.verdict, str(r["a.b"])) for r in found) == [("1", "a.com", "allow", "x")] * 2 + [("None", "", "allow", "None")]


def test_query(spark):
    assert differences(spark, "/root/testdata/sf0.001", op1_url_filter, OP1_SQL) == []
