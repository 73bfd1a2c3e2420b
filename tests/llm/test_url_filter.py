import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pairmatch.llm.url_filter import ENDING, HOST_NAME, LABELS, RULES, judge_urls, propagate, site_edges

PAGES = [
    (1, "https://WWW.Example.com/en/x?a=/fr/", "see http://friend.org/ now"),
    (2, "http://a.example.com/en/", ""),
    (3, "http://a.example.com/de/", None),
    (4, "http://x.net/es/1", 'a <a href="http://bad.net/">x</a>'),
    (5, "http://x.net/de/1", ""),
    (6, None, "text"),
    (7, "no scheme", "text"),
    (8, "http://", ""),
    (9, "http://friend.org#top", ""),
    (10, "http://lonely.org/", ""),
    (11, "http://fan.org/p", "buy at x.net today"),
    (11, "http://fan.org/p", "buy at x.net today"),
    (12, "http://notcom/", ""),
    (13, "http://example.com?x", ""),
]


def judged(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return judge_urls(df).collect()


def test_rules_and_verdicts(spark):
    got = {r.page_id: r for r in judged(spark, PAGES)}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == (
        "www.example.com", "/en/x", "www.example.com/en/", "allow",
    )
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block")
    assert (got[3].rule, got[3].verdict) == ("com/", "allow")
    assert (got[4].rule, got[4].verdict) == ("net/es/", "block")
    # No rule: the host itself holds blocked pages.
    assert (got[5].rule, got[5].verdict) == (None, "block")
    for page in (6, 7, 8):
        assert (got[page].host, got[page].path, got[page].rule, got[page].verdict) == ("", "", None, "allow")
    # Linked from a trusted host; reached by nothing; linking to a blocked host.
    assert (got[9].host, got[9].path, got[9].verdict, got[9].trust_share) == ("friend.org", "", "allow", 1.0)
    assert got[10].verdict == "allow" and got[10].trust_share is None
    assert got[11].verdict == "block" and got[11].trust_share == 0.0
    assert got[12].rule is None
    # A path must start with the rule's: an empty one fits none.
    assert (got[13].path, got[13].rule) == ("", None)


def test_every_row_stays(spark):
    assert len(judged(spark, PAGES)) == len(PAGES)
    assert judged(spark, []) == []
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    with pytest.raises(ValueError):
        judge_urls(df.withColumnRenamed("page_id", "Host"))
    assert len({r.text for r in RULES}) == 5


def test_propagation_equals_a_plain_loop(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), ("c", "a")]
    seeds = [("a", 2.0, 0.0), ("c", 0.0, 3.0), ("b", 1.0, 0.0), ("d", 0.0, 0.0)]
    got = propagate(
        spark.createDataFrame(edges, "src string, dst string"),
        spark.createDataFrame(seeds, "host string, trust double, distrust double"),
        rounds=9,
    ).collect()
    for column, directed in ((1, edges), (2, [(b, a) for a, b in edges])):
        start = {s[0]: s[column] / 3 for s in seeds}
        mass = dict(start)
        for _ in range(9):
            new = {h: 0.15 * start[h] for h in start}
            for src, dst in directed:
                new[dst] += 0.85 * mass[src] / sum(s == src for s, _ in directed)
            mass = new
        for r in got:
            assert abs(r[column] - mass[r["host"]]) < 1e-12


def test_host_names_in_two_steps_are_those_of_the_plain_pattern(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "bc", "com", ".", ".", "..", "-", "1", " ", "/", "é", "x2"], k=rng.randint(0, 40))) for _ in range(4000)]
    rows = F.regexp_extract_all("html", F.lit(LABELS), F.lit(0))
    names = F.filter(F.transform(rows, lambda r: F.regexp_extract(r, ENDING, 0)), lambda n: n != "")
    df = spark.createDataFrame([(t,) for t in texts], "html string").select("html", names.alias("names"))
    for r in df.collect():
        assert r.names == re.findall(HOST_NAME, r.html)


@pytest.mark.parametrize("html", ["a" * 1_000_000, "a." * 500_000, "a-" * 500_000, "ab." * 300_000 + "1", "a.com " * 200_000])
def test_long_pages_take_linear_time(spark, html):
    judged(spark, PAGES)
    started = time.perf_counter()
    got = judged(spark, [*PAGES, (99, "http://long.org/", html)])
    assert len(got) == len(PAGES) + 1 and time.perf_counter() - started < 30
    alone = spark.createDataFrame([(html,)], "html string")
    started = time.perf_counter()
    alone.select(F.size(F.regexp_extract_all("html", F.lit(LABELS), F.lit(0)))).collect()
    assert time.perf_counter() - started < 5


def test_parent_domains_of_any_depth(spark):
    deep = ".".join(["a"] * 80 + ["org"])
    hosts = spark.createDataFrame([(deep,), ("a.org",), ("org",), ("b.org",)], "host string")
    got = {(r.src, r.dst) for r in site_edges(hosts).collect()}
    up = {(deep, "a.org"), (deep, "org"), ("a.org", "org"), ("b.org", "org")}
    assert got == up | {(b, a) for a, b in up}
