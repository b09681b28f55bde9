import random

import pytest
from pyspark.sql import functions as F

from pagesift.functions.urls import url_escape
from pagesift.operators import extract, ranking
from pagesift.plans.search import search

WORDS = ["category", "tag"]


def found(pages, html, selector=".card", count_self_href=True):
    made = pages(html).withColumn("url", F.lit("https://x.org/home")).withColumn("selector", F.lit(selector))
    rows = extract.extract(made, WORDS, "url", count_self_href=count_self_href).orderBy("card_ord").collect()
    return [(r.card_ord, r.result_url, r.raw_title, r.image_url, r.alt_text) for r in rows]


def test_cards(pages):
    html = """
      <div class=card><a href=/tag/x>T</a><a href=/shared>S</a><a href=/one><img src=i.png alt=''></a><h1> </h1><h3>H3</h3></div>
      <div class=card><a href=/shared>S</a><a href='/two'> </a><a href=/two>Two</a><img data-src=' ' data-image=/z.png></div>
      <div class=card><p>no link</p></div>
      <div class=card><a href=/three></a>all <b>text</b></div>
      <div class=card><a href=' '>blank</a></div>"""
    assert found(pages, html) == [
        (0, "https://x.org/one", "H3", "https://x.org/i.png", ""),
        (1, "https://x.org/two", "Two", "https://x.org/z.png", None),
        (3, "https://x.org/three", "all text", None, None),
    ]


def test_only_the_first_heading_of_a_kind_counts(pages):
    html = "<div class=card><a href=/a></a><h2> </h2><h2>second</h2><h3>third</h3></div>"
    assert found(pages, html)[0][2] == "third"


def test_link_in_one_card_twice_is_unique(pages):
    html = "<div class=card><a href=/a>x</a><a href=/a>y</a></div><div class=card><a href=/b>z</a></div>"
    assert [r[1] for r in found(pages, html)] == ["https://x.org/a", "https://x.org/b"]


def test_anchor_cards_need_their_own_href_counted(pages):
    html = "<a class=card href=/a>A</a><a class=card href=/b>B</a><a class=card href=/b>C</a><a class=card>D</a>"
    assert [r[1] for r in found(pages, html)] == ["https://x.org/a"]
    assert found(pages, html, count_self_href=False) == []


def test_stored_selector_matches_anywhere_on_the_page(pages):
    html = "<p><i class=x><a href=/1>1</a></i></p><div><p><i class='x y'><a href=/2>2</a></i></p></div>"
    assert [r[2] for r in found(pages, html, "p > i.x")] == ["1", "2"]


def test_bad_link_drops_the_card(pages):
    made = pages("<div class=card><a href=/a>x</a></div>").withColumn("url", F.lit("no-base"))
    made = made.withColumn("selector", F.lit(".card"))
    assert extract.extract(made, WORDS, "url").count() == 0


TEMPLATES = [
    "https://a.org/?q={0}", "https://a.org/search/{0}/", "https://a.org/search/x-{0}.html", "https://b.org/f?s={0}#top",
    "https://a.org/{0}", "https://a.org/?q={0}&p=1", "no place",
]


def test_fan_out_equals_the_full_product(spark):
    queries = ["", "Batman", "A B", "X-y", "100% ~é", "Top"]
    qs = spark.createDataFrame([(q,) for q in queries], "query string")
    links = spark.createDataFrame([(t,) for t in TEMPLATES], "search_url string")
    # Brute force: every template filled with every query.
    filled = qs.crossJoin(links).filter(F.contains("search_url", F.lit("{0}"))).select(
        "query", "search_url", F.replace("search_url", F.lit("{0}"), url_escape(F.col("query"))).alias("url")
    )
    made = filled.select("url").distinct().collect()
    urls = [r.url for r in made] + ["https://a.org/?q=Not&more", "https://c.org/?q=Batman", "https://a.org/search/a/b/"]
    captures = spark.createDataFrame(list(enumerate(urls)), "capture_id bigint, url string")
    want = {(r.query, r.search_url, r.url) for r in filled.collect()}
    got = extract.search_fanout(qs, links, captures).join(captures, "capture_id")
    rows = [(r.query, r.search_url, r.url) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want


@pytest.mark.parametrize("hot", [False, True])
def test_rank_equals_a_plain_sort(spark, hot):
    rnd = random.Random(7)
    rows = [
        ("hot" if hot or rnd.random() < 0.4 else rnd.choice("abc"), rnd.choice([-31, 0, 0, 0, 101]), rnd.randrange(5000), i)
        for i in range(600)
    ]
    made = spark.createDataFrame(rows, "query string, score int, link_ord bigint, card_ord int")
    got = {r.card_ord: r.rank for r in ranking.rank_results(made).collect()}
    want, seen = {}, {}
    for q, s, link, c in sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3])):
        seen[q] = want[c] = seen.get(q, 0) + 1
    assert got == want
    ordered = [r.card_ord for r in ranking.order_results(made).collect()]
    assert ordered == [r[3] for r in sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))]


def test_dispatch_order(spark):
    rows = [(f"{i * 7919 % 1000:03d}", i % 3) for i in range(200)]
    made = spark.createDataFrame(rows, "id string, response_time bigint")
    got = [r.id for r in ranking.dispatch_order(made).orderBy("link_ord").collect()]
    assert got == [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]


def test_slug_wins_only_when_better(spark):
    made = spark.createDataFrame(
        [(1, "Batman", "batman", "batman", False), (2, "Batman", "xx", "batman", False), (3, "Batman", "xx", "batman", True)],
        "i int, query string, raw_title string, slug string, is_anchor_card boolean",
    )
    got = {r.i: (r.title, r.score) for r in ranking.title_or_slug(made).collect()}
    assert got[1] == ("Batman", 101) and got[2] == ("Batman", 101) and got[3][0] == "Xx" and got[3][1] < 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_plan(spark):
    from pagesift.plans import render
    from pagesift.plans.search_queries import searched

    plan = _plan(searched(spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1
    assert plan.count("_ratios") and render.SELECTOR
    # Nothing is shuffled between the parse and the scored rows.
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_unwanted_pages_are_never_parsed(spark):
    captures = spark.createDataFrame(
        [(1, "https://a.org/?q=B", "<p class=card><a href=/x>B</a></p>"), (2, "https://a.org/?q=C", "<p>")],
        "capture_id bigint, url string, html string",
    )
    link = spark.createDataFrame(
        [("https://a.org", "A", "c", True, "https://a.org/?q={0}", ".card", 0)],
        "url string, title string, category string, starred boolean, search_url string, selector string, link_ord bigint",
    )
    rows = search(spark.createDataFrame([("B",)], "query string"), link, captures).collect()
    assert [(r.query, r.title, r.score, r.website_title, r.website_starred) for r in rows] == [("B", "B", 101, "A", True)]


def test_unknown_times_and_queries_lose_no_row(spark):
    data = [("b", None), ("a", None), ("c", 30), ("d", 10), ("e", 10), ("f", 5000), ("g", 101)]
    links = spark.createDataFrame(data, "id string, response_time bigint")
    got = {r.id: r.link_ord for r in ranking.dispatch_order(links).collect()}
    assert got == {"d": 0, "e": 1, "c": 2, "g": 3, "f": 4, "a": 5, "b": 6}
    rows = [("q", 5, None, 0), ("q", 5, 1, 0), ("q", None, 1, 1), (None, 7, 2, 0), (None, 9, None, None), ("q", 9, 3, 0)]
    results = spark.createDataFrame(rows, "query string, score int, link_ord bigint, card_ord int")
    ranked = {(r["query"], r.score, r.link_ord): r["rank"] for r in ranking.rank_results(results).collect()}
    assert ranked == {("q", 9, 3): 1, ("q", 5, None): 2, ("q", 5, 1): 3, ("q", None, 1): 4, (None, 9, None): 1, (None, 7, 2): 2}


def test_captures_of_different_hosts_share_no_head(spark):
    urls = ["https://a.org/find?q=x", "https://a.org/find?p=1&q=y", "https://b.org/find?q=x", "http://c.org?q=1", "odd", "https://x.b.org/"]
    heads = spark.createDataFrame([(u,) for u in urls], "u string").select(
        "u", F.explode(extract._heads(F.col("u"), F.length(F.regexp_extract("u", extract._AUTHORITY, 0)))).alias("h")
    )
    hosts = {}
    for r in heads.collect():
        hosts.setdefault(r.h, set()).add(r.u.split("/")[2].split("?")[0])
    assert hosts and all(len(h) == 1 for h in hosts.values())


def test_query_in_the_host_name(spark):
    links = spark.createDataFrame([("https://{0}.example.com/", 1), ("https://b.org/?q={0}", 2)], "search_url string, link_ord int")
    captures = spark.createDataFrame([(1, "https://some.example.com/"), (2, "https://b.org/?q=some")], "capture_id int, url string")
    got = extract.template_captures(captures, links).select("capture_id", "link_ord", "query_key").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "some"), (2, 2, "some")]
