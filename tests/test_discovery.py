from pyspark.sql import functions as F

from pagesift.operators import cards, directory, forms
from pagesift.operators.html import parse_pages
from pagesift.plans import discover, render
from pagesift.plans.search import search
from pagesift.operators.ranking import dispatch_order, rank_results
from pagesift.sources.rules import Rules, read_rules

RULES = Rules(categories=[("Books", "#a, #b"), ("Games", "#c")])


def links(pages, html):
    rows = directory.website_links(pages(html), RULES, "site").orderBy("category_ord", "header_id", "node_id")
    return [(r.category, r.title, r.url, r.starred) for r in rows.collect()]


def test_heading_without_list_takes_the_next_one(pages):
    html = "<h2 id=a>A</h2><p>x</p><h2 id=c>C</h2><ul><li class=starred><a href=u> T </a></ul><h2 id=b>B</h2>"
    assert links(pages, html) == [("Books", "T", "u", True), ("Games", "T", "u", True)]


def test_link_rules(pages):
    html = """<h2 id=a>A</h2><ul>
      <li><a href=ok>Fine</a> <a href=n>+12</a> <a href=f>1.5</a> <a href=' '>blank</a> <a>none</a>
      <li><a href=g>Globe</a><i class='x i-twemoji-globe-with-meridians'></i>
      <li><a href=x>Click here</a> <a href='https://GitHub.com'>code</a>
      <li class=starred><ul><li><a href=in>Inner</a></ul>
    </ul>"""
    assert [x[1:] for x in links(pages, html)] == [("Fine", "ok", False), ("1.5", "f", False), ("Inner", "in", False)]


def test_links_outside_a_list_item_of_the_list(pages):
    # The list itself stands in an outer li, so "li a" holds although the list has no item.
    html = "<ul><li><h2 id=a>A</h2><ul><a href=u>T</a></ul></li></ul>"
    assert [x[2] for x in links(pages, html)] == ["u"]


def test_first_by_url_keeps_written_order(spark):
    rows = [("u", "late", 1, 0, 5, 5), ("u", "first", 0, 1, 9, 9), ("u", "x", 0, 2, 1, 1), ("v", "only", 7, 0, 0, 0)]
    made = spark.createDataFrame(
        [(u, t, "c", False, p, c, h, n) for u, t, p, c, h, n in rows],
        "url string, title string, category string, starred boolean, page_ord int, category_ord int, header_id int, node_id int",
    )
    first = directory.first_by_url(made)
    assert "partial_min_by" in first._jdf.queryExecution().executedPlan().toString()
    got = {r.url: r.title for r in first.collect()}
    assert got == {"u": "first", "v": "only"}


def form(pages, *htmls):
    made = pages(*htmls).withColumn("url", F.lit("https://x.org/home/"))
    rows = forms.search_links(made, "site").orderBy("site").collect()
    return [(r.search_url, r.reject_reason) for r in rows]


def test_forms(pages):
    got = form(
        pages,
        "<form><input type=submit value='Sign up'><input type=text name=q></form>",  # a submit label is not text
        "<footer><form><input type=text name=''></form></footer>",  # a lone input is taken unscored, empty name too
        "<form><input type=text></form>",
        "<form><textarea></textarea><input type=text name=q></form>",
        "<form><h3>Log In</h3><input type=text name=q></form>",
        "<form method=dialog><input type=text name=q></form>",
        "<form><input type=text name=a></form><form><input type=text name=b></form>",  # tie: document order
        "<footer><form><input type=text name=a></form></footer><footer><form><input type=text name=b></form></footer>",
        None,
    )
    assert got == [
        ("https://x.org/home/?q={0}", None), ("https://x.org/home/?={0}", None), (None, "no_name"),
        (None, "no_get_form"), (None, "no_get_form"), (None, "no_get_form"), ("https://x.org/home/?a={0}", None),
        (None, "no_named_input"), (None, "no_page"),
    ]


def test_input_score(pages):
    page = pages(
        "<header><form role=search><input type=search name=q></form></header>"
        "<footer><form><input type=text name=q></form></footer>"
    )
    rows = forms.with_candidates(page).select(F.inline("inputs")).collect()
    assert [r.score for r in rows] == [310, -155]


def selector(spark, *htmls):
    made = spark.createDataFrame([("s", i, h) for i, h in enumerate(htmls)], "site string, probe_no int, html string")
    row = cards.find_card_selectors(parse_pages(made), "site").first()
    return (row.selector, row.reject_reason) if row else None


def card(n, extra=""):
    return f"<div class='card {extra}'><a href=/{n}>t{n}</a><p>some text</p></div>"


def test_card_selector(spark):
    one = "<div id=r>" + card(1, "x") + card(2, "y") + "</div>"
    two = "<div id=r>" + card(3) + card(4) + "</div>"
    assert selector(spark, "<p>none</p>", one, two) == ("div#r > div.card", None)
    assert selector(spark, one, one, two) is None or selector(spark, one, one, two)[0] is None


def test_leaf_siblings_of_other_tags_share_a_group(spark):
    # li and a leaves have the same (empty) child signature: the first element decides.
    page = "<div id=r><a href=1>first long text</a><li>second</li></div>"
    assert selector(spark, "", page, page) == ("div#r > a", None)


def test_single_new_anchor_is_a_pattern(spark):
    page = "<p id=r><a href=1>only</a></p>"
    assert selector(spark, "", page, page) == ("p#r > a", None)


def test_only_pagination(spark):
    page = "<div class=p><a>1</a><a>2</a></div>"
    assert selector(spark, "", page, page) == (None, "only_pagination")


def test_pager_loses_against_cards_and_ties_go_to_the_first(spark):
    page = "<div id=a>" + card(1) + card(2) + "</div><div id=b>" + card(3) + card(4) + "<hr></div><div><a>Next</a></div>"
    assert selector(spark, "", page, page) == ("div#a > div.card", None)


def test_same_class_elsewhere_is_still_a_candidate(spark):
    # The blacklist key is the full tag path, so the same card in another place counts.
    none = "<section>" + card(9) + "</section>"
    page = none + "<div id=r>" + card(1) + card(2) + "</div>"
    assert selector(spark, none, page, page) == ("div#r > div.card", None)


def test_mean_is_truncated(spark):
    made = spark.createDataFrame([("s", 10), ("s", 11), ("s", 11)], "site string, elapsed_ms bigint")
    assert cards.mean_response_ms(made, "site").first().response_time == 10


def test_probe_queries(spark):
    made = spark.createDataFrame([("Books",), ("Anime",)], "category string")
    got = cards.probe_queries(made, Rules()).orderBy("category", "probe_no").collect()
    assert [r.probe_query for r in got] == [
        "asdfghjklqwerty12345", "the", "of", "asdfghjklqwerty12345", "sherlock", "harry potter",
    ]


def test_read_rules(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(
        '{"Other": 1, "ScraperRules": {"MegathreadUrls": ["d"], "MegathreadSkipKeywords": ["k"], "SearchSkipKeywords": ["t"],'
        ' "Categories": [{"Name": "N", "Selector": "#a, #b"}],'
        ' "CardFindingQueries": {"InvalidQuery": "zz", "ValidQueries": {"N": ["p", "q"]}}}}'
    )
    rules = read_rules(spark, str(path))
    assert rules == Rules(["d"], ["k"], ["t"], [("N", "#a, #b")], "zz", {"N": ("p", "q")})


def test_discovered_links_feed_search(spark):
    """Directory -> home -> probes -> link -> search, all from one capture table."""
    site = "https://x.org"
    home = "<form action=/find><input type=search name=q></form>"

    def cards_of(*names):
        return "<div id=r>" + "".join(
            f"<div class=card><a href='/p/{n}'></a><h2>{n}</h2></div>" for n in names
        ) + "</div>"

    captures = spark.createDataFrame(
        [
            (1, "https://dir", "<h2 id=a>A</h2><ul><li><a href='https://x.org'>X</a><li><a href=/rel>R</a></ul>", 1),
            (2, site, home, 1),
            (3, f"{site}/find?q=asdfghjklqwerty12345", home, 10),
            (4, f"{site}/find?q=sherlock", home + cards_of("sherlock one", "sherlock two"), 20),
            (5, f"{site}/find?q=harry+potter", home + cards_of("harry", "potter"), 33),
            (6, f"{site}/find?q=Harry%20Potter", home + cards_of("potter harry", "harry-potter", "other"), 5),
        ],
        "capture_id bigint, url string, html string, elapsed_ms bigint",
    )
    pages = spark.createDataFrame([("https://dir", 0)], "url string, page_ord bigint")
    frame = discover.discovery_report(captures, pages, RULES)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert plan.count("MapInArrow") == 1  # the probe pages are parsed once
    report = frame.collect()
    assert {(r.url, r.reject_stage, r.reject_reason) for r in report} == {
        (site, None, None), ("/rel", "form", "no_capture"),
    }
    found = discover.discover(captures, pages, RULES)
    link = found.first()
    assert (link.search_url, link.selector, link.response_time) == (f"{site}/find?q={{0}}", "div#r > div.card", 21)
    queries = spark.createDataFrame([("Harry Potter",), ("Not Captured",)], "query string")
    results = rank_results(search(queries, dispatch_order(found), captures)).orderBy("rank").collect()
    # The slug "harry potter" equals the query, so it replaces the title "harry-potter".
    assert [(r.title, r.rank) for r in results] == [("Harry Potter", 1), ("Potter Harry", 2), ("Other", 3)]
    assert [r.score for r in results][:2] == [101, 95]


def test_mean_time_needs_all_three(spark):
    data = [(1, 10), (1, 20), (1, None), (2, 10), (2, 20), (2, 31), (3, 5)]
    times = spark.createDataFrame(data, "site int, elapsed_ms bigint")
    assert {r.site: r.response_time for r in cards.mean_response_ms(times, "site").collect()} == {1: None, 2: 20, 3: None}


def test_card_discovery_has_one_exchange_and_is_linear(spark):
    import time

    from pagesift.operators.html import parse_pages

    def probes(n):
        body = "".join(f"<div class='card x{i % 3}'><a href='/{i}'>t {i}</a><p>some words</p></div>" for i in range(n))
        page = f"<main><div id=r>{body}</div></main>"
        rows = [(1, 0, "<p>none"), (1, 1, page), (1, 2, page)]
        return parse_pages(spark.createDataFrame(rows, "site int, probe_no int, html string"))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cards.find_card_selectors(probes(2), "site")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1, plan
    took = {}
    for n in (200, 2000, 8000):
        start = time.perf_counter()
        assert cards.diff_candidates(probes(n), "site").count() == 2 * (3 * n + 2)
        took[n] = time.perf_counter() - start
    assert took[8000] < 8 * took[2000]


def test_customer_homes_of_one_row_group_are_many_tasks(spark, tmp_path):
    rows = 25_000
    made = spark.range(rows).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("c_custkey"))
    made.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    homes = render.customer_homes(spark, str(tmp_path))
    tasks = homes.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(t["n"] for t in tasks) == rows
    assert max(t["n"] for t in tasks) < 1.1 * rows / spark.sparkContext.defaultParallelism
