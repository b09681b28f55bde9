import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesift.functions import dom, selectors
from pagesift.functions.css import matcher, nearest, select_by_steps, selector_steps
from pagesift.operators.html import build_tree, elements, parse_pages


def outline(html):
    """Nested (tag, ...) shape of the body, with text."""
    t = build_tree(html)
    text = "".join(t.chunks)

    def shape(i):
        kids = [j for j in range(len(t.tag)) if t.parent[j] == i]
        if not kids:
            return f"{t.tag[i]}:{text[t.start[i] : t.start[i] + t.length[i]]}"
        return f"{t.tag[i]}({' '.join(shape(j) for j in kids)})"

    return " ".join(shape(j) for j in range(len(t.tag)) if t.parent[j] == t.body)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a<p>b", "p:a p:b"),
        ("<ul><li>1<li>2<ul><li>n</ul><li>3</ul>", "ul(li:1 li(ul(li:n)) li:3)"),
        ("<table><tr><td>x<td>y<tr><th>z</table>", "table(tbody(tr(td:x td:y) tr(th:z)))"),
        ("<div><p>a</div>b", "div(p:a)"),
        ("<a>x<a>y</a>", "a:x a:y"),
        ("<form><form><input></form>", "form(input:)"),
        ("<br/><img src=a>t</br>", "br: img: br:"),
        ("<script>if (a < b) '</p>'</script><p>x", "p:x"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt:a dd:b dt:c)"),
        ("<select><option>a<option>b</select>", "select(option:a option:b)"),
        ("<h1>a<h2>b</h2>", "h1:a h2:b"),
        ("</p>", "p:"),
        ("<p>x</i></p><i>y", "p:x i:y"),
        ("<svg><path/><g/></svg><b>t", "svg(path: g:) b:t"),
        ("<p>&lt;b&gt; &amp &nbsp;x", "p:<b> &  x"),
        ("<!-- <p> --><p title='<b>'>q<!-->z", "p:qz"),
        ("<p>a<b", "p:a"),
    ],
)
def test_tree(html, want):
    if "<script" in html:
        t = build_tree(html)
        assert t.tag[2] == "script" and above(t, 2) == [0, 1]
    assert outline(html) == want


def above(tree, i):
    """Ids from the root down to the parent."""
    found = []
    while tree.parent[i] >= 0:
        i = tree.parent[i]
        found.insert(0, i)
    return found


def test_attributes():
    t = build_tree("""<a HREF='?a=1&copy=2&amp;c' href=x data-x = "1 2" checked class="b a b">""")
    assert t.attrs[-1] == {"href": "?a=1&copy=2&c", "data-x": "1 2", "checked": "", "class": "b a b"}


def test_head_and_body_are_implied():
    t = build_tree("<title>a</title><meta charset=x> <p>b")
    assert [(t.tag[i], above(t, i)) for i in range(len(t.tag))] == [
        ("html", []), ("head", [0]), ("title", [0, 1]), ("meta", [0, 1]), ("body", [0]), ("p", [0, 4]),
    ]


_TAGS = ["p", "div", "a", "ul", "li", "table", "tr", "td", "form", "b", "br", "h1", "button", "select", "option", "svg"]
_PIECES = st.one_of(
    st.sampled_from([f"<{t}>" for t in _TAGS] + [f"</{t}>" for t in _TAGS] + ["<script>", "</script>", "<!--", "-->"]),
    st.text("ab<>&;/'\"= é", max_size=6),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(_PIECES, max_size=30).map("".join))
def test_tree_invariants(html):
    t = build_tree(html)
    n, size = len(t.tag), len("".join(t.chunks))
    assert t.last[0] == n - 1 and t.start[0] == 0 and t.length[0] == size
    for i in range(1, n):
        up = t.parent[i]
        assert t.depth[i] == t.depth[up] + 1 == len(above(t, i))
        trimmed = t.full[t.start[i] : t.start[i] + t.length[i]].strip()
        assert t.trimmed[i] == len(trimmed) and t.label[i] == (trimmed if 0 < len(trimmed) <= 25 else None)
        assert up < i <= t.last[i] <= t.last[up]
        assert t.start[up] <= t.start[i] and t.start[i] + t.length[i] <= t.start[up] + t.length[up]
        assert t.children[up][t.sib[i]] == t.tag[i]


def test_bad_pages_are_rows(pages):
    rows = pages("<p>x", None, "").select("site", "error", F.size("nodes").alias("n")).orderBy("site").collect()
    assert [r.error for r in rows] == [None, "no_html", None]
    assert rows[0].n == 4 and rows[2].n == 3


def test_endless_nesting_is_a_tree(pages):
    deep = pages("<b>" * 100_000, "<p>fine", "<i>" * 400 + "x")
    last = F.element_at("nodes", -1)
    found = deep.select("site", "error", F.size("nodes").alias("n"), last["depth"].alias("depth"), last["parent_id"].alias("up")).orderBy("site")
    assert [tuple(r) for r in found.collect()] == [(0, None, 100_003, 100_001, 100_001), (1, None, 4, 2, 2), (2, None, 403, 401, 401)]


@pytest.mark.parametrize("n", [520, 600, 100_000])
@pytest.mark.parametrize("tag", ["b", "font", "div"])
def test_endless_nesting_keeps_every_element(n, tag):
    t = build_tree("<a href=x>before</a>" + f"<{tag}>" * n + "<form><input name=q></form>behind")
    assert len(t.tag) == n + 6 and t.tag.count(tag) == n and t.full == "beforebehind"
    form = t.tag.index("form")
    assert t.length[t.tag.index(tag)] == len("behind") and t.last[0] == len(t.tag) - 1
    assert t.depth[form] == n + 2 and t.parent[form + 1] == form


@given(st.lists(_PIECES, max_size=30).map("".join))
def test_deep_stacks_find_the_same_elements(html):
    from pagesift.operators import html as module

    want, near = build_tree(html), module.NEAR
    module.NEAR = 1
    try:
        got = build_tree(html)
    finally:
        module.NEAR = near
    assert (got.tag, got.parent, got.last, got.length) == (want.tag, want.parent, want.last, want.length)


def test_plan_does_not_depend_on_the_size_of_the_input(spark, tmp_path):
    from pagesift.operators.html import parse_pages
    from pagesift.sources.captures import SPREAD

    def shape(n):
        path = str(tmp_path / str(n))
        spark.range(n).select(F.col("id").alias("site"), F.lit("<p>x").alias("html")).write.parquet(path)
        plan = parse_pages(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
        return [re.findall("[A-Za-z]+", line)[:1] for line in plan.splitlines()]

    assert shape(1) == shape(200_000) and not any(["Exchange"] == line for line in shape(10))
    spark.conf.set(SPREAD, "3")
    try:
        assert shape(2) == shape(100_000) and any(["Exchange"] == line for line in shape(11))
    finally:
        spark.conf.unset(SPREAD)


def test_element_rows(pages):
    rows = elements(pages("<p id=x class='b a b' lang=en>hi</p>"), "site").filter("tag = 'p'").collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.id, row.classes, row.attrs["lang"], row.depth, row.parent_id) == ("x", ["b", "a"], "en", 2, 2)


HTML = """<div id=r class="list b:x"><ul><li class="c a"><a href=1>x</a><b>t</b></li><li class="c"><a>y</a></li></ul>
<p class=c>z</p></div><div><a href=2>w</a></div>"""


@pytest.mark.parametrize(
    "css, want",
    [
        ("a", "x y w"), ("li a", "x y"), ("#r a", "x y"), ("ul > li > a", "x y"), ("div > a", "w"), (".c", "xt y z"),
        ("li.c.a", "xt"), ("p, li", "xt y z"), (r"div.b\:x > p", "z"), ("div ul a, p", "x y z"), ("ol a", ""),
        ("*.a", "xt"), ("div div", ""),
    ],
)
def test_fixed_and_stored_selectors_agree(pages, css, want):
    page = pages(HTML)
    fixed = F.transform(dom.select(css), dom.text_content)
    stored = F.transform(select_by_steps(selector_steps(F.lit(css))), dom.text_content)
    row = page.select(fixed.alias("fixed"), stored.alias("stored")).first()
    assert " ".join(row.fixed) == want
    assert " ".join(row.stored) == want


def test_attribute_selectors(pages):
    page = pages(HTML)
    row = page.select(
        F.size(dom.select("a[href]")).alias("has"), F.size(dom.select("a[href='2']")).alias("eq"),
        F.size(dom.select("li a[href]")).alias("below"),
    ).first()
    assert tuple(row) == (2, 1, 1)


def test_empty_selector_matches_nothing(pages):
    page = pages(HTML).select(
        F.size(select_by_steps(selector_steps(F.lit("")))).alias("n"),
        F.size(select_by_steps(selector_steps(F.lit(None).cast("string")))).alias("z"), 
    )
    row = page.first()
    assert row.n == 0 and (row.z is None or row.z <= 0)


def test_selector_strings(pages):
    page = pages("<div class='b a:x'><p><i id=i></i></p></div>")
    got = [
        page.select(fn(dom.select_first(css)).alias("v")).first().v
        for css, fn in [
            ("div", selectors.class_selector), ("i", selectors.class_selector), ("p", selectors.class_selector),
            ("i", selectors.tag_path), ("html", selectors.tag_path), ("i", selectors.parent_tag_path),
            ("body", selectors.parent_tag_path), ("div", selectors.parent_selector), ("html", selectors.element_selector),
        ]
    ]
    assert got[:8] == [
        r"div.a\:x.b", "i#i", "p", "body > div > p > i", None, "body > div > p", None, r"div.a\:x.b",
    ]
    assert tuple(got[8]) == ("", "html")


def test_common_selector_matches_every_element(spark):
    lists = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))
    one = F.array(F.array(F.lit("z:1"), F.lit("b")))
    row = spark.range(1).select(
        selectors.common_selector(F.lit("ul#r"), F.lit("div"), selectors.shared_classes(lists)).alias("s"),
        selectors.common_selector(F.lit("p"), F.lit("a"), selectors.shared_classes(one)).alias("o"),
    ).first()
    assert row.s == "ul#r > div.b"
    assert row.o == r"p > a.b.z\:1"


def test_parse_is_narrow(spark):
    made = spark.createDataFrame([(1, "<p>x")], "site bigint, html string")
    plan = parse_pages(made)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_paths(pages):
    """Digests are equal exactly where the spelled paths are, on all pages."""
    rows = pages(HTML, "<div><ul><li><a>1</a><p>2</p></li></ul></div>", "<p>1<p>2<i><b>").select(
        "site", F.inline(F.transform(dom.nodes(), lambda e: F.struct(
            e["path_id"].alias("id"), selectors.tag_path(e).alias("path"), selectors.parent_path_id(e).alias("above"),
            selectors.parent_tag_path(e).alias("above_path"))))).collect()
    assert len({(r.id, r.path) for r in rows}) == len({r.id for r in rows}) == len({r.path for r in rows})
    known = {r.path: r.id for r in rows}
    assert all(r.above == (known[r.above_path] if r.above_path else None) for r in rows)
    assert {r.path for r in rows if r.site == 2} == {None, "head", "body", "body > p", "body > p > i", "body > p > i > b"}


def test_paths_of_many_nodes_are_spelled_once(pages):
    page = pages(HTML).select(selectors.once_per_path(dom.nodes(), selectors.tag_path).alias("a"), F.transform(dom.nodes(), selectors.tag_path).alias("b"))
    row = page.first()
    assert row.a == row.b and len(row.a) > 10


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(_PIECES, max_size=40).map("".join), min_size=30, max_size=60))
def test_page_wide_answers_equal_those_of_single_nodes(spark, pages, htmls):
    """Flags, nearest and counts over chunks of the page against a climb from every node."""
    from pagesift.functions import binding, css

    size = binding.CHUNK
    page = pages(*htmls)
    css_ = "div p a, table > tbody td, li > b, form b > b"
    try:
        binding.CHUNK = css.CHUNK = 3
        flags = page.select(
            css.page_flags(css_).alias("flags"),
            F.transform(dom.nodes(), css.matcher(css_)).alias("want_flags"),
            css.nearest(css.matcher("div, td")).alias("near"),
            F.transform(dom.nodes(), lambda e: dom.closest("div, td", e)["node_id"]).alias("want_near"),
            F.transform(dom.nodes(), lambda e: dom.any_below(css.match_counts(css.matcher("a, b")), e)).alias("any"),
            F.transform(dom.nodes(), lambda e: dom.contains("a, b", e)).alias("want_any"),
            F.transform(css.select_by_steps(css.selector_steps(F.lit(css_))), lambda e: e["node_id"]).alias("ids"),
        )
    finally:
        binding.CHUNK = css.CHUNK = size
    for r in flags.collect():
        assert r.flags == r.want_flags and r.near == r.want_near and r.any == r.want_any
        assert r.ids == [i for i, hit in enumerate(r.flags) if hit]


def test_long_and_deep_pages_take_linear_time(pages):
    import time

    wide = "<ul>" + "<li class=c><p><a href=x>1</a></p></li>" * 50_000 + "</ul>"
    deep = "<div class=c><b>" * 50_000 + "<p><a href=x>1"
    found = pages(wide, deep).cache()
    assert [r.n for r in found.select("site", F.size("nodes").alias("n")).orderBy("site").collect()] == [150_004, 100_005]
    answers = {
        "fixed": F.size(dom.select("div b a, li > p > a")),
        "stored": F.size(select_by_steps(selector_steps(F.lit(".c b a, .c a")))),
        "nearest": F.size(F.array_distinct(nearest(matcher("li, div")))),
        "path": F.length(selectors.tag_path(F.element_at(dom.nodes(), -1))),
    }
    took = {}
    for name, answer in answers.items():
        start = time.time()
        got = [r.n for r in found.select("site", answer.alias("n")).orderBy("site").collect()]
        took[name] = time.time() - start
        assert got == {"fixed": [50_000, 1], "stored": [50_000, 1], "nearest": [50_001, 50_001], "path": [len("body > ul > li > p > a"), len("body > p > a") + 50_000 * len("div > b > ")]}[name]
    found.unpersist()
    assert max(took.values()) < 30, took
