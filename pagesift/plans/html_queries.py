"""Registered queries: HTML as a table, selectors, text and URL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions import dom, selectors, text, urls
from pagesift.operators.directory import has_skip_word, is_numeric_text
from pagesift.operators.html import elements, parse_pages
from pagesift.plans import render
from pagesift.plans.registry import NAV, PARTS, normal, query, title_case
from pagesift.sources.captures import read_captures
from pagesift.sources.rules import LINK_SKIP_WORDS, LISTING_WORDS


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_captures(spark, f"{sf_dir}/pages.parquet", "page_id", None)


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(page_captures(spark, sf_dir).withColumnRenamed("capture_id", "page_id"))


def parsed_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(render.site_search_pages(spark, sf_dir).withColumnRenamed("capture_id", "site"))


def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, ord, href, text) of the navigation list of every page."""
    links = F.transform(
        dom.select("nav li a"),
        lambda a, i: F.struct(
            i.alias("ord"),
            a["node_id"].alias("node_id"),
            dom.attr(a, "href").alias("href"),
            dom.text_content(a).alias("text"),
        ),
    )
    return parsed_pages(spark, sf_dir).select("page_id", "url", F.inline(links))


@query(
    "html_elements",
    """select page_id, tag, count(*) as n from (
         select page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) as tag from pages)
       group by all""",
)
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(parsed_pages(spark, sf_dir), "page_id").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("css_select", f"with {NAV} select page_id, ord, href, text from nav")
def css_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav_links(spark, sf_dir).select("page_id", "ord", "href", "text")


@query(
    "closest",
    f"""with {PARTS}
    select site, case when p_size % 3 = 0 then '/img/' else '../i/' end || p_partkey || '.png' as src,
           'card c' || p_size % 3 || ' s:' || p_size as card_class, kind in (0, 2) as in_link
    from p where kind < 4 and p_size % 3 < 2""",
)
def closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(
        dom.select("img"),
        lambda e: F.struct(
            F.coalesce(dom.attr(e, "src"), dom.attr(e, "data-src")).alias("src"),
            dom.attr(dom.closest("div.card", e), "class").alias("card_class"),
            dom.has_closest("a", e).alias("in_link"),
        ),
    )
    return parsed_search_pages(spark, sf_dir).select("site", F.inline(found))


@query(
    "next_sibling",
    """with s as (select p_partkey // 20 as site from part where p_partkey % 20 = 0),
    e as (select site // 10 as page_ord, site % 3 as slot from s union all
          select site // 10, 3 from s where site % 4 = 0),
    h as (select * from (values ('none', 0), ('c0', 0), ('c1', 1), ('c2', 2), ('c3', 3)) as t(heading, slot))
    select g.page_ord, h.heading, count(e.slot) as n_items
    from (select distinct site // 10 as page_ord from s) g cross join h
    left join e on e.page_ord = g.page_ord and e.slot = h.slot group by all""",
)
def next_sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(
        dom.select("h2, h3"),
        lambda h: F.struct(
            h["id"].alias("heading"),
            F.size(dom.next_sibling("ul", h)["child_tags"]).cast("bigint").alias("n_items"),
        ),
    )
    return parse_pages(render.directory_pages(spark, sf_dir)).select("page_ord", F.inline(found))


@query(
    "text_content",
    r"""select page_id, regexp_replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&quot;', '"'),
          '&amp;?', '&', 'g') as heading from pages""",
)
def text_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = parsed_pages(spark, sf_dir).withColumn("h1", dom.select_first("h1"))
    return pages.select("page_id", dom.text_content(F.col("h1")).alias("heading"))


@query(
    "attr_tests",
    """select page_id, regexp_extract(html, '<html lang="([^"]*)">', 1) as lang,
         len(regexp_extract_all(html, '<div class="ad">')) as n_ads, contains(html, '<meta charset=') as has_charset
       from pages""",
)
def attr_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_pages(spark, sf_dir).select(
        "page_id",
        dom.attr(dom.node(F.lit(0)), "lang").alias("lang"),
        F.size(F.filter(dom.nodes(), lambda e: dom.has_class(e, "ad"))).cast("bigint").alias("n_ads"),
        F.exists(dom.nodes(), lambda e: (e["tag"] == "meta") & dom.has_attr(e, "charset")).alias("has_charset"),
    )


@query(
    "tag_path",
    f"""with {PARTS}
    select site, case when kind in (0, 2) then 'body > div > div > a > img' else 'body > div > div > img' end as path,
           count(*) as n from p where kind < 4 and p_size % 3 < 2 group by all
    union all select site, null, 1 from p where j = 0""",
)
def tag_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = selectors.once_per_path(dom.select("img, html"), selectors.tag_path)
    return (
        parsed_search_pages(spark, sf_dir)
        .select("site", F.explode(paths).alias("path"))
        .groupBy("site", "path")
        .agg(F.count("*").alias("n"))
    )


@query(
    "class_selector",
    f"""with {PARTS}
    select site, case when kind = 4 then 'a.card'
                      else 'div.c' || p_size % 3 || '.card.s\\:' || p_size end as selector, count(*) as n
    from p group by all union all select site, 'div#results', 1 from p where j = 0""",
)
def class_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(dom.select(".card, #results"), selectors.class_selector)
    return (
        parsed_search_pages(spark, sf_dir)
        .select("site", F.explode(found).alias("selector"))
        .groupBy("site", "selector")
        .agg(F.count("*").alias("n"))
    )


@query(
    "parent_selector",
    f"""with {PARTS}
    select site, 'div#results' as selector, 20 as n from p where j = 0
    union all select site, 'div', 1 from p where j = 0
    union all select site, 'div.c' || p_size % 3 || '.card.s\\:' || p_size, sum(case when kind in (1, 2)
      then 3 when kind = 0 then 3 else 2 end + case when kind in (1, 3) and p_size % 3 < 2 then 1 else 0 end)::bigint
    from p where kind < 4 group by all""",
)
def parent_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.filter(dom.nodes(), lambda e: dom.node(e["parent_id"])["tag"] == "div")
    found = F.transform(inside, lambda e: selectors.parent_selector(dom.node(e["parent_id"])))
    return (
        parsed_search_pages(spark, sf_dir)
        .select("site", F.explode(found).alias("selector"))
        .groupBy("site", "selector")
        .agg(F.count("*").alias("n"))
    )


@query(
    "element_selector",
    f"""with {PARTS}
    select site, case when kind in (0, 2) then 'a' else 'div.c' || p_size % 3 || '.card.s\\:' || p_size end as parent,
           'img' as element, count(*) as n
    from p where kind < 4 and p_size % 3 < 2 group by all
    union all select site, '', 'html', 1 from p where j = 0""",
)
def element_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(dom.select("img, html"), selectors.element_selector)
    return (
        parsed_search_pages(spark, sf_dir)
        .select("site", F.inline(found))
        .groupBy("site", "parent", "element")
        .agg(F.count("*").alias("n"))
    )


@query(
    "css_escape",
    r"""select p_partkey, regexp_replace(p_brand || ' ' || p_type || ':' || p_name, '([^a-zA-Z0-9_-])', '\\\1', 'g')
        as escaped from part""",
)
def css_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_brand", F.lit(" "), "p_type", F.lit(":"), "p_name")
    return render.table(spark, sf_dir, "part").select("p_partkey", text.css_escape(name).alias("escaped"))


@query(
    "common_selector",
    f"""with {PARTS}
    select site, 'div#results > div' || case when count(distinct p_size % 3) = 1 then '.c' || min(p_size % 3) else '' end
      || '.card' || case when count(distinct p_size) = 1 then '.s\\:' || min(p_size) else '' end as selector
    from p where kind < 4 group by site""",
)
def common_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = F.col("found")
    return (
        parsed_search_pages(spark, sf_dir)
        .withColumn("found", dom.select("div.card"))
        .select(
            "site",
            selectors.common_selector(
                selectors.parent_selector(dom.node(F.get(cards, 0)["parent_id"])),
                F.get(cards, 0)["tag"],
                selectors.shared_classes(F.transform(cards, lambda e: e["classes"])),
            ).alias("selector"),
        )
    )


@query(
    "child_signature",
    f"""with {PARTS}
    select site, case kind when 0 then 'AH2A' when 1 then case when p_size % 3 < 2 then 'IMGAH2A' else 'AH2A' end
                 when 2 then 'APA' when 3 then case when p_size % 3 < 2 then 'AIMGA' else 'AA' end
                 else 'SPAN' end as signature, count(*) as n
    from p group by all""",
)
def child_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(dom.select(".card"), selectors.child_signature)
    return (
        parsed_search_pages(spark, sf_dir)
        .select("site", F.explode(found).alias("signature"))
        .groupBy("site", "signature")
        .agg(F.count("*").alias("n"))
    )


# --- text and URL functions over whole tables -------------------------------------


@query("normalise_string", f"select doc_id, {normal('text')} as normalised from documents")
def normalise_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.documents(spark, sf_dir).select(
        "doc_id", text.normalise_string(F.col("text")).alias("normalised")
    )


@query("clean_title", f"select doc_id, {title_case('text')} as cleaned from documents")
def clean_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.documents(spark, sf_dir).select(
        "doc_id", text.clean_title(F.col("text")).alias("cleaned")
    )


@query(
    "fill_template_uri",
    """select p_partkey, 'https://x.org/find?q=' || url_encode(p_name || ' & ' || p_brand || '~*') as filled from part""",
)
def fill_template_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat("p_name", F.lit(" & "), "p_brand", F.lit("~*"))
    filled = urls.fill_template_uri(F.lit("https://x.org/find?q={0}"), q)
    return render.table(spark, sf_dir, "part").select("p_partkey", filled.alias("filled"))


@query(
    "fill_template_form",
    """select p_partkey, 'https://x.org/find?q=' || replace(replace(replace(replace(
         url_encode(p_name || ' (' || p_brand || ')*'), '%20', '+'), '%28', '('), '%29', ')'), '%2A', '*') as filled
       from part""",
)
def fill_template_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")*"))
    filled = urls.fill_template_form(F.lit("https://x.org/find?q={0}"), q)
    return render.table(spark, sf_dir, "part").select("p_partkey", filled.alias("filled"))


@query(
    "url_slug",
    r"""select page_id, replace(replace(regexp_extract(rtrim(split_part(split_part(url, '#', 1), '?', 1), '/'),
          '^https?://[^/]*.*?([^/]*)$', 1), '-', ' '), '_', ' ') as slug from pages""",
)
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.table(spark, sf_dir, "pages").select("page_id", urls.url_slug(F.col("url")).alias("slug"))


@query(
    "abs_url",
    f"""with {NAV} select n.page_id, ord, regexp_extract(url, '^https?://[^/]*', 0) || '/'
         || replace(url_encode(href[2:]), '%2C', ',') as resolved
       from nav n join pages using (page_id)""",
)
def abs_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = urls.abs_url(F.col("url"), F.col("href"))
    return nav_links(spark, sf_dir).select("page_id", "ord", resolved.alias("resolved"))


@query(
    "category_href",
    r"""with u as (select page_id, url as href, list_filter(string_split(url, '/'), lambda s: s <> '') as segs
                  from pages union all
                  select p_partkey + 1000000000, href, list_filter(string_split(href, '/'), lambda s: s <> '') from (
                    select p_partkey, case p_partkey % 4 when 0 then '/Tags/' || p_name when 1 then '/x/' || p_name || '/'
                      when 2 then 'https://vintage.com/' || p_name else '/genre' end as href from part))
       select page_id, len(segs) < 2 or not regexp_matches(lower(segs[-2]), 'category|categories|tag|genre') as is_result from u""",
)
def category_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("/Tags/"), "p_name"))
    made = made.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("/x/"), "p_name", F.lit("/")))
    made = made.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("https://vintage.com/"), "p_name"))
    hrefs = (
        render.table(spark, sf_dir, "pages")
        .select("page_id", F.col("url").alias("href"))
        .unionByName(
            render.table(spark, sf_dir, "part").select(
                (F.col("p_partkey") + 1_000_000_000).alias("page_id"), made.otherwise(F.lit("/genre")).alias("href")
            )
        )
    )
    return hrefs.select("page_id", urls.is_result_href(F.col("href"), LISTING_WORDS).alias("is_result"))


@query(
    "pagination_text",
    """select p_partkey, p_partkey % 6 in (0, 1, 3, 5) as is_pager from part""",
)
def pagination_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    label = (
        F.when(k == 0, F.col("p_size").cast("string"))
        .when(k == 1, F.lit(" Next Page"))
        .when(k == 2, F.col("p_name"))
        .when(k == 3, F.lit("»\n"))
        .when(k == 4, F.concat("p_size", F.lit(".5")))
        .otherwise(F.concat(F.lit("+"), "p_size"))
    )
    return render.table(spark, sf_dir, "part").select("p_partkey", text.is_pager_text(label).alias("is_pager"))


@query(
    "complexity",
    """select doc_id, (5 * (doc_id % 7) + least(length(trim(text, e' \\n\\t')), 500) // 5)::int as complexity
       from documents""",
)
def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.documents(spark, sf_dir).select(
        "doc_id", text.complexity(F.col("doc_id") % 7, F.col("text")).alias("complexity")
    )


@query(
    "link_numeric",
    f"""with {NAV} select page_id, ord, false as is_numeric from nav
        union all select p_partkey + 1000000000, 0, p_partkey % 3 < 2 from part""",
)
def link_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = nav_links(spark, sf_dir).select("page_id", "ord", "text")
    k = F.col("p_partkey") % 3
    made = (
        F.when(k == 0, F.concat(F.lit(" "), "p_size"))
        .when(k == 1, F.concat(F.lit("-"), "p_size"))
        .otherwise(F.concat("p_size", F.lit("00000000000")))
    )
    parts = render.table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1_000_000_000).alias("page_id"), F.lit(0).alias("ord"), made.alias("text")
    )
    both = nav.unionByName(parts)
    return both.select("page_id", "ord", is_numeric_text(F.col("text")).alias("is_numeric"))


_SKIP = "|".join(w.lower().replace(".", "[.]") for w in dict.fromkeys(LINK_SKIP_WORDS))


@query(
    "link_skip_words",
    f"""select page_id, ord, regexp_matches(lower(href), '{_SKIP}') or regexp_matches(lower(text), '{_SKIP}') as skipped
        from (with {NAV} select page_id, ord, href, text from nav)
        union all select doc_id + 1000000000, 0, regexp_matches(lower(text), '{_SKIP}') from documents""",
)
def link_skip_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = nav_links(spark, sf_dir).select("page_id", "ord", "href", "text")
    docs = render.documents(spark, sf_dir).select(
        (F.col("doc_id") + 1_000_000_000).alias("page_id"), F.lit(0).alias("ord"), F.lit("").alias("href"), "text"
    )
    both = nav.unionByName(docs)
    skipped = has_skip_word(F.col("href"), F.col("text"), LINK_SKIP_WORDS)
    return both.select("page_id", "ord", skipped.alias("skipped"))


@query(
    "link_blank_href",
    f"""with {PARTS} select p_partkey, p_size % 3 = 2 as is_blank from p""",
)
def link_blank_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = (
        F.when(F.col("p_size") % 3 == 0, F.col("p_name"))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit(" "), "p_brand"))
        .when(F.col("p_partkey") % 2 == 0, F.lit("  \n"))
    )
    return render.table(spark, sf_dir, "part").select("p_partkey", text.is_blank(made).alias("is_blank"))

