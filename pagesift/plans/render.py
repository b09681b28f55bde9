"""Web pages made from the driver tables, so that SQL over the tables can check what is read from the HTML.

Every page holds a bounded number of rows (a key range of 20), so pages grow in
number with the data, never in size.  Page text is built by Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.urls import fill_template_form, fill_template_uri
from pagesift.functions.text import normalise_string
from pagesift.sources.captures import dealt, spread
from pagesift.sources.links import link_id
from pagesift.sources.rules import NONSENSE_QUERY, PROBE_QUERIES

PARTS_PER_SITE = 20
SITES_PER_DIRECTORY = 10
CATEGORY_NAMES = ["Books", "Movies", "Games Download", "Abandonware/ROM"]
SELECTOR = "div#results > .card"

HEAD = "<!DOCTYPE html><html><head><title>t</title></head><body><nav><ul><li><a href='/home'>Home</a></li></ul></nav>"
FOOT = "<footer><p>made by <a href='/about'>us</a></p></footer></body></html>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def fmt(template: str, **values: Column) -> Column:
    """A text with ``{name}`` places filled by columns."""
    out, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [F.lit(head), values[name].cast("string")]
    return F.concat(*out, F.lit(rest))


#: Rows that a task takes where a short text is made of each of them.
TEXT_ROWS = 100_000


def parts(spark: SparkSession, sf_dir: str, for_cards: bool = False) -> DataFrame:
    """Parts with their site and place ``j`` on the site's page; dealt out where a card is made of each."""
    columns = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return (dealt(columns, TEXT_ROWS) if for_cards else columns).select(
        "p_partkey",
        "p_name",
        "p_brand",
        "p_type",
        "p_size",
        F.expr(f"p_partkey div {PARTS_PER_SITE}").alias("site"),
        F.expr(f"cast(p_partkey % {PARTS_PER_SITE} as int)").alias("j"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, first_name): every site that has a part, and the name of its first one."""
    return parts(spark, sf_dir).groupBy("site").agg(F.min_by("p_name", "j").alias("first_name"))


def site_url(site: Column) -> Column:
    return fmt("https://s{s}.example.com", s=site)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored link per site; some sites have no known response time."""
    site = F.col("site")
    names = F.array(*[F.lit(c) for c in CATEGORY_NAMES])
    return sites(spark, sf_dir).select(
        link_id(site_url(site)).alias("id"),
        fmt("Site {s}", s=site).alias("title"),
        site_url(site).alias("url"),
        F.get(names, F.expr("cast(site % 4 as int)")).alias("category"),
        (F.col("site") % 3 == 0).alias("starred"),
        F.concat(site_url(site), F.lit("/find?q={0}")).alias("search_url"),
        F.lit(SELECTOR).alias("selector"),
        F.when(site % 13 != 5, site * 37 % 500).alias("response_time"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct normalised queries: the part names."""
    names = dealt(table(spark, sf_dir, "part").select("p_name"), TEXT_ROWS)
    return names.select(normalise_string(F.col("p_name")).alias("query")).distinct()


def card() -> Column:
    """One result card; its shape depends on ``j % 5`` and ``p_size % 3``.

    0: image link and h2; 1: text link; 2: card text only; 3: a link that two
    cards share; 4: the card is itself an anchor.
    """
    v = {
        "k": F.col("p_partkey"),
        "n": F.col("p_name"),
        "t": F.col("p_type"),
        "b": F.col("p_brand"),
        "z": F.col("p_size"),
        "c": F.col("p_size") % 3,
        "slug": F.concat(F.translate(F.col("p_name"), " ", "-"), F.lit("-"), F.col("p_partkey").cast("string")),
        "shared": F.col("j") % 5 + F.floor(F.col("j") / 10) * 10,
    }
    image = (
        F.when(F.col("p_size") % 3 == 0, fmt("<img data-src='/img/{k}.png' alt='{t}'>", **v))
        .when(F.col("p_size") % 3 == 1, fmt("<img data-src=' ' src='../i/{k}.png'>", **v))
        .otherwise(F.lit(""))
    )
    opened = fmt("<div class='card c{c} s:{z}'>", **v)
    listing = fmt("<a href='/category/{b}'>more</a></div>", **v)
    link = fmt("<a href='/p/{slug}'>", **v)
    kind = F.col("j") % 5
    return (
        F.when(kind == 0, F.concat(opened, link, image, fmt("</a><h2> {n} </h2>", **v), listing))
        .when(kind == 1, F.concat(opened, image, link, fmt("Buy the {n}</a><h2>{t}</h2>", **v), listing))
        .when(kind == 2, F.concat(opened, link, image, fmt("</a><p>{t}  {n}</p>", **v), listing))
        .when(kind == 3, F.concat(opened, fmt("<a href='/shared/{shared}'>{n}</a>", **v), image, listing))
        .otherwise(fmt("<a class='card' href='/a/{k}'>{n} <span>{t}</span></a>", **v))
    )


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """captures: one search page per site, with the cards of its parts."""
    site = F.col("site")
    made = (
        parts(spark, sf_dir, for_cards=True)
        .withColumn("card", card())
        .groupBy("site")
        .agg(
            F.sort_array(F.collect_list(F.struct("j", "card"))).alias("cards"),
            F.min_by("p_name", "j").alias("first_name"),
        )
    )
    body = F.array_join(F.transform("cards", lambda c: c["card"]), "\n")
    template = F.concat(site_url(site), F.lit("/find?q={0}"))
    return made.select(
        site.alias("capture_id"),
        fill_template_uri(template, normalise_string(F.col("first_name"))).alias("url"),
        fmt(HEAD + "<div id='results'>{b}</div><div><a href='?page=2'>2</a></div>" + FOOT, b=body).alias("html"),
        (site % 50).cast("bigint").alias("elapsed_ms"),
    )


def site_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages with the columns of their link, as extraction takes them."""
    page = search_pages(spark, sf_dir).select(
        "capture_id", "html", F.regexp_extract("url", "^https://[^/]*", 0).alias("site_url")
    )
    return page.withColumn("selector", F.lit(SELECTOR))


# --- discovery -----------------------------------------------------------------

# Form markup of a home page by variant; {n} is a number from the table.
HOME_FORMS = [
    "<header><form role='search' action='/find?old=1'><input type='search' name='q'><button>Search</button></form>"
    "</header><form><input type='text' name='mail'><button>Subscribe</button></form>",
    "<header><form action='find'><input type='text' name='s' placeholder='Search items'></form></header>"
    "<footer><form><input type='search' name='query'></form></footer>",
    "<form><input type='text' name='user'><input type='password' name='p'></form>",
    "<form method='POST' action='/find'><input type='text' name='q'></form>",
    "<form><input type='text' name='a'><input type='text' name='b'></form>",
    "<form><input type='text' id='search'></form><form><input type='search' name=' '></form>",
    "<form method='GET' action='/find'><input type='search'></form>",
    "<nav><form action='/a/../find?x=1#top'><input type='text' name='search box' id='q' aria-label='Search'>"
    "<a role='button' class='btn Icon-Magnify'></a></form></nav><aside><form><input type='search' name='q'></form>"
    "</aside>",
    "<form method='get' action='https://Find.Example.org:443'><input type='text' name='k{n}'></form>",
    "<p>no form here</p>",
    "<div class='wide sidebar'><form><input type='search' name='s' data-testid='main-search'><button>Go</button>"
    "</form></div><form action='/find'><input type='text' name='q'><button class='loupe'></button></form>",
    "<footer><form action='/find'><input type='text' name='f{n}'></form></footer>",
]


def home_html(variant: Column, number: Column) -> Column:
    options = F.array(*[fmt(f, n=number) if "{n}" in f else F.lit(f) for f in HOME_FORMS])
    return fmt(HEAD + "{f}" + FOOT, f=F.get(options, variant.cast("int")))


def customer_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """captures: one home page per customer."""
    key = F.col("c_custkey")
    return dealt(table(spark, sf_dir, "customer").select("c_custkey")).select(
        key.alias("capture_id"),
        fmt("https://c{k}.example.com/shop/index", k=key).alias("url"),
        home_html(key % len(HOME_FORMS), key % 10).alias("html"),
        F.lit(5).cast("bigint").alias("elapsed_ms"),
    )


def directory_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """captures + ``page_ord``: one directory page per 10 sites, a heading and a list per category.

    Every 4th site is listed a second time in the last list; a heading with no
    list of its own comes before the first one; each list starts with entries
    that the link rules drop.
    """
    site = F.col("site")
    listed = links(spark, sf_dir).select(
        F.expr("cast(regexp_extract(url, '[0-9]+', 0) as bigint)").alias("site"), "title", "url", "starred"
    )
    entry = F.concat(
        F.when(F.col("starred"), F.lit("<li class='x starred'>")).otherwise(F.lit("<li>")),
        fmt("<b><a href='{u}'> {t}\n</a></b>", u=F.col("url"), t=F.col("title")),
        F.when(site % 7 == 1, F.lit("<ul><li><a href='https://mirror.example.com'>+5</a></ul>")).otherwise(F.lit("")),
        F.when(site % 7 == 2, F.lit("<span class='i-twemoji-globe-with-meridians'></span>")).otherwise(F.lit("")),
        F.when(site % 7 == 3, fmt(" <a href=' '>x</a> <a href='/gui/GUIDE{s}'>y</a>", s=site)).otherwise(F.lit("")),
    )
    twice = listed.select(
        F.expr(f"site div {SITES_PER_DIRECTORY}").alias("page_ord"),
        site,
        entry.alias("entry"),
        F.explode(
            F.when(site % 4 == 0, F.array(F.expr("cast(site % 3 as int)"), F.lit(3))).otherwise(
                F.array(F.expr("cast(site % 3 as int)"))
            )
        ).alias("slot"),
    )

    def entries(slot: int) -> Column:
        rows = F.filter("rows", lambda r: r["slot"] == slot)
        return F.array_join(F.transform(rows, lambda r: r["entry"]), "")

    grouped = twice.groupBy("page_ord").agg(F.sort_array(F.collect_list(F.struct("slot", "site", "entry"))).alias("rows"))
    body = (
        HEAD + "<h2 id='none'>Empty</h2><p>text</p><h2 id='c0'>A</h2><p>intro</p><ul>{l0}</ul><h2 id='c1'>B</h2>"
        "<ul>{l1}</ul><div><h3 id='c2'>C</h3><ul>{l2}</ul></div><h2 id='c3'>D</h2><ul>{l3}</ul>" + FOOT
    )
    return grouped.select(
        (F.col("page_ord") + 1_000_000_000).alias("capture_id"),
        fmt("https://dir.example.net/{g}", g=F.col("page_ord")).alias("url"),
        fmt(body, l0=entries(0), l1=entries(1), l2=entries(2), l3=entries(3)).alias("html"),
        F.lit(7).cast("bigint").alias("elapsed_ms"),
        "page_ord",
    )


DIRECTORY_CATEGORIES = [
    ("Books", "#c0"),
    ("Movies", "#c1, #c2"),
    ("Games Download", "#none, #c3"),
]


def site_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """captures: home pages of the sites, the variant by ``site % 12``."""
    site = F.col("site")
    return (
        sites(spark, sf_dir)
        .select(
            (site + 2_000_000_000).alias("capture_id"),
            site_url(site).alias("url"),
            home_html(site % len(HOME_FORMS), site % 10).alias("html"),
            F.lit(5).cast("bigint").alias("elapsed_ms"),
        )
    )


def probe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, probe_no, html, elapsed_ms): a no-result page and two result pages per site.

    Page 1 has the parts with even ``j``, page 2 the others.  Sites with
    ``site % 11 = 5`` show only pagers, with ``site % 11 = 6`` a list with
    another parent on page 2.
    """
    v = {"k": F.col("p_partkey"), "n": F.col("p_name"), "c": F.col("p_size") % 3, "t": F.col("p_type")}
    one = fmt(
        "<div class='card c{c}'><a href='/p/{k}'><img data-src='/img/{k}.png'></a><h2>{n}</h2><p>{t}</p></div>", **v
    )
    cards = (
        parts(spark, sf_dir, for_cards=True)
        .withColumn("probe_no", F.expr("1 + j % 2"))
        .groupBy("site", "probe_no")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("j"), one.alias("card")))).alias("cards"))
        .withColumn("body", F.array_join(F.transform("cards", lambda c: c["card"]), ""))
    )
    pager = "<div class='pages'><a href='?p=1'>1</a><a href='?p=2'>2</a><a href='?p=2'>Next</a></div>"
    odd = F.col("site") % 11
    body = (
        F.when(odd == 5, F.lit(pager))
        .when((odd == 6) & (F.col("probe_no") == 2), fmt("<div class='other'>{b}</div>" + pager, b=F.col("body")))
        .otherwise(fmt("<div id='results' class='grid'>{b}</div>" + pager, b=F.col("body")))
    )
    hits = cards.select("site", "probe_no", fmt(HEAD + "{b}" + FOOT, b=body).alias("html"))
    none = (
        sites(spark, sf_dir)
        .select("site", F.lit(0).alias("probe_no"), F.lit(HEAD + "<p class='none'>nothing found</p>" + FOOT).alias("html"))
    )
    both = hits.unionByName(none)
    return both.select(
        "site", "probe_no", "html", F.expr("cast((site * 7 + probe_no * 3) % 50 + 10 as bigint)").alias("elapsed_ms")
    )


def probe_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """captures: the probe pages under the URLs that discovery asks for.

    Variant 8 homes point to another host, which was not captured.
    """
    site, variant = F.col("site"), F.expr(f"cast(site % {len(HOME_FORMS)} as int)")
    path = (
        F.when(variant.isin(0, 10), F.lit("/find?q={0}"))
        .when(variant == 1, F.lit("/find?s={0}"))
        .when(variant == 7, F.lit("/find?search%20box={0}#top"))
        .when(variant == 11, F.concat(F.lit("/find?f"), (site % 10).cast("string"), F.lit("={0}")))
    )
    books = [NONSENSE_QUERY, *PROBE_QUERIES["Books"]]
    movies = [NONSENSE_QUERY, *PROBE_QUERIES["Movies"]]
    terms = F.when(site % 3 == 0, F.array(*[F.lit(t) for t in books])).otherwise(F.array(*[F.lit(t) for t in movies]))
    url = fill_template_form(F.concat(site_url(site), path), F.get(terms, F.col("probe_no")))
    return (
        probe_pages(spark, sf_dir)
        .select((site * 3 + F.col("probe_no") + 3_000_000_000).alias("capture_id"), url.alias("url"), "html", "elapsed_ms")
        .filter("url is not null")
    )
