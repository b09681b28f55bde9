"""Search pages -> result candidates (one per card), before any query text is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions import dom
from pagesift.functions.binding import computed, let
from pagesift.functions.css import select_by_steps, selector_steps
from pagesift.functions.text import is_blank
from pagesift.functions.urls import abs_url, is_result_href, url_escape, url_slug
from pagesift.operators.skew import spread_join
from pagesift.sources.captures import latest
from pagesift.sources.scratch import cut

IMAGE_ATTRIBUTES = ["data-src", "src", "data-original", "data-image"]  # fixed values, in order of preference


# Characters that URI escaping never leaves in a query text.
_RESERVED = r":/?#\[\]@!$&'()*+,;="


# Scheme, host and the character behind them.
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[/?#]"


def _heads(url: Column, least: Column) -> Column:
    """The beginnings of the URL, of ``least`` characters or more, that end in a reserved character."""
    reserved = F.lit(_RESERVED.replace("\\", ""))
    ends = F.transform(
        F.split(url, ""), lambda c, i: F.when((i + 1 >= least) & (F.instr(reserved, c) > 0), i + 1).otherwise(F.lit(0))
    )
    return F.transform(F.array_remove(ends, 0), lambda n: F.left(url, n))


def template_captures(captures: DataFrame, links: DataFrame) -> DataFrame:
    """Which link template and which encoded query each capture URL is.

    ``capture_id, link columns, query_key``.  The fan-out of queries over links
    is read backwards from the captured URLs, so no query x link product is
    ever formed.  An encoded query holds no reserved character, so the template
    up to its last reserved character before ``{0}`` is one of the capture
    URL's own heads: an equi-join on that, checked against the whole prefix and
    suffix, leaves the encoded query in the middle.

    Heads begin with scheme and host, so captures of different hosts share none
    and a key holds the pages of one host at most.  A template whose query stands
    in the host name has a shorter head; heads that short are formed only if such
    templates exist, and only those that they have.
    """
    at = F.locate("{0}", "search_url")
    prefix = F.col("search_url").substr(F.lit(1), at - 1)
    templates = links.filter(F.contains("search_url", F.lit("{0}"))).select(
        *links.columns,
        F.regexp_extract(prefix, f"^(?s:.*)[{_RESERVED}]", 0).alias("_head"),
        prefix.alias("_prefix"),
        F.col("search_url").substr(at + 3, F.length("search_url")).alias("_suffix"),
    )
    templates = templates.withColumn("_in_host", ~F.col("_head").rlike(_AUTHORITY))
    # Of the captures of one URL the latest counts.
    urls = cut(latest(captures).select("capture_id", F.col("url").alias("capture_url")))
    authority = F.length(F.regexp_extract("capture_url", _AUTHORITY, 0))
    pages = urls.select("*", F.explode(_heads(F.col("capture_url"), authority)).alias("_head"))
    short = templates.filter("_in_host").select("_head").distinct()
    if not short.isEmpty():
        heads = F.filter(_heads(F.col("capture_url"), F.lit(1)), lambda h: F.length(h) < authority)
        early = urls.select("*", F.explode(heads).alias("_head")).join(short, "_head", "left_semi")
        pages = pages.unionByName(early)
    templates = templates.drop("_in_host")
    middle = F.col("capture_url").substr(
        F.length("_prefix") + 1, F.length("capture_url") - F.length("_prefix") - F.length("_suffix")
    )
    fits = (
        F.startswith("capture_url", "_prefix")
        & F.endswith("capture_url", "_suffix")
        & (F.length("capture_url") >= F.length("_prefix") + F.length("_suffix"))
        & ~middle.rlike(f"[{_RESERVED}]")
    )
    # All captures of a large host share its shortest head, whether a template has it or not.
    found = spread_join(pages, templates, ["_head"]).filter(fits)
    return found.select("capture_id", *links.columns, middle.alias("query_key"))


def search_fanout(queries: DataFrame, links: DataFrame, captures: DataFrame) -> DataFrame:
    """(capture, link, query): every stored link for every query that has a captured page.

    ``queries`` holds distinct normalised ``query`` texts.  A link without a
    capture of the query is a site that failed: no row.
    """
    keyed = queries.select("query", url_escape(F.col("query")).alias("query_key"))
    return template_captures(captures, links).join(keyed, "query_key").drop("query_key")


def with_cards(pages: DataFrame, selector: str = "selector") -> DataFrame:
    """Adds ``cards``: the nodes matching each site's own selector."""
    steps = pages.select("*", computed(selector_steps(F.col(selector)).alias("_steps")))
    return steps.select("*", computed(select_by_steps(F.col("_steps")).alias("cards"))).drop("_steps")


def _card_hrefs(card: Column, count_self_href: bool) -> Column:
    below = F.transform(dom.select("a[href]", card), lambda a: dom.attr(a, "href"))
    if count_self_href:
        own = F.when((card["tag"] == "a") & dom.has_attr(card, "href"), F.array(dom.attr(card, "href")))
        below = F.concat(below, F.coalesce(own, F.array().cast("array<string>")))
    return F.array_distinct(below)


def with_href_cards(pages: DataFrame, count_self_href: bool = True) -> DataFrame:
    """Adds ``card_hrefs``: sorted hrefs of the page, once per card that holds them.

    ``count_self_href`` also counts the href of a card that is itself an
    anchor; without it such a card can never give a result.
    """
    per_card = F.transform("cards", lambda c: _card_hrefs(c, count_self_href))
    return pages.select("*", computed(F.sort_array(F.flatten(per_card)).alias("card_hrefs")))


def with_unique_hrefs(pages: DataFrame) -> DataFrame:
    """Adds ``unique_hrefs``: hrefs found in exactly one card (no equal neighbour in sorted order)."""

    def alone(href: Column, i: Column) -> Column:
        before = F.coalesce(F.get("card_hrefs", i - 1) == href, F.lit(False))
        after = F.coalesce(F.get("card_hrefs", i + 1) == href, F.lit(False))
        return ~before & ~after

    return pages.select("*", computed(F.filter("card_hrefs", alone).alias("unique_hrefs")))


def href_card_count(pages: DataFrame, *keys: str) -> DataFrame:
    """Number of distinct cards holding each href, per page."""
    return pages.select(*keys, F.explode("card_hrefs").alias("href")).groupBy(*keys, "href").agg(
        F.count("*").alias("n_cards")
    )


def _first_text(css: str, card: Column) -> Column:
    """Text of the first match, null when there is none or it is blank."""
    text = let(dom.select_first(css, card), dom.text_content)
    return let(text, lambda t: F.when(~is_blank(t), t))


def _title(card: Column, href: Column) -> Column:
    """First same-href anchor with text; else the first h1, h2 or h3 with text; else the card text."""
    texts = F.transform(
        F.filter(dom.select("a[href]", card), lambda a: dom.attr(a, "href") == href), dom.text_content
    )
    anchor = F.get(F.filter(texts, lambda t: ~is_blank(t)), 0)
    return F.coalesce(
        anchor, _first_text("h1", card), _first_text("h2", card), _first_text("h3", card), dom.text_content(card)
    )


def _image(card: Column) -> Column:
    """struct(image, alt) of the first ``img``: the first non-blank source attribute, not yet resolved."""

    def source(img: Column) -> Column:
        values = [F.when(~is_blank(dom.attr(img, a)), dom.attr(img, a)) for a in IMAGE_ATTRIBUTES]
        return F.struct(F.coalesce(*values).alias("image"), dom.attr(img, "alt").alias("alt"))

    return let(dom.select_first("img", card), source)


def _candidate(card: Column, i: Column, listing_words: list[str]) -> Column:
    is_anchor = card["tag"] == "a"
    unique = F.col("unique_hrefs")
    inside = F.filter(
        dom.select("a[href]", card),
        lambda a: is_result_href(dom.attr(a, "href"), listing_words)
        & F.array_contains(unique, dom.attr(a, "href")),
    )
    own = F.when(F.array_contains(unique, dom.attr(card, "href")), dom.attr(card, "href"))
    href = F.when(is_anchor, own).otherwise(dom.attr(F.get(inside, 0), "href"))

    def build(h: Column) -> Column:
        image = _image(card)
        return F.struct(
            i.alias("card_ord"),
            card["node_id"].alias("card_id"),
            is_anchor.alias("is_anchor_card"),
            h.alias("href"),
            F.when(is_anchor, dom.text_content(card)).otherwise(_title(card, h)).alias("raw_title"),
            image["image"].alias("image"),
            image["alt"].alias("alt_text"),
        )

    return let(href, lambda h: F.when(h.isNotNull(), build(h)))


def card_candidates(pages: DataFrame, listing_words: list[str], *keys: str) -> DataFrame:
    """One row per card with a usable link; needs ``cards`` and ``unique_hrefs``."""
    built = F.transform("cards", lambda c, i: _candidate(c, i, listing_words))
    return pages.select(*keys, F.inline(F.filter(built, lambda c: c.isNotNull())))


def resolve(candidates: DataFrame, site_url: str = "url") -> DataFrame:
    """Adds ``result_url``, ``slug`` and ``image_url``; a link that does not resolve drops its card.

    Links and images resolve on the site URL, not on the result page.
    """
    base = F.col(site_url)
    urls = computed(
        abs_url(base, F.col("href")).alias("result_url"), abs_url(base, F.col("image")).alias("image_url")
    )
    resolved = candidates.select("*", urls).filter(F.col("result_url").isNotNull())
    return resolved.withColumn("slug", url_slug(F.col("result_url")))


def extract(
    pages: DataFrame,
    listing_words: list[str],
    *keys: str,
    site_url: str = "url",
    selector: str = "selector",
    count_self_href: bool = True,
) -> DataFrame:
    """Parsed search pages with their link columns -> resolved candidates. Page-local, no shuffle."""
    ready = with_unique_hrefs(with_href_cards(with_cards(pages, selector), count_self_href))
    return resolve(card_candidates(ready, listing_words, *keys), site_url)
