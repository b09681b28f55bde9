"""Directory pages -> website links.

``pages`` are parsed directory pages with a ``page_ord``.  Everything up to the
filtered links is page-local; the only shuffle is the one by URL that keeps the
first link of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions import dom
from pagesift.functions.binding import let
from pagesift.functions.css import match_counts, matcher, nearest, page_flags
from pagesift.functions.text import has_any_word, is_blank, is_int32, trim_ws
from pagesift.sources.captures import fetch
from pagesift.sources.rules import GLOBE_CLASS, Rules


def _headers(categories: list[tuple[str, str]]) -> Column:
    """Heading nodes of every category, in category order then document order."""

    def of(k: int, name: str, css: str) -> Column:
        return F.transform(
            dom.select(css),
            lambda h: F.struct(F.lit(k).alias("category_ord"), F.lit(name).alias("category"), h.alias("header")),
        )

    per_category = [of(k, name, css) for k, (name, css) in enumerate(categories)]
    return F.flatten(F.array(*per_category))


def category_headers(pages: DataFrame, rules: Rules, *keys: str) -> DataFrame:
    """One row per (category, heading element)."""
    found = pages.select(*keys, F.inline(_headers(rules.categories)))
    return found.select(
        *keys,
        "category_ord",
        "category",
        F.col("header.node_id").alias("header_id"),
        F.col("header.id").alias("element_id"),
    )


def _header_links(h: Column, links: Column, items: Column, globes: Column) -> Column:
    """``li a`` links of the first list after one heading, with what the link rules look at.

    ``links`` flags the links of the page, ``items`` has the list item around each node, ``globes`` counts globes.
    """

    def link(a: Column) -> Column:
        li = dom.node(F.get(items, a["node_id"]))
        return F.struct(
            h["category_ord"].alias("category_ord"),
            h["category"].alias("category"),
            h["header"]["node_id"].alias("header_id"),
            a["node_id"].alias("node_id"),
            dom.attr(a, "href").alias("href"),
            dom.text_content(a).alias("text"),
            dom.has_class(li, "starred").alias("starred"),
            dom.any_below(globes, li).alias("has_globe"),
        )

    listing = dom.next_sibling("ul", h["header"])
    return F.transform(dom.flagged(links, listing), link)


def header_list_links(pages: DataFrame, rules: Rules, *keys: str) -> DataFrame:
    """Candidate links: one row per link in the list that follows a category heading."""

    def found(links: Column, items: Column, globes: Column) -> Column:
        per_header = F.transform(_headers(rules.categories), lambda h: _header_links(h, links, items, globes))
        return F.flatten(F.filter(per_header, lambda some: some.isNotNull()))

    # What is asked of every link is worked out for the whole page at once.
    facts = let(page_flags("li a"), lambda a: let(nearest(matcher("li")), lambda b: let(match_counts(matcher("." + GLOBE_CLASS)), lambda c: found(a, b, c))))
    return pages.select(*keys, F.inline(facts))


def is_numeric_text(text: Column) -> Column:
    return is_int32(trim_ws(text))


def has_skip_word(href: Column, text: Column, words: list[str]) -> Column:
    return has_any_word(href, words) | has_any_word(text, words)


def website_links(pages: DataFrame, rules: Rules, *keys: str) -> DataFrame:
    """Filtered links: title, url as written, category, starred, plus the ordinals."""
    links = header_list_links(pages, rules, *keys)
    keep = (
        ~F.col("has_globe")
        & ~is_numeric_text(F.col("text"))
        & ~is_blank(F.col("href"))
        & ~has_skip_word(F.col("href"), F.col("text"), rules.link_skip_words)
    )
    return links.filter(keep).select(
        *keys,
        "category_ord",
        "header_id",
        "node_id",
        trim_ws(F.col("text")).alias("title"),
        F.col("href").alias("url"),
        "category",
        "starred",
    )


def directory_captures(captures: DataFrame, directory: DataFrame) -> DataFrame:
    """Captures of the directory pages ``directory(url, page_ord)``; others are never parsed."""
    return fetch(directory, captures)


def first_by_url(links: DataFrame) -> DataFrame:
    """The first link of each exact URL by (page, category, heading, link).

    An aggregate, not a window: it combines on the map side, so a URL listed on
    a third of all pages costs its reducer one row per map task.
    """
    order = F.struct("page_ord", "category_ord", "header_id", "node_id")
    first = F.min_by(F.struct("title", "category", "starred", order.alias("at")), order)
    return links.groupBy("url").agg(first.alias("first")).select("url", "first.*", "first.at.*").drop("at")
