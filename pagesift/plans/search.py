"""Search: queries x links, read from captured pages, scored and ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.text import normalise_string
from pagesift.functions.urls import url_escape
from pagesift.operators import extract, ranking
from pagesift.operators.html import parse_pages
from pagesift.sources.rules import LISTING_WORDS

_LINK = ["url", "website_title", "category", "website_starred", "search_url", "selector"]


def _link_columns(links: DataFrame, *more: str) -> DataFrame:
    return links.select(
        "url",
        F.col("title").alias("website_title"),
        "category",
        F.col("starred").alias("website_starred"),
        "search_url",
        "selector",
        *more,
    )


def normalised(queries: DataFrame, q: str = "q") -> DataFrame:
    """Distinct normalised query texts."""
    return queries.select(normalise_string(F.col(q)).alias("query")).distinct()


def search(
    queries: DataFrame,
    links: DataFrame,
    captures: DataFrame,
    listing_words: list[str] = LISTING_WORDS,
    count_self_href: bool = True,
) -> DataFrame:
    """Scored results of distinct normalised ``queries(query)``, with ``link_ord`` and ``card_ord``.

    The fan-out works on capture ids and URLs only; page bodies join in by
    capture id, so a query captured on every site is spread over all tasks.
    ``links`` carry ``link_ord`` (see ``dispatch_order``).
    """
    wanted = extract.search_fanout(queries, _link_columns(links, "link_ord"), captures)
    pages = parse_pages(captures.select("capture_id", "html").join(wanted, "capture_id"))
    keys = ["query", "link_ord", *_LINK]
    found = extract.extract(pages, listing_words, *keys, count_self_href=count_self_href)
    return ranking.result_rows(ranking.title_or_slug(found), "query", "link_ord", "card_ord")


def search_candidates(
    links: DataFrame,
    captures: DataFrame,
    listing_words: list[str] = LISTING_WORDS,
    count_self_href: bool = True,
) -> DataFrame:
    """All candidates of all captured search pages, keyed by ``query_key``: the static side of a stream."""
    pages = extract.template_captures(captures, _link_columns(links, "link_ord"))
    parsed = parse_pages(captures.select("capture_id", "html").join(pages, "capture_id"))
    keys = ["query_key", "link_ord", *_LINK]
    return extract.extract(parsed, listing_words, *keys, count_self_href=count_self_href)


def search_from_candidates(queries: DataFrame, candidates: DataFrame, *keys: str) -> DataFrame:
    """Scored results for ``queries`` (batch or stream, normalised ``query``) from prepared candidates."""
    keyed = queries.withColumn("query_key", url_escape(F.col("query")))
    return ranking.result_rows(
        ranking.title_or_slug(keyed.join(candidates, "query_key")), *keys, "query", "link_ord", "card_ord"
    )


def scored_candidates(candidates: DataFrame) -> DataFrame:
    """Scored results of all captured search pages, by ``query``: a captured URL holds one query, so no query log is needed.

    Escaping is undone; a key that is no escaped query text has no asker.
    """
    asked = candidates.select(F.try_url_decode("query_key").alias("query"), "query_key").distinct()
    known = asked.filter(F.col("query").isNotNull() & (url_escape(F.col("query")) == F.col("query_key")))
    return search_from_candidates(known.select("query"), candidates)


def attach_results(queries: DataFrame, scored: DataFrame, *keys: str) -> DataFrame:
    """Results for ``queries`` (batch or stream, normalised ``query``) from ``scored_candidates``."""
    return ranking.result_rows(queries.join(scored, "query"), *keys, "query", "link_ord", "card_ord")
