"""Discovery: directory pages -> sites -> search forms -> card selectors -> links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.operators import cards, directory, forms
from pagesift.operators.html import parse_pages
from pagesift.sources.captures import fetch, locate
from pagesift.sources.links import LINK_COLUMNS, link_id
from pagesift.sources.rules import Rules
from pagesift.sources.scratch import cut


def directory_union(captures: DataFrame, pages: DataFrame, rules: Rules) -> DataFrame:
    """Website links of all directory pages ``pages(url, page_ord)``, with their ordinals."""
    wanted = directory.directory_captures(captures, pages)
    return directory.website_links(parse_pages(wanted), rules, "page_ord")


def discovery_report(captures: DataFrame, pages: DataFrame, rules: Rules) -> DataFrame:
    """Every website link with what was found for it, or the stage and reason it stopped at.

    A URL may have been captured several times; its latest capture counts.  The
    pages of one stage are known only from the one before it, so there are three
    joins of wanted URLs to captures.  Each matches URLs on narrow columns and
    takes bodies by capture id; it is an inner join, so that a short list can be
    broadcast and the captures are filtered where they are scanned.  What was not
    captured shows up as a missing row afterwards.  Between stages the site list -
    one short row per site - is checkpointed.
    """
    sites = cut(
        directory.first_by_url(directory_union(captures, pages, rules)).select(
            "url", "title", "category", "starred"
        )
    )
    homes = parse_pages(fetch(sites.select("url"), captures))
    found = forms.search_links(homes, "url").withColumnRenamed("reject_reason", "form_reason")
    linked = cut(sites.join(found, "url", "left"))

    wanted = cards.probe_urls(linked.filter("search_url is not null"), rules).select(
        "url", "probe_no", "probe_url"
    )
    located = cut(locate(wanted, captures, "probe_url"))
    probes = parse_pages(located.join(captures.select("capture_id", "html"), "capture_id"))
    selectors = cards.find_card_selectors(probes, "url").withColumnRenamed("reject_reason", "card_reason")
    return assembled(linked, probe_times(located, captures), selectors)


def probe_times(located: DataFrame, captures: DataFrame) -> DataFrame:
    """``url, n_captured, response_time`` of the probe pages found, ``located(url, capture_id)``."""
    return (
        located.join(captures.select("capture_id", "elapsed_ms"), "capture_id")
        .groupBy("url")
        .agg(F.count("*").alias("n_captured"), cards.three_times().alias("response_time"))
    )


def assembled(linked: DataFrame, times: DataFrame, selectors: DataFrame) -> DataFrame:
    """The report of sites with what their forms, probe times and cards gave."""
    complete = F.coalesce(F.col("n_captured"), F.lit(0)) == 3
    reason = (
        F.when(F.col("form_reason").isNotNull(), F.col("form_reason"))
        .when(F.col("search_url").isNull(), F.lit("no_capture"))
        .when(~complete, F.lit("no_capture"))
        .when(F.col("card_reason").isNotNull(), F.col("card_reason"))
        .when(F.col("selector").isNull(), F.lit("no_pattern"))
    )
    stage = F.when(F.col("search_url").isNull(), F.lit("form")).otherwise(F.lit("cards"))
    return (
        linked.join(times, "url", "left")
        .join(selectors, "url", "left")
        .withColumn("reject_reason", reason)
        .withColumn("reject_stage", F.when(F.col("reject_reason").isNotNull(), stage))
        .withColumn("selector", F.when(F.col("reject_reason").isNull(), F.col("selector")))
        .withColumn("id", link_id(F.col("url")))
        .select(*LINK_COLUMNS, "reject_stage", "reject_reason")
    )


def discovered_links(report: DataFrame) -> DataFrame:
    """The complete links of a report; failed sites give no row."""
    return report.filter(F.col("selector").isNotNull()).select(*LINK_COLUMNS)


def discover(captures: DataFrame, pages: DataFrame, rules: Rules) -> DataFrame:
    return discovered_links(discovery_report(captures, pages, rules))


def site_errors(report: DataFrame) -> DataFrame:
    return report.filter(F.col("reject_reason").isNotNull()).select("url", "reject_stage", "reject_reason")


def discovery_funnel(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("website_links"),
        F.count("search_url").alias("search_links"),
        F.count("selector").alias("links"),
    )
