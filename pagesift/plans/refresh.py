"""Discovery again: only pages whose content changed are parsed, and the report equals that of a whole run.

What a stage makes of pages depends on their texts, the site's URL and the rules
and on nothing else, so its findings are kept under a digest of these (a memo).
A run digests the captures it has not seen yet, looks the keys up and parses
pages for the others only.  Sites that left the directories, and pages that
changed, leave the memos with the next run.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators import cards, directory, forms
from pagesift.operators.html import parse_pages
from pagesift.plans.discover import assembled, probe_times
from pagesift.sources.captures import locate
from pagesift.sources.rules import Rules
from pagesift.sources.scratch import cut
from pagesift.sources.tables import VersionedTable

#: Counts with every key: raise it when a stage's rules change, and kept findings are made anew.
VERSION = "1"

_LINK_DDL = "title string, url string, category string, starred boolean, category_ord int, header_id int, node_id int"


class DiscoveryState:
    """What earlier runs found, in four tables.

    Findings are keyed by content, so a run that is lost between two of its
    writes leaves a state that is right, and only less complete.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        def table(name: str, schema: str) -> VersionedTable:
            return VersionedTable(spark, f"{path.rstrip('/')}/{name}", schema)

        self.digests = table("digests", "capture_id bigint, digest string")
        self.links = table("links", "key string, " + _LINK_DDL)
        self.forms = table("forms", "key string, search_url string, form_reason string")
        self.cards = table("cards", "key string, selector string, card_reason string")


class Refresh(NamedTuple):
    report: DataFrame
    """As ``discovery_report`` gives it."""
    parsed: DataFrame
    """``stage, url, capture_id`` of the pages that this run parsed; ``url`` is the site's or the directory page's."""


def _key(*parts: Column) -> Column:
    """Digest of texts with their lengths, so that no two lists of texts run into one."""
    sized = [F.concat(F.coalesce(F.length(p).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts]
    return F.sha2(F.concat(F.lit(VERSION + ";"), *sized), 256)


def _digested(located: DataFrame, captures: DataFrame, state: DiscoveryState) -> tuple[DataFrame, DataFrame]:
    """``located`` with the ``digest`` of each capture's text, and ``capture_id, digest`` of all of these.

    A capture keeps its text, so its digest is taken once; bodies of known
    captures are not read.
    """
    wanted = located.select("capture_id").distinct()
    known = state.digests.read().join(wanted, "capture_id", "left_semi")
    unseen = wanted.join(state.digests.read(), "capture_id", "left_anti")
    texts = captures.select("capture_id", "html").join(unseen, "capture_id")
    fresh = texts.select("capture_id", _key(F.col("html")).alias("digest"))
    digests = cut(known.unionByName(fresh))
    return located.join(digests, "capture_id"), digests


def _memo(kept: VersionedTable, keys: DataFrame, unknown: DataFrame, found: DataFrame) -> DataFrame:
    """Findings under ``keys(key)``: the kept ones and ``found`` for the keys of ``unknown``.

    A key without a finding gets one row of nulls, so that it is known next time.
    """
    made = unknown.join(found, "key", "left")
    known = kept.read().join(keys, "key", "left_semi")
    return cut(known.unionByName(made.select(*known.columns)))


def _unknown(keys: DataFrame, kept: VersionedTable) -> DataFrame:
    return cut(keys.join(kept.read().select("key").distinct(), "key", "left_anti"))


def _bodies(captures: DataFrame, pages: DataFrame) -> DataFrame:
    return parse_pages(captures.select("capture_id", "html").join(pages, "capture_id"))


def refresh(captures: DataFrame, pages: DataFrame, rules: Rules, state: DiscoveryState) -> Refresh:
    """``discovery_report`` of now, parsing only what no earlier run has seen; ``state`` is brought up to date.

    A capture never changes under its id: a page that is fetched again is a new
    capture, and is not parsed if its text is the old one.  Capture ids are not
    null.  Probe times are taken anew, as they need no page text.
    """
    # Directory pages: links by page text and rules.
    said = hashlib.sha256(repr((rules.categories, rules.link_skip_words)).encode()).hexdigest()
    listed, page_digests = _digested(cut(locate(pages, captures)), captures, state)
    listed = cut(listed.withColumn("key", _key(F.col("digest"), F.lit(said))))
    page_keys = listed.groupBy("key").agg(F.min_by(F.struct("capture_id", "url"), "capture_id").alias("at")).select("key", "at.*")
    new_pages = _unknown(page_keys, state.links)
    read = directory.website_links(_bodies(captures, new_pages.select("capture_id", "key")), rules, "key")
    links = _memo(state.links, page_keys.select("key"), new_pages.select("key"), read)
    entries = listed.select("key", "page_ord").join(links.filter("url is not null"), "key")
    sites = cut(directory.first_by_url(entries).select("url", "title", "category", "starred"))

    # Home pages: search forms by site and page text.
    homes, home_digests = _digested(cut(locate(sites.select("url"), captures)), captures, state)
    homes = cut(homes.withColumn("key", _key(F.col("url"), F.col("digest"))))
    new_homes = _unknown(homes.select("key", "url", "capture_id"), state.forms)
    read = forms.search_links(_bodies(captures, new_homes), "key").withColumnRenamed("reject_reason", "form_reason")
    found = _memo(state.forms, homes.select("key"), new_homes.select("key"), read)
    templates = homes.select("url", "key").join(found, "key").drop("key")
    linked = cut(sites.join(templates, "url", "left"))

    # Probe pages: selectors by site and the texts of its probes.
    wanted = cards.probe_urls(linked.filter("search_url is not null"), rules).select("url", "probe_no", "probe_url")
    located = cut(locate(wanted, captures, "probe_url"))
    probes, probe_digests = _digested(located, captures, state)
    shown = F.sort_array(F.collect_list(F.struct("probe_no", "digest")))  # three at most
    spelled = F.array_join(F.transform(shown, lambda p: F.concat_ws("=", p["probe_no"], p["digest"])), ",")
    keys = cut(probes.groupBy("url").agg(spelled.alias("texts")).select("url", _key(F.col("url"), F.col("texts")).alias("key")))
    new_sites = _unknown(keys, state.cards)
    new_probes = cut(located.join(new_sites, "url").select("url", "key", "probe_no", "capture_id"))
    read = cards.find_card_selectors(_bodies(captures, new_probes), "key").withColumnRenamed("reject_reason", "card_reason")
    patterns = _memo(state.cards, keys.select("key"), new_sites.select("key"), read)
    # A site whose probes show no pattern at all has a row of nulls, as it has none in a whole run.
    selectors = keys.join(patterns, "key").drop("key")
    report = cut(assembled(linked, probe_times(located, captures), selectors))

    state.digests.rewrite(page_digests.unionByName(home_digests).unionByName(probe_digests).distinct())
    state.links.rewrite(links)
    state.forms.rewrite(found)
    state.cards.rewrite(patterns)
    stages = {"directory": new_pages, "form": new_homes, "cards": new_probes}
    parsed = [rows.select(F.lit(stage).alias("stage"), "url", "capture_id") for stage, rows in stages.items()]
    return Refresh(report, parsed[0].unionByName(parsed[1]).unionByName(parsed[2]))
