"""Differential card discovery: a no-result page and two result pages -> card selector.

``probes`` are parsed probe pages keyed by ``site`` with ``probe_no`` 0 (the
nonsense query), 1 and 2.  Elements are exploded with a few short derived
columns only; every later group is one site or one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions import dom, selectors
from pagesift.functions.binding import let
from pagesift.functions.css import match_counts
from pagesift.functions.text import complexity_of, is_pager_label
from pagesift.functions.urls import fill_template_form
from pagesift.sources.rules import Rules


def probe_queries(links: DataFrame, rules: Rules, category: str = "category") -> DataFrame:
    """Three rows per link: ``probe_no`` 0 is the nonsense query, 1 and 2 come from the category."""
    terms = F.concat(F.array(F.lit(rules.nonsense_query)), F.slice(rules.probes(F.col(category)), 1, 2))
    return links.select("*", F.posexplode(terms).alias("probe_no", "probe_query"))


def probe_urls(links: DataFrame, rules: Rules) -> DataFrame:
    filled = fill_template_form(F.col("search_url"), F.col("probe_query"))
    return probe_queries(links, rules).withColumn("probe_url", filled)


def _element_key(e: Column) -> Column:
    """64 bits for the pair of parent path and class selector."""
    return F.xxhash64(selectors.parent_path_id(e), selectors.class_selector(e))


def _facts(e: Column, anchors: Column) -> Column:
    return F.struct(
        e["node_id"].alias("node_id"),
        e["parent_id"].alias("parent_id"),
        _element_key(e).alias("element_key"),
        F.xxhash64(selectors.child_signature(e)).alias("signature_key"),
        e["tag"].alias("tag"),
        F.when(F.col("probe_no") > 0, e["classes"]).alias("classes"),
        F.size(e["child_tags"]).alias("n_children"),
        ((e["tag"] == "a") | dom.any_below(anchors, e)).alias("has_anchor"),
        is_pager_label(e["label"]).alias("is_pager"),
        complexity_of(F.size(e["child_tags"]), e["trimmed_len"]).alias("complexity"),
        F.when(F.col("probe_no") > 0, selectors.parent_selector(dom.node(e["parent_id"]))).alias("parent"),
    )


def _deep() -> Column:
    """The root and its children are left out."""
    return F.filter(dom.nodes(), lambda e: e["depth"] >= 2)


def no_result_blacklist(probes: DataFrame, *keys: str) -> DataFrame:
    """Distinct (parent path, class selector) of a no-result page; ``keys`` name one page.

    Texts are spelled for the distinct ones only, inside the page: nothing is shuffled.
    """
    seen = let(selectors.first_of_each(_deep(), _element_key), lambda firsts: F.transform(firsts, _texts))
    return probes.select(*keys, F.inline(seen)).select(*keys, "parent_path", "element")


def _texts(e: Column) -> Column:
    return F.struct(
        e["node_id"].alias("node_id"),
        selectors.parent_tag_path(e).alias("parent_path"),
        selectors.class_selector(e).alias("element"),
        selectors.child_signature(e).alias("signature"),
    )


def spelled(rows: DataFrame, probes: DataFrame, *keys: str, node_col: str = "node_id") -> DataFrame:
    """``rows`` with ``parent_path, element, signature`` of the node that each names.

    Rows of one page (``keys`` and ``probe_no``) are gathered, so a page is looked up
    once, and only the nodes that are named are spelled.
    """
    page = [*keys, "probe_no"]
    others = [c for c in rows.columns if c not in page]
    asked = rows.groupBy(*page).agg(F.collect_list(F.struct(*others)).alias("asked"))
    told = F.transform("asked", lambda r: F.struct(r.alias("row"), _texts(dom.node(r[node_col])).alias("texts")))
    found = asked.join(probes.select(*page, "nodes", "paths"), page).select(*page, F.inline(told))
    return found.select(*page, "row.*", "texts.parent_path", "texts.element", "texts.signature")


def diff_candidates(probes: DataFrame, *keys: str) -> DataFrame:
    """Elements of the result pages whose (path, selector) the site's no-result page does not have.

    A window over the key instead of an anti-join of two branches: the pages
    are parsed once and shuffled once.  A key's rows come from three pages, so
    they are dealt out by the key alone; the groups of siblings, pages and keys
    that are formed next then need no other exchange.  Paths, selectors and
    signatures travel as 64-bit keys; ``spelled`` has their texts.
    """
    # Of the no-result page only the keys count, each once.
    asked = F.when(F.col("probe_no") == 0, selectors.first_of_each(_deep(), _element_key)).otherwise(_deep())
    facts = let(match_counts(lambda e: e["tag"] == "a"), lambda anchors: F.transform(asked, lambda e: _facts(e, anchors)))
    found = probes.select(*keys, "probe_no", F.inline(facts)).repartition(*keys)
    same = Window.partitionBy(*keys, "element_key")
    known = F.max(F.col("probe_no") == 0).over(same)
    return found.withColumn("known", known).filter("not known and probe_no > 0").drop("known")


def sibling_patterns(candidates: DataFrame, *keys: str) -> DataFrame:
    """Groups of siblings with the same child signature: a group never spans pages."""
    page = [*keys, "probe_no"]
    first = F.min_by(F.struct("tag", "n_children", "has_anchor", "complexity", "parent"), "node_id")
    groups = candidates.groupBy(*page, "parent_id", "signature_key").agg(
        F.count("*").alias("count"),
        F.min("node_id").alias("first_id"),
        first.alias("first"),
        F.max("is_pager").alias("any_pager"),
        F.sort_array(F.collect_list(F.struct("node_id", "classes"))).alias("members"),
    )
    return groups.select(
        *page,
        "parent_id",
        "signature_key",
        "count",
        "first_id",
        F.min("first_id").over(Window.partitionBy(*page, "parent_id")).alias("parent_first_id"),
        "first.*",
        "any_pager",
        F.transform("members", lambda m: m["node_id"]).alias("element_ids"),
        selectors.shared_classes(F.transform("members", lambda m: m["classes"])).alias("classes"),
    )


def card_patterns(patterns: DataFrame) -> DataFrame:
    """Groups that can be cards: the first element is an ``a``, or a repeated element holding one."""
    repeated = (F.col("count") > 1) & (F.col("n_children") > 0) & F.col("has_anchor")
    return patterns.filter((F.col("tag") == "a") | repeated)


def pattern_rows(patterns: DataFrame, *keys: str) -> DataFrame:
    """(parent selector, element ids, count) of the card patterns."""
    return card_patterns(patterns).select(*keys, "probe_no", "parent", "element_ids", "count")


def best_patterns(patterns: DataFrame, *keys: str) -> DataFrame:
    """Per page the non-pager pattern with the highest 10 * count + complexity; first met wins ties.

    A page whose patterns are all pagers has a null ``parent``.
    """
    page = [*keys, "probe_no"]
    score = F.col("count") * 10 + F.col("complexity")
    order = F.struct(-score, "parent_first_id", "first_id")
    best = F.min_by(
        F.struct(score.alias("score"), "parent", "tag", "classes", "count", "element_ids"),
        F.when(~F.col("any_pager"), order),
    )
    return card_patterns(patterns).groupBy(*page).agg(best.alias("best")).select(*page, "best.*")


def card_selectors(best: DataFrame, *keys: str) -> DataFrame:
    """Join of the two winners: equal parents give the selector, else a reject reason."""

    def of(n: int, name: str) -> Column:
        return F.max(F.when(F.col("probe_no") == n, F.col(name)))

    both = best.groupBy(*keys).agg(
        F.count_if(F.col("probe_no") == 1).alias("n1"),
        F.count_if(F.col("probe_no") == 2).alias("n2"),
        of(1, "parent").alias("parent"),
        of(2, "parent").alias("parent2"),
        of(1, "tag").alias("tag"),
        of(1, "classes").alias("classes1"),
        of(2, "classes").alias("classes2"),
    )
    shared = F.array_intersect("classes1", "classes2")
    reason = (
        F.when((F.col("n1") == 0) | (F.col("n2") == 0), F.lit("no_pattern"))
        .when(F.col("parent").isNull() | F.col("parent2").isNull(), F.lit("only_pagination"))
        .when(F.col("parent") != F.col("parent2"), F.lit("inconsistent_patterns"))
    )
    selector = F.when(reason.isNull(), selectors.common_selector(F.col("parent"), F.col("tag"), shared))
    return both.select(*keys, selector.alias("selector"), reason.alias("reject_reason"))


def find_card_selectors(probes: DataFrame, *keys: str) -> DataFrame:
    """Parsed probe pages of many sites -> one selector (or reject reason) per site."""
    candidates = diff_candidates(probes, *keys)
    return card_selectors(best_patterns(sibling_patterns(candidates, *keys), *keys), *keys)


def mean_response_ms(probes: DataFrame, *keys: str) -> DataFrame:
    """Integer mean of the three probe times per site; null unless all three are known."""
    return probes.groupBy(*keys).agg(three_times().alias("response_time"))


def three_times() -> Column:
    return F.when(F.count("elapsed_ms") == 3, F.expr("sum(elapsed_ms) div 3"))
