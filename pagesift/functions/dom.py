"""Questions inside one page, as array expressions over its ``nodes`` and ``text`` columns.

No function here needs a join or a shuffle: a node's ancestors are reached along
``parent_id``, its descendants are a slice, its text is a slice of the page text.
Node arguments are struct columns, usually lambda variables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.binding import let
from pagesift.functions.css import any_ancestor, is_compound, matcher, over_ancestors, page_flags


def nodes() -> Column:
    return F.col("nodes")


def node(node_id: Column) -> Column:
    """The node with that id, or null."""
    return F.get(nodes(), node_id)


def descendants(e: Column) -> Column:
    return F.slice(nodes(), e["node_id"] + 2, e["last_id"] - e["node_id"])


def text_content(e: Column) -> Column:
    """Text of the node and all its descendants, scripts and styles included."""
    return F.col("text").substr(e["text_start"] + 1, e["text_len"])


def attr(e: Column, name: str) -> Column:
    """Attribute value, null when absent."""
    return e["attrs"][name]


def has_attr(e: Column, name: str) -> Column:
    return F.map_contains_key(e["attrs"], name)


def has_class(e: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(e["classes"], name), F.lit(False))


def select(css: str, root: Column | None = None) -> Column:
    """Nodes matching a fixed selector, in document order: below ``root`` or in the whole page.

    With a combinator it works on the whole page, once per call: inside a loop over
    nodes, make ``page_flags`` before the loop and use ``flagged``.
    """
    if is_compound(css):
        return F.filter(nodes() if root is None else descendants(root), matcher(css))
    return let(page_flags(css), lambda flags: flagged(flags, root))


def flagged(flags: Column, root: Column | None = None) -> Column:
    """Nodes with a flag, in document order: below ``root`` or in the whole page."""
    return F.filter(nodes() if root is None else descendants(root), lambda e: F.get(flags, e["node_id"]))


def select_first(css: str, root: Column | None = None) -> Column:
    return F.get(select(css, root), 0)


def any_below(counts: Column, e: Column) -> Column:
    """Whether one of the nodes that ``match_counts`` counts is below the node."""
    return F.coalesce(F.get(counts, e["last_id"]) > F.get(counts, e["node_id"]), F.lit(False))


def contains(css: str, root: Column) -> Column:
    return F.coalesce(F.exists(descendants(root), matcher(css)), F.lit(False))


def closest(css: str, e: Column) -> Column:
    """The nearest of the node and its ancestors that matches, or null."""
    match = matcher(css)
    nearest = over_ancestors(
        e,
        F.lit(None).cast("int"),
        lambda found, above: F.coalesce(found, F.when(match(above), above["node_id"])),
    )
    return F.when(match(e), e).otherwise(node(nearest))


def has_closest(css: str, e: Column) -> Column:
    match = matcher(css)
    return F.coalesce(match(e), F.lit(False)) | any_ancestor(e, match)


def next_sibling(tag: str, e: Column) -> Column:
    """The first following sibling with that tag, or null."""
    after = F.slice(nodes(), e["last_id"] + 2, node(e["parent_id"])["last_id"] - e["last_id"])
    return F.get(F.filter(after, lambda s: (s["parent_id"] == e["parent_id"]) & (s["tag"] == tag)), 0)
