"""Selector strings and signatures of a node (a struct column)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.binding import CHUNK, let
from pagesift.functions.dom import node
from pagesift.functions.text import css_escape

_STEP = " > "


def _spelled(entry: Column, steps: Column) -> Column:
    """Tags of so many entries of the path trie, from the given one up, joined from the top down."""
    paths = F.col("paths")
    none = F.array().cast("array<string>")
    joined = lambda tags: F.array_join(F.reverse(tags), _STEP)

    def climb(state: Column, _: Column) -> Column:
        def moved(near: Column) -> Column:
            full = F.size(near) >= CHUNK
            return F.struct(
                F.get(paths, state["at"])["up"].alias("at"),
                F.when(full, none).otherwise(near).alias("near"),
                F.when(full, F.array_append(state["far"], joined(near))).otherwise(state["far"]).alias("far"),
            )

        return let(F.array_append(state["near"], F.get(paths, state["at"])["tag"]), moved)

    def whole(state: Column) -> Column:
        last = F.when(F.size(state["near"]) > 0, F.array(joined(state["near"]))).otherwise(none)
        return joined(F.concat(state["far"], last))

    start = F.struct(entry.alias("at"), none.alias("near"), none.alias("far"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, climb, whole)


def tag_path(e: Column) -> Column:
    """Tags from below the root down to the node, joined with `` > ``; null for the root."""
    return F.when(e["depth"] > 0, _spelled(e["path"], e["depth"]))


def parent_tag_path(e: Column) -> Column:
    """``tag_path`` of the parent; null when that is missing or the root."""
    return F.when(e["depth"] > 1, _spelled(F.get("paths", e["path"])["up"], e["depth"] - 1))


def parent_path_id(e: Column) -> Column:
    """What stands for ``parent_tag_path``: equal on all pages iff the texts are."""
    return F.when(e["depth"] > 1, node(e["parent_id"])["path_id"])


def once_per_path(nodes: Column, spelled: Callable[[Column], Column]) -> Column:
    """``spelled`` of each node, an expression that only depends on the node's path, worked out once per path."""

    def looked_up(all_: Column, firsts: Column) -> Column:
        texts = F.map_from_arrays(F.transform(firsts, lambda e: e["path"]), F.transform(firsts, spelled))
        return let(texts, lambda known: F.transform(all_, lambda e: F.try_element_at(known, e["path"])))

    return let(nodes, lambda all_: let(first_of_each(all_, lambda e: e["path"]), lambda firsts: looked_up(all_, firsts)))


def first_of_each(nodes: Column, key: Callable[[Column], Column]) -> Column:
    """The first node for each key, by place in the page."""
    keyed = F.transform(nodes, lambda e: F.struct(key(e).alias("key"), e["node_id"].alias("at")))
    # In sorted order the first of each key has no equal key before it.
    firsts = let(F.array_sort(keyed), lambda s: F.filter(s, lambda k, i: ~F.coalesce(F.get(s, i - 1)["key"].eqNullSafe(k["key"]) & (i > 0), F.lit(False))))
    return F.transform(firsts, lambda k: node(k["at"]))


def class_selector(e: Column) -> Column:
    """``tag.c1.c2`` with escaped, sorted classes; else ``tag#id``; else ``tag``."""
    classes = F.array_join(F.sort_array(F.transform(e["classes"], css_escape)), ".")
    return F.concat(
        e["tag"],
        F.when(F.size(e["classes"]) > 0, F.concat(F.lit("."), classes))
        .when(e["id"] != "", F.concat(F.lit("#"), e["id"]))
        .otherwise(F.lit("")),
    )


def parent_selector(e: Column) -> Column:
    """``tag#id`` when the node has an id (not escaped), else ``class_selector``."""
    return F.when(e["id"] != "", F.concat(e["tag"], F.lit("#"), e["id"])).otherwise(class_selector(e))


def element_selector(e: Column) -> Column:
    """struct(selector of the parent or empty, selector of the node)."""
    return F.struct(
        F.coalesce(parent_selector(node(e["parent_id"])), F.lit("")).alias("parent"),
        class_selector(e).alias("element"),
    )


def child_signature(e: Column) -> Column:
    """Upper-case child tags joined without separator."""
    return F.array_join(F.transform(e["child_tags"], F.upper), "")


def shared_classes(class_lists: Column) -> Column:
    """Classes present in every list of an array of class lists."""
    return F.aggregate(class_lists, F.get(class_lists, 0), F.array_intersect)


def common_selector(parent: Column, first_tag: Column, classes: Column) -> Column:
    """``parent > tag.shared.classes`` for a group of elements."""
    names = F.array_join(F.transform(F.sort_array(classes), css_escape), ".")
    dotted = F.when(F.size(classes) > 0, F.concat(F.lit("."), names)).otherwise(F.lit(""))
    return F.concat(parent, F.lit(_STEP), first_tag, dotted)
