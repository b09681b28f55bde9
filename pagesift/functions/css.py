"""CSS selectors as expressions.

Two forms: a selector fixed in the code becomes a predicate (``matcher``); a
selector that is *data* - each site has its own - becomes an array of steps
(``selector_steps``) that ``select_by_steps`` folds over the page.

Either way a step with a combinator is answered for all nodes of the page at
once, as an array of flags: nodes are in document order and nest, so a node lies
below a flagged one iff the furthest end of the flagged nodes before it reaches it.
That is one pass per step, whatever the depth and the number of matches.

Grammar: tag, ``#id``, ``.class``, ``[attr]``, ``[attr='v']`` (fixed form only),
compounds, descendant and child combinators, lists.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.binding import CHUNK, chunks, let, running

_SIMPLE = re.compile(r"""\[\s*([\w-]+)\s*(?:=\s*['"]?([^'"\]]*)['"]?\s*)?\]|([#.])((?:\\.|[\w-])+)|(\*|[\w-]+)""")


def _compound(css: str) -> Callable[[Column], Column]:
    tests: list[Callable[[Column], Column]] = []
    for attr, value, mark, name, tag in (m.groups() for m in _SIMPLE.finditer(css)):
        name = re.sub(r"\\(.)", r"\1", name) if name else name
        if attr and value is None:
            tests.append(lambda e, a=attr: F.map_contains_key(e["attrs"], a))
        elif attr:
            tests.append(lambda e, a=attr, v=value: e["attrs"][a] == v)
        elif mark == "#":
            tests.append(lambda e, n=name: e["id"] == n)
        elif mark == ".":
            tests.append(lambda e, n=name: F.array_contains(e["classes"], n))
        elif tag != "*":
            tests.append(lambda e, t=tag.lower(): e["tag"] == t)

    def test(e: Column) -> Column:
        out = F.lit(True)
        for one in tests:
            out = one(e) if out is None else out & one(e)
        return F.coalesce(out, F.lit(False))

    return test


def _steps(css: str) -> list[tuple[bool, str]]:
    """(whether it is a child of the step before, compound) for each step of a chain."""
    parts = [p for p in re.split(r"\s*(>)\s*|\s+(?![^\[]*\])", css.strip()) if p]
    return [(parts[i - 1] == ">" if i else False, p) for i, p in enumerate(parts) if p != ">"]


def _chain(css: str) -> Callable[[Column], Column]:
    steps = _steps(css)
    test = _compound(steps[0][1])
    for child, compound in steps[1:]:
        test = _below(test, _compound(compound), child)
    return test


def _below(outer, inner, child: bool) -> Callable[[Column], Column]:
    def up(i: Column) -> Column:
        return outer(F.get(F.col("nodes"), i))

    if child:
        return lambda e: inner(e) & F.coalesce(up(e["parent_id"]), F.lit(False))
    return lambda e: inner(e) & any_ancestor(e, outer)


def over_ancestors(e: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold over the ancestors of a node, from its parent up to the root, along ``parent_id``."""
    nodes = F.col("nodes")
    up = F.slice(F.sequence(F.lit(0), e["depth"]), F.lit(2), e["depth"])  # as many steps as the node is deep

    def climb(state: Column, _: Column) -> Column:
        above = F.get(nodes, state["at"])
        return F.struct(above["parent_id"].alias("at"), step(state["value"], above).alias("value"))

    first = F.struct(e["parent_id"].alias("at"), start.alias("value"))
    return F.aggregate(up, first, climb, lambda s: s["value"])


def any_ancestor(e: Column, test: Callable[[Column], Column]) -> Column:
    return over_ancestors(e, F.lit(False), lambda found, above: found | F.coalesce(test(above), F.lit(False)))


def matcher(css: str) -> Callable[[Column], Column]:
    """Predicate over a node for a fixed selector."""
    chains = [_chain(part) for part in css.split(",")]

    def test(e: Column) -> Column:
        out = chains[0](e)
        for chain in chains[1:]:
            out = out | chain(e)
        return out

    return test


def selector_steps(css: Column) -> Column:
    """A selector column as ``array<struct<comb,tag,id,classes>>``.

    ``comb`` tells how a step relates to the one before it: ``>`` child, a
    space for descendant, ``,`` for the start of an alternative.
    """
    # Possessive repeats (``++``) loop; a plain repeat of a group recurses once per character.
    found = F.regexp_extract_all(F.trim(css), F.lit(r"\s*+[>,]\s*+|\s++|(?:\\.|[^\s>,\\])++"), F.lit(0))

    def step(tokens: Column, token: Column, i: Column) -> Column:
        link = F.trim(F.get(tokens, i - 1))

        def built(marks: Column) -> Column:
            def names(mark: str) -> Column:
                return F.transform(
                    F.filter(marks, lambda m: m.startswith(mark)),
                    lambda m: F.regexp_replace(F.regexp_replace(m, r"^.", ""), r"\\(.)", "$1"),
                )

            return F.struct(
                F.when(i == 0, F.lit(",")).when(link == "", F.lit(" ")).otherwise(link).alias("comb"),
                F.lower(F.regexp_extract(token, r"^[A-Za-z][A-Za-z0-9-]*", 0)).alias("tag"),
                F.get(names("#"), 0).alias("id"),
                names(".").alias("classes"),
            )

        return let(F.regexp_extract_all(token, F.lit(r"[.#](?:\\.|[^.#\\\[])++"), F.lit(0)), built)

    # Compounds and combinators alternate, so every second token is a step.
    return F.filter(
        let(found, lambda tokens: F.transform(tokens, lambda t, i: F.when(i % 2 == 0, step(tokens, t, i)))),
        lambda s: s.isNotNull(),
    )


def below(flags: Column) -> Column:
    """For each node whether an ancestor is flagged."""
    ends = F.transform(F.col("nodes"), lambda e, i: F.when(F.get(flags, i), e["last_id"]).otherwise(F.lit(-1)))
    # The furthest end up to the node before; a node's own end never reaches into what comes before it.
    reach = let(ends, lambda found: running(found, F.lit(-1), F.greatest))
    return let(reach, lambda found: F.transform(F.col("nodes"), lambda e, i: F.coalesce(F.get(found, i - 1) >= i, F.lit(False))))


def either(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda a, b: a | b)


def is_compound(css: str) -> bool:
    """Whether a fixed selector has no combinator."""
    return all(len(_steps(part)) == 1 for part in css.split(","))


def page_flags(css: str) -> Column:
    """For each node of the page whether a fixed selector matches it."""
    nodes = F.col("nodes")

    def chain(part: str) -> Column:
        steps = _steps(part)
        first = _compound(steps[0][1])
        flags = F.transform(nodes, lambda e: first(e))
        for child, css_ in steps[1:]:
            flags = let(flags, functools.partial(linked, child, _compound(css_)))
        return flags

    def linked(child: bool, test: Callable[[Column], Column], before: Column) -> Column:
        if child:
            return F.transform(nodes, lambda e: test(e) & F.coalesce(F.get(before, e["parent_id"]), F.lit(False)))
        return let(below(before), lambda inside: F.transform(nodes, lambda e, i: test(e) & F.get(inside, i)))

    return functools.reduce(either, [chain(part) for part in css.split(",")])


def nearest(test: Callable[[Column], Column]) -> Column:
    """For each node the id of the nearest of the node and its ancestors that passes ``test``, or null.

    A node takes what its parent has: parents come first, in this part of the page or an earlier one.
    """
    nodes = F.col("nodes")
    none = F.array().cast("array<int>")

    def part(done: Column, some: Column) -> Column:
        start = F.get(some, 0)["node_id"]

        def own(found: Column, e: Column) -> Column:
            up = e["parent_id"]
            early = F.get(F.get(done, F.floor(up / CHUNK).cast("int")), F.pmod(up, F.lit(CHUNK)))
            above = F.when(up < 0, F.lit(None)).when(up >= start, F.get(found, up - start)).otherwise(early)
            return F.array_append(found, F.when(test(e), e["node_id"]).otherwise(above))

        return F.aggregate(some, none, own)

    return F.aggregate(chunks(nodes), F.array().cast("array<array<int>>"), lambda done, some: F.array_append(done, part(done, some)), F.flatten)


def match_counts(test: Callable[[Column], Column]) -> Column:
    """For each node how many nodes up to it, itself included, pass ``test``."""
    return running(F.transform(F.col("nodes"), lambda e: test(e).cast("int")), F.lit(0), lambda n, one: n + one)


def select_by_steps(steps: Column) -> Column:
    """Nodes of the page matching ``steps``, in document order and without duplicates."""
    nodes = F.col("nodes")

    def fits(e: Column, s: Column) -> Column:
        return (
            ((s["tag"] == "") | (e["tag"] == s["tag"]))
            & (s["id"].isNull() | F.coalesce(e["id"] == s["id"], F.lit(False)))
            & (F.size(F.array_except(s["classes"], e["classes"])) == 0)
        )

    def advance(acc: Column, s: Column) -> Column:
        def found(linked: Column) -> Column:
            now = F.transform(nodes, lambda e, i: F.coalesce(F.get(linked, i), F.lit(False)) & fits(e, s))
            done = F.when(s["comb"] == ",", either(acc["done"], acc["now"])).otherwise(acc["done"])
            return F.struct(now.alias("now"), done.alias("done"))

        linked = (
            F.when(s["comb"] == ",", F.transform(nodes, lambda e: F.lit(True)))
            .when(s["comb"] == ">", F.transform(nodes, lambda e: F.get(acc["now"], e["parent_id"])))
            .otherwise(below(acc["now"]))
        )
        return let(linked, found)

    none = F.transform(nodes, lambda e: F.lit(False))
    folded = F.aggregate(
        steps,
        F.struct(none.alias("now"), none.alias("done")),
        advance,
        lambda acc: either(acc["done"], acc["now"]),
    )
    return let(folded, lambda flags: F.filter(nodes, lambda e, i: F.coalesce(F.get(flags, i), F.lit(False))))
