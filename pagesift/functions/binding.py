"""Name an intermediate value inside a ``Column`` expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Reusing a ``Column`` object copies its whole expression tree at each use;
    a chain of such reuses grows exponentially.  A one-element ``transform``
    binds the value to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), 0)


def computed(*columns: Column) -> Column:
    """Columns computed once per row, for ``select``: a filter on them stays above.

    Catalyst moves a filter below a projection by repeating the projected
    expressions inside the filter.  For page-sized array expressions that means
    doing the work twice, so they are emitted by a one-row generator, which
    filters do not pass.
    """
    return F.inline(F.array(F.struct(*columns)))


#: Elements of an array that a fold collects at once.
CHUNK = 256


def chunks(values: Column) -> Column:
    """``values`` in arrays of ``CHUNK`` elements.

    A fold that appends to an array copies it at every step, which grows with the
    square of the array's length; over chunks, it grows with the chunk's.
    """

    def cut(all_: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(CHUNK)), lambda at: at <= F.size(all_))
        return F.transform(starts, lambda at: F.slice(all_, at, CHUNK))

    return let(values, cut)


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after each element of ``values``, folded from ``start``: as long as ``values``."""

    def part(state: Column, some: Column) -> Column:
        none = F.struct(state.alias("state"), F.array_remove(F.array(start), start).alias("out"))
        once = lambda acc, v: let(step(acc["state"], v), lambda s: F.struct(s.alias("state"), F.array_append(acc["out"], s).alias("out")))
        return F.aggregate(some, none, once)

    none = F.struct(start.alias("state"), F.array_remove(F.array(F.array(start)), F.array(start)).alias("outs"))
    more = lambda acc, some: let(
        part(acc["state"], some), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["outs"], r["out"]).alias("outs"))
    )
    return F.aggregate(chunks(values), none, more, lambda acc: F.flatten(acc["outs"]))
