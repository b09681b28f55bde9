"""Secret scans in DataFrame expressions: three patterns and the entropy of sliding windows.

Places of matches: a text split at a pattern gives the parts between its matches,
and the matches themselves come from the same leftmost scan, so running sums of
lengths are the places.  Texts without a match are not split.

Entropy: candidates are runs of key characters.  A window moves over each
candidate; the counts of the characters in it are held in a string, one character
per symbol whose code is the count, and a step changes two counts and a running
sum.  With ``c`` of ``n`` characters equal, the entropy is
``log2 n - (sum of c log2 c) / n``; ``c log2 c`` comes from a table in millionths,
so sums are exact integers and do not depend on the order of steps.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.binding import computed, let
from pagesift.llm.common import column, whole

#: Kind, pattern, group that is measured, least characters of it (fixed values of the contract).
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    # The least length is part of these patterns: a shorter run holds no longer one.
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
KINDS = ("assign", "access", "hex", "entropy")
PLACES = "array<struct<start: int, end: int, part: string>>"
#: Matches whose places are summed in one go.
BLOCK = 256
#: Every character of a candidate.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"


@dataclass(frozen=True)
class EntropyRule:
    """Candidates of one character class; ``bits`` is the least entropy of some window."""

    name: str
    only: str
    bits: float


@dataclass(frozen=True)
class EntropySettings:
    """The first rule whose class holds all characters of a candidate decides on it.

    A candidate that matches an ``allowed`` pattern is not reported.  An unanchored
    pattern takes only the parts between ``=`` and ``/`` that it matches in (it has
    neither of them itself); what is left on either side is a candidate of its own.
    A pattern may repeat a group only possessively (``(...)*+``): the JVM runs other
    repeats of groups recursively, once for each repetition, and a long candidate
    ends the executor.
    """

    window: int = 20
    rules: tuple[EntropyRule, ...] = (
        EntropyRule("hex", "[0-9A-Fa-f]+", 2.8),
        EntropyRule("letters", "[A-Za-z]+", 3.7),
        EntropyRule("alphanumeric", "[A-Za-z0-9]+", 3.6),
        EntropyRule("base64", "[A-Za-z0-9+/_=-]+", 3.7),
    )
    allowed: tuple[str, ...] = field(
        default=(
            r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
            r"(?i)example|placeholder|your[_-]?(key|token|secret)",
            r"(?i)abcdefghijklm|0123456789abcdef",
            r"^[a-z]++(?:[-_/=+][a-z]++)*+$",
        )
    )

    def __post_init__(self) -> None:
        if not 2 <= self.window < 127:
            raise ValueError("a window has 2 to 126 characters")
        for rule in self.rules:
            if self.most(rule) < 0:
                raise ValueError(f"no window of {self.window} characters has {rule.bits} bits: class {rule.name} would never be measured")
        for pattern in (*self.allowed, *(rule.only for rule in self.rules)):
            if re.search(r"(?<!\\)\)(?:[*+]|\{\d*,?\d*\})(?!\+)", pattern):
                raise ValueError(f"{pattern} repeats a group, but not possessively")

    def most(self, rule: EntropyRule) -> int:
        """Largest sum of c log2 c, in millionths, whose entropy is ``rule.bits`` or more."""
        return math.floor((math.log2(self.window) - rule.bits) * self.window * 1_000_000)

    def weights(self) -> list[int]:
        return [round(c * math.log2(c) * 1_000_000) if c else 0 for c in range(self.window + 1)]


def places(text: Column, pattern: str, wanted: Column) -> Column:
    """array<struct<start, end, part>> of all matches, in code points; ``part`` is the whole match.

    ``wanted`` says whether the text can hold a match; others get an empty array.
    """
    empty = F.array().cast(PLACES)

    def walk(parts: Column, matches: Column) -> Column:
        # The part behind the last match has no match and is left out.
        pairs = F.arrays_zip(F.slice(parts, F.lit(1), F.size(matches)).alias("gap"), matches.alias("part"))
        return let(pairs, summed)

    def summed(pairs: Column) -> Column:
        """Running sums, in blocks: an array that grows by one costs its length each time."""
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
        start = lambda at, found: F.struct(at.alias("at"), found.alias("found"))

        def step(state: Column, pair: Column) -> Column:
            begin = state["at"] + F.length(pair["gap"])
            end = begin + F.length(pair["part"])
            one = F.struct(begin.alias("start"), end.alias("end"), pair["part"].alias("part"))
            return start(end, F.concat(state["found"], F.array(one)))

        def block(state: Column, own: Column) -> Column:
            inside = F.aggregate(own, start(state["at"], empty), step)
            return let(inside, lambda x: start(x["at"], F.concat(state["found"], F.array(x["found"]))))

        return F.aggregate(blocks, start(F.lit(0), F.array().cast(f"array<{PLACES}>")), block, lambda s: F.flatten(s["found"]))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(matches, lambda m: F.when(F.size(m) > 0, walk(F.split(text, pattern, -1), m)).otherwise(empty))
    return F.when(wanted, found).otherwise(empty)


def base_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    def measured(match: Column) -> Column:
        return F.length(F.regexp_extract(match["part"], pattern, group)) >= least

    found = F.filter(places(text, pattern, text.rlike(pattern)), measured)
    return F.transform(found, lambda m: span(m, kind))


def span(match: Column, kind: str) -> Column:
    return F.struct(match["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), match["end"].alias("end"))


def lowest_sum(candidate: Column, settings: EntropySettings) -> Column:
    """The smallest sum of c log2 c (millionths) over all windows of the candidate: its most random window."""
    return let(F.split(candidate, ""), lambda symbols: _lowest_sum(symbols, settings))


def _lowest_sum(symbols: Column, settings: EntropySettings) -> Column:
    n = settings.window
    weights = F.array(*[F.lit(w).cast("bigint") for w in settings.weights()])
    none = "\0" * len(SYMBOLS)
    start = F.struct(
        F.lit(none).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("bigint").alias("least")
    )

    def changed(state_counts: Column, total: Column, symbol: Column, by: int, body) -> Column:
        """Count of ``symbol`` changed by one: the new counts and sum go to ``body``."""
        at = F.instr(F.lit(SYMBOLS), symbol)
        return let(
            F.struct(at.alias("at"), F.ascii(F.substr(state_counts, at, F.lit(1))).alias("count")),
            lambda x: let(
                F.struct(
                    F.overlay(state_counts, F.char(x["count"] + by), x["at"], F.lit(1)).alias("counts"),
                    (total - F.get(weights, x["count"]) + F.get(weights, x["count"] + by)).alias("sum"),
                ),
                body,
            ),
        )

    def step(state: Column, i: Column) -> Column:
        entering = F.get(symbols, i - 1)
        leaving = F.get(symbols, i - 1 - n)

        def entered(after: Column) -> Column:
            return F.struct(
                after["counts"].alias("counts"),
                after["sum"].alias("sum"),
                F.when(i >= n, F.least(state["least"], after["sum"])).otherwise(state["least"]).alias("least"),
            )

        add = lambda counts, total: changed(counts, total, entering, 1, entered)
        return F.when(i <= n, add(state["counts"], state["sum"])).otherwise(
            changed(state["counts"], state["sum"], leaving, -1, lambda x: add(x["counts"], x["sum"]))
        )

    return F.aggregate(F.sequence(F.lit(1), F.size(symbols)), start, step, lambda s: s["least"])


def is_random(candidate: Column, settings: EntropySettings) -> Column:
    """Whether some window reaches the entropy that the candidate's class asks for, and no allowed pattern matches."""
    limit = F.lit(None).cast("bigint")
    for rule in reversed(settings.rules):
        limit = F.when(candidate.rlike(f"^{rule.only}$"), F.lit(settings.most(rule)).cast("bigint")).otherwise(limit)
    allowed = F.lit(False)
    for pattern in settings.allowed:
        allowed = allowed | candidate.rlike(pattern)
    measured = let(limit, lambda m: F.when(m.isNotNull(), lowest_sum(candidate, settings) <= m).otherwise(F.lit(False)))
    return F.when(allowed, F.lit(False)).otherwise(measured)


def left_over(match: Column, settings: EntropySettings) -> Column:
    """The candidates of a match: itself, or what lies between the parts that an unanchored pattern takes."""
    words = "|".join(f"(?:{p})" for p in settings.allowed if not p.startswith("^"))
    if not words:
        return F.array(match)
    taken = f"(?<![^=/])[^=/]*?(?:{words})[^=/]*+"

    def between(hits: Column) -> Column:
        # One delimiter on each side belongs to the part that is taken.
        starts = F.concat(F.array(F.lit(0)), F.transform(hits, lambda h: h["end"] + 1))
        ends = F.concat(F.transform(hits, lambda h: h["start"] - 1), F.array(F.length(match["part"])))
        gaps = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda g: g["b"] - g["a"] >= settings.window)
        return F.transform(
            gaps,
            lambda g: F.struct(
                (match["start"] + g["a"]).alias("start"),
                (match["start"] + g["b"]).alias("end"),
                F.substr(match["part"], g["a"] + 1, g["b"] - g["a"]).alias("part"),
            ),
        )

    own = let(places(match["part"], taken, F.lit(True)), between)
    return F.when(match["part"].rlike(words), own).otherwise(F.array(match))


def entropy_spans(text: Column, settings: EntropySettings) -> Column:
    pattern = "[A-Za-z0-9+/_=-]{%d,}" % settings.window
    runs = F.flatten(F.transform(places(text, pattern, text.rlike(pattern)), lambda m: left_over(m, settings)))
    found = F.filter(runs, lambda m: is_random(m["part"], settings))
    return F.transform(found, lambda m: span(m, "entropy"))


def spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: EntropySettings | None = None
) -> DataFrame:
    """One row per document: ``doc_id`` and ``base``, ``entropy``: arrays of ``struct<start, rank, end>``.

    ``rank`` is the position in ``KINDS``; places are code points, end exclusive;
    arrays ascend by start, then rank.  A null text is an empty one and has no
    spans.  Rows are mapped one by one: repeats, null ids and empty tables pass
    through, other columns are not looked at.  Work and memory of a row follow the
    length of its text.
    """
    settings = settings or EntropySettings()
    rows = docs.select(column(id_col).alias("doc_id"), whole(text_col).alias("text"))
    text = F.col("text")
    base = F.array_sort(F.concat(*[base_spans(text, *rule) for rule in BASE]))
    return rows.select("doc_id", computed(base.alias("base"), F.array_sort(entropy_spans(text, settings)).alias("entropy")))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: EntropySettings | None = None) -> DataFrame:
    """``secret_spans`` as counts and digests, one row per document."""
    found = secret_spans(docs, id_col, text_col, settings)
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.size("entropy").cast("long").alias("n_entropy"),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
    )


# --- the same in SQL ---------------------------------------------------------------


def oracle(settings: EntropySettings | None = None) -> str:
    """Windows are counted anew at every place here; the weights are the same integers."""
    rules = settings or EntropySettings()
    n = rules.window

    def either_case(words: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)

    keys = either_case("password|passwd|secret|token|api_?key")
    assign = f"({keys})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"

    def found(kind: int, pattern: str, keep: str) -> str:
        return f"""select doc_id, {kind} as rank, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda k: {{'part': m[k],
              'start': coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0)
                       + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)}}), lambda s: {keep})) as s
            from (select doc_id, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as g
                  from d where regexp_matches(t, '{pattern}'))"""

    limit = " ".join(f"when regexp_matches(c, '^{r.only}$') then {rules.most(r)}" for r in rules.rules)
    # The engine of the SQL never recurses and knows no possessive repeats.
    plain = [re.sub(r"([*+?}])\+", r"\1", p) for p in rules.allowed]
    allowed = " or ".join(f"regexp_matches(c, '{p}')" for p in plain)
    words = "|".join(f"(?:{p})" for p in plain if not p.startswith("^"))
    taken = f"regexp_matches(ps[k], '{words}')" if words else "false"
    run = "[A-Za-z0-9+/_=-]{%d,}" % n
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
base as (
  {found(0, assign, f"length(regexp_extract(s.part, '{assign}', 2)) >= 8")}
  union all {found(1, "AKIA[A-Z0-9]+", "length(s.part) >= 16")}
  union all {found(2, "[0-9a-f]{32,}", "true")}),
wholes as ({found(3, run, "true")}),
-- Parts between = and /; neighbours that no allowed word takes make one candidate.
parts as (
  select doc_id, rank, s, k, {taken} as taken, length(ps[k]) as size,
         coalesce(list_sum(list_transform(ps[1:k - 1], lambda x: length(x) + 1)), 0) as place
  from (select *, unnest(range(1, len(ps) + 1)) as k from (select *, string_split_regex(s.part, '[=/]') as ps from wholes))),
islands as (select *, count(*) filter (taken) over (partition by doc_id, s.start order by k) as island from parts),
lefts as (
  select doc_id, rank, s, min(place)::bigint as a, max(place + size)::bigint as b from islands where not taken group by doc_id, rank, s, island),
candidates as (
  select doc_id, rank, {{'part': substr(s.part, a + 1, b - a), 'start': s.start + a}} as s from lefts where b - a >= {n}),
measured as (
  select doc_id, rank, s, case {limit} end as most,
         list_min(list_transform(range(1, length(c) - {n - 2}), lambda i: list_sum(list_transform(
           map_values(list_aggregate(string_split(c[i:i + {n - 1}], ''), 'histogram')), lambda x: {rules.weights()}[cast(x as bigint) + 1])))) as least
  from (select doc_id, rank, s, s.part as c from candidates) where not ({allowed})),
spans as (
  select doc_id, rank, s.start as a, s.start + length(s.part) as b from base
  union all select doc_id, rank, s.start, s.start + length(s.part) from measured where least <= most),
spelled as (select *, {list(KINDS)}[rank + 1] || ':' || a::bigint || ':' || b::bigint as x from spans)
select d.doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access,
       count(*) filter (rank = 2) as n_hex, count(*) filter (rank = 3) as n_entropy,
       sha256(coalesce(string_agg(x, ',' order by a, rank) filter (rank < 3), '')) as base_sha256,
       coalesce(string_agg(x, ',' order by a, rank), '') as spans
from d left join spelled using (doc_id) group by d.doc_id"""
