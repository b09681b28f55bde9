"""Mixing sources to target weights: exact block quotas, dealt to shards by a hypergeometric splitting tree.

The words of a source form one stream: its documents in the order of their hashes,
cut into *blocks* of equally many words.  A source's target tells how many whole
passes over its stream the mix makes, and how many words of a last, partial one.
Each pass draws the blocks in an order of its own (that of a keyed hash), the partial
pass stops at its word; so a source gives its target to the word, and no document
is taken more often than there are passes.

Which shard takes how many of a source's draws is decided by a *splitting tree*:
a node holds a range of shards and its quota of each source; a multivariate
hypergeometric draw, seeded by the node, gives the left half its part, and the right
half has the rest.  So the quotas of all shards add up exactly, and each shard is
a random sample of the mix.  Nodes are split by tasks, a few levels at a time.
A shard takes the next draws of each source, disjoint from all others', and
shuffles them locally.

Streams and passes are numbered without a task that sees a whole source: parts of a
few thousand rows are summed by themselves, then the parts' totals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.binding import let
from pagesift.llm.common import column, whole
from pagesift.sources.scratch import cut

#: A word (fixed value of the contract), and the same with the white space before it.
WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
#: Rows that are numbered together.
PART = 4096
#: Levels of the splitting tree that one task works at once.
TREE_LEVELS = 8
#: Blocks of a node up to which numpy draws from the hypergeometric distribution; beyond it a node is split evenly.
LARGEST_DRAW = 10**9 - 1


@dataclass(frozen=True)
class Settings:
    """``weights`` go to the sources in turn; the mix has ``share`` times all words; a source gives at most ``most``
    times its words; ``seed`` chooses the orders."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    most: int = 2
    block_words: int = 2048
    shard_words: int = 1 << 22
    seed: str = "mix"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def order_key(identifier: Column, text: Column) -> Column:
    """Where a document comes in its source's stream."""
    return F.md5(F.concat(F.coalesce(identifier.cast("string"), F.lit("")), F.lit(":"), F.md5(text)))


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, texts: bool) -> DataFrame:
    text = whole(text_col)
    kept = [text.alias("text")] if texts else []
    return docs.select(
        column(id_col).alias("doc_id"), column(source_col).alias("source"), n_words(text).alias("size"), order_key(column(id_col), text).alias("h"), *kept
    )


# --- targets ----------------------------------------------------------------------


def with_targets(sources: DataFrame, settings: Settings) -> DataFrame:
    """``sources`` (``source, source_size, docs``) with ``no, weight, target, want, full, rest``.

    Sources are numbered by code point, null last.  Weights share what the mix takes until
    a source reaches ``most`` times its size; what it cannot take is shared by the
    others.  With the sources by falling need of a cap, that is one level: the first
    at which the next source is not above its cap.  ``want`` is the target in whole
    words, ``full`` passes and ``rest`` words of one more.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    rows = sources.withColumn("no", number.cast("long"))
    rows = rows.withColumn("weight", weights[(F.col("no") % len(settings.weights)).cast("int")])
    rows = rows.withColumns({
        "cap": F.lit(settings.most) * F.col("source_size"),
        "goal": F.lit(float(settings.share)) * F.sum("source_size").over(Window.partitionBy()),
    })
    rows = rows.withColumn("reach", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(float("inf")))
    order = Window.orderBy("reach", "no")
    before = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", F.try_divide(F.col("goal") - before, left))
    fits = F.when(F.col("level") <= F.col("reach"), F.struct("reach", "no", "level"))
    rows = rows.withColumn("fill", F.min(fits).over(Window.partitionBy())["level"])
    # least() passes over a null level: then all sources are at their caps.
    target = F.when(F.col("weight") > 0, F.least(F.col("cap").cast("double"), F.col("weight") * F.col("fill"))).otherwise(0.0)
    rows = rows.withColumn("target", target)
    rows = rows.withColumn("want", F.least(F.floor(F.col("target") + 0.5), F.col("cap")))
    full = F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(0)
    rows = rows.withColumn("full", full)
    rows = rows.withColumn("rest", F.col("want") - F.col("full") * F.col("source_size"))
    return rows.select("source", "source_size", "docs", "no", "weight", "target", "want", "full", "rest")


# --- running totals ---------------------------------------------------------------


def running(rows: DataFrame, group: list[str], members: Column, totals: dict[str, Column]) -> DataFrame:
    """``rows`` with running totals in the order of the hex digests ``h`` within each group, the row itself left out.

    ``members`` is how many rows the group has: it decides into how many parts, by ranges
    of the digests, the group is dealt.
    """
    parts = F.greatest(F.ceil(members / PART), F.lit(1))
    part = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") * parts / F.lit(2.0**32))
    dealt = rows.withColumns({"part": part} | {f"own_{k}": v for k, v in totals.items()})
    inside = Window.partitionBy(*group, "part").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    inner = dealt.withColumns({k: F.sum(f"own_{k}").over(inside) - F.col(f"own_{k}") for k in totals})
    sums = dealt.groupBy(*group, "part").agg(*[F.sum(f"own_{k}").alias(f"own_{k}") for k in totals])
    outside = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select(*group, "part", *[(F.sum(f"own_{k}").over(outside) - F.col(f"own_{k}")).alias(f"start_{k}") for k in totals])
    out = inner.join(starts, [*group, "part"]).withColumns({k: F.col(k) + F.col(f"start_{k}") for k in totals})
    return out.drop("part", *[f"own_{k}" for k in totals], *[f"start_{k}" for k in totals])


# --- streams and draws ------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """``sources`` with their targets, ``placed`` documents (``no, start``: place of the first word in the stream of
    the source), ``draws`` (``no, draw, pass, block, take``: words of the block), all of them written tables."""

    sources: DataFrame
    placed: DataFrame
    draws: DataFrame
    settings: Settings


def place(rows: DataFrame, sources: DataFrame) -> DataFrame:
    here = sources.select(F.col("source").alias("s"), "no", "docs", "source_size", "target")
    joined = rows.join(here, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return running(joined, ["no"], F.col("docs"), {"start": F.col("size")}).drop("h", "docs")


def draw_blocks(sources: DataFrame, settings: Settings) -> DataFrame:
    """All blocks that the mix takes: each pass in its own order, the partial one up to its last word."""
    size = settings.block_words
    some = sources.filter("want > 0").withColumn("blocks", F.ceil(F.col("source_size") / size))
    chunks = some.select("no", "source_size", "blocks", "full", "rest", F.explode(F.expr(f"sequence(0, (blocks - 1) div {PART})")).alias("chunk"))
    spread = chunks.repartition("no", "chunk")  # a source's chunks start as one row
    last = F.least(F.col("blocks"), (F.col("chunk") + 1) * PART) - 1
    each = spread.select("*", F.explode(F.sequence(F.col("chunk") * PART, last)).alias("block")).drop("chunk")
    passes = F.sequence(F.lit(0).cast("long"), F.col("full") - (F.col("rest") == 0).cast("long"))
    drawn = each.select("*", F.explode(passes).alias("pass")).withColumns({
        "words": F.least(F.lit(size).cast("long"), F.col("source_size") - F.col("block") * size),
        "h": F.md5(F.concat_ws(":", F.lit(settings.seed), "no", "pass", "block")),
    })
    ranked = running(drawn, ["no", "pass"], F.col("blocks"), {"rank": F.lit(1).cast("long"), "before": F.col("words")})
    take = F.when(F.col("pass") < F.col("full"), F.col("words")).otherwise(F.least(F.col("words"), F.col("rest") - F.col("before")))
    ranked = ranked.withColumn("take", take).filter("take > 0")
    return ranked.select("no", (F.col("pass") * F.col("blocks") + F.col("rank")).alias("draw"), "pass", "block", "take")


def plan(docs: DataFrame, settings: Settings, id_col="doc_id", source_col="source", text_col="text", texts: bool = False) -> Plan:
    rows = sized(docs, id_col, source_col, text_col, texts)
    if not texts:
        rows = cut(rows)
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = cut(with_targets(cut(totals), settings))
    return Plan(sources, cut(place(rows, sources)), cut(draw_blocks(sources, settings)), settings)


# --- the splitting tree -----------------------------------------------------------


def left_part(quotas: np.ndarray, many: int, random: np.random.Generator) -> np.ndarray:
    """How many of each source's blocks are among ``many`` that are drawn without replacement."""
    total = int(quotas.sum())
    if total <= LARGEST_DRAW:
        return random.multivariate_hypergeometric(quotas, many, method="marginals")
    shares = [int(q) * many for q in quotas]
    even = np.array([s // total for s in shares], np.int64)
    open_ = np.flatnonzero(np.array([s % total for s in shares], object) > 0)
    even[random.permutation(open_)[: many - int(even.sum())]] += 1
    return even


def split_node(low: int, high: int, quotas: np.ndarray, levels: int, bound, seed: int):
    """The nodes ``levels`` below, or single shards: (low, high, quotas)."""
    if high - low == 1 or not levels:
        yield low, high, quotas
        return
    middle = (low + high) // 2
    left = left_part(quotas, bound(middle) - bound(low), np.random.default_rng([seed, low, high]))
    yield from split_node(low, middle, left, levels - 1, bound, seed)
    yield from split_node(middle, high, quotas - left, levels - 1, bound, seed)


def split(quotas: DataFrame, blocks: int, shards: int, seed: str) -> DataFrame:
    """``shard, no, draws`` from ``no, draws``: the parts of all shards, each with its exact number of blocks.

    Of ``blocks`` in all, shard k gets those from k * blocks // shards to the next such bound.
    """
    number = int.from_bytes(seed.encode(), "little")

    def bound(shard: int) -> int:
        return shard * blocks // shards

    def deal(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        names, found = rows["no"].to_numpy(), []
        for low, high, part in split_node(int(key[0]), int(key[1]), rows["draws"].to_numpy(), TREE_LEVELS, bound, number):
            some = part > 0
            found.append(pd.DataFrame({"low": low, "high": high, "no": names[some], "draws": part[some]}))
        return pd.concat(found)

    nodes = quotas.select(F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "no", "draws")
    widest = shards
    while widest > 1:
        nodes = nodes.groupBy("low", "high").applyInPandas(deal, "low long, high long, no long, draws long")
        widest = -(-widest // 2**TREE_LEVELS)
    return nodes.select(F.col("low").alias("shard"), "no", "draws")


def slots(made: Plan) -> DataFrame:
    """``shard, slot, no, draw``: each draw's shard, and its place there after the local shuffle."""
    settings = made.settings
    quotas = cut(made.draws.groupBy("no").agg(F.count(F.lit(1)).alias("draws"), F.sum("take").alias("words")))
    total = quotas.agg(F.sum("draws"), F.sum("words")).first()
    shards = max(1, -(-(total[1] or 0) // settings.shard_words))
    parts = cut(split(quotas.select("no", "draws"), total[0] or 0, min(shards, total[0] or 1), settings.seed))
    so_far = F.sum("draws").over(Window.partitionBy("no").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ranges = parts.withColumn("first", so_far - F.col("draws"))
    each = ranges.select("shard", "no", F.explode(F.sequence("first", F.col("first") + F.col("draws") - 1)).alias("draw"))
    local = Window.partitionBy("shard").orderBy(F.md5(F.concat_ws(":", F.lit(settings.seed), "shard", "no", "draw")))
    return each.withColumn("slot", (F.row_number().over(local) - 1).cast("long"))


# --- the mix ----------------------------------------------------------------------


def pieces(made: Plan, texts: bool = False) -> DataFrame:
    """Documents cut at the blocks of their source's stream: ``no, block, start, doc_id, first, last`` and, if asked, ``text``.

    ``first`` (included) and ``last`` (not) are places in the stream.  A piece of text has the
    white space before each of its words, not that after the last one.
    """
    size = made.settings.block_words
    rows = made.placed.filter("size > 0")
    end = F.col("start") + F.col("size")

    def piece(block: Column, words: Column | None) -> Column:
        first, last = F.greatest(F.col("start"), block * size), F.least(end, (block + 1) * size)
        text = [] if words is None else [F.array_join(F.slice(words, (first - F.col("start") + 1).cast("int"), (last - first).cast("int")), "").alias("text")]
        return F.struct(block.alias("block"), first.alias("first"), last.alias("last"), *text)

    at = F.expr(f"sequence(start div {size}, (start + size - 1) div {size})")
    if not texts:
        cuts = F.transform(at, lambda b: piece(b, None))
    else:
        cuts = let(F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0)), lambda words: F.transform(at, lambda b: piece(b, words)))
    return rows.select("no", "start", "doc_id", F.inline(cuts))


def mixture(made: Plan, texts: bool = False) -> DataFrame:
    """The mix: ``shard, slot, nth`` (order of the words), ``no`` (source), ``pass, doc_id, start``, ``first_word, n_words``
    (of the document) and, if asked, ``text``.  The plan must hold texts then."""
    # Numbers compress well: the size of a file of draws says little about what a broadcast of it would take.
    drawn = slots(made).hint("merge").join(made.draws, ["no", "draw"])
    found = drawn.hint("merge").join(pieces(made, texts), ["no", "block"])
    origin = F.col("block") * made.settings.block_words
    last = F.least(F.col("last"), origin + F.col("take"))
    found = found.filter(last > F.col("first"))
    n = (last - F.col("first")).alias("n_words")
    shown = []
    if texts:
        head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0)), F.lit(1), (last - F.col("first")).cast("int")), "")
        shown = [F.when(last < F.col("last"), head).otherwise(F.col("text")).alias("text")]
    nth = (F.col("first") - origin).alias("nth")
    return found.select("shard", "slot", nth, "no", "pass", "doc_id", "start", (F.col("first") - F.col("start")).alias("first_word"), n, *shown)


def mix_texts(docs: DataFrame, settings: Settings | None = None, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """The mix of ``docs`` as pieces of text, in shards: see ``mixture``.  Texts move twice, to their stream and to their shard.

    Null texts are empty; texts without words give no piece; a null source is the last one; null and repeated ids and
    repeated rows are documents of their own.  An empty table gives no rows; other columns are not looked at.
    """
    return mixture(plan(docs, settings or Settings(), id_col, source_col, text_col, texts=True), texts=True)


def write_shards(mix: DataFrame, path: str) -> None:
    """One folder per shard, its pieces in order."""
    ordered = mix.repartition("shard").sortWithinPartitions("shard", "slot", "nth")
    ordered.write.partitionBy("shard").parquet(path)


def mix_report(docs: DataFrame, settings: Settings | None = None, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``: words, of its source, wanted of its source,
    and taken by the mix, repeats counted.  Awkward rows are treated as by ``mix_texts``."""
    made = plan(docs, settings or Settings(), id_col, source_col, text_col)
    taken = mixture(made).groupBy("no", "start").agg(F.sum("n_words").alias("taken"))
    some = made.placed.filter("size > 0").join(taken.hint("merge"), ["no", "start"], "left")
    none = made.placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")]
    return some.select(*columns).unionByName(none.select(*columns))


def oracle(settings: Settings | None = None) -> str:
    """SQL of ``mix_report``.  Shards do not show in it: what a document gives is a matter of streams and passes."""
    s = settings or Settings()
    weights = ", ".join(str(float(w)) for w in s.weights)
    return rf"""with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as h from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as no from d group by source),
w as (select *, ([{weights}]::double[])[no % {len(s.weights)} + 1] as weight, {s.most} * source_size as cap,
             {float(s.share)}::double * (sum(source_size) over ())::double as goal from s),
r as (select *, cap / weight as reach from w),
f as (select *, (goal - (sum(cap) over (order by reach, no rows unbounded preceding) - cap)::double)
                / sum(weight) over (order by reach, no rows between current row and unbounded following) as level from r),
t as (select *, least(cap::double, weight * (select first(level order by reach, no) from f where level <= reach)) as target from f),
g as (select *, least(floor(target + 0.5)::bigint, cap) as want from t),
p as (select *, case when source_size > 0 then want // source_size else 0 end as full_passes,
             case when source_size > 0 then want % source_size else 0 end as rest from g),
b as (select no, source_size, full_passes, rest, unnest(range((source_size + {s.block_words - 1}) // {s.block_words})) as block from p),
q as (select *, unnest(range(full_passes + (rest > 0)::int)) as pass from b),
m as (select *, least({s.block_words}, source_size - block * {s.block_words}) as words,
             md5('{s.seed}:' || no || ':' || pass || ':' || block) as k from q),
n as (select *, case when pass < full_passes then words else least(words,
             rest - (sum(words) over (partition by no, pass order by k rows unbounded preceding) - words)) end as take from m),
x as (select d.*, p.no, p.source_size, p.target, row_number() over () as id,
             (sum(d.size) over (partition by p.no order by d.h rows unbounded preceding) - d.size)::bigint as start
      from d join p on d.source is not distinct from p.source),
y as (select id, no, start, start + size as stop,
             unnest(range(start // {s.block_words}, (start + size - 1) // {s.block_words} + 1)) as block from x where size > 0),
z as (select y.id, sum(greatest(0, least(stop, (y.block + 1) * {s.block_words}, y.block * {s.block_words} + n.take)
             - greatest(start, y.block * {s.block_words})))::bigint as taken
      from y join n on n.no = y.no and n.block = y.block and n.take > 0 group by y.id)
select x.doc_id, x.size::bigint as size, x.source_size, x.target, coalesce(z.taken, 0) as taken from x left join z on x.id = z.id"""


ORACLE = oracle()
