"""Scoring and ordering of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.binding import computed
from pagesift.functions.fuzzy import score_adjustment, weighted_ratio
from pagesift.functions.text import clean_title, normalise_string

RESULT_COLUMNS = [
    "title", "result_url", "category", "website_title", "search_url", "website_starred", "score", "image_url",
    "alt_text",
]

_SITES_PER_GROUP = 1000
#: Response times of one span are numbered together; the number of spans is that of time scales, not of links.
_SPAN_MS = 100


def with_ranking_score(pairs: DataFrame, query: str, title: str, name: str) -> DataFrame:
    """Adds the ranking score of two normalised texts: similarity plus adjustments."""
    q, t = F.col(query), F.col(title)
    base = pairs.withColumn("_base", weighted_ratio(q, t))
    return base.withColumn(name, F.col("_base") + score_adjustment(F.col("_base"), q, t)).drop("_base")


def title_or_slug(candidates: DataFrame) -> DataFrame:
    """Adds ``score`` and ``title``: the slug wins only when strictly better; anchor cards use their text.

    Needs ``query`` (normalised), ``raw_title``, ``slug``, ``is_anchor_card``.
    """
    texts = candidates.withColumn("_title", normalise_string(F.col("raw_title"))).withColumn(
        "_slug", normalise_string(F.col("slug"))
    )
    both = with_ranking_score(texts, "query", "_title", "_title_score")
    both = with_ranking_score(both, "query", "_slug", "_slug_score")
    slug_wins = ~F.col("is_anchor_card") & (F.col("_slug_score") > F.col("_title_score"))
    score = F.when(slug_wins, F.col("_slug_score")).otherwise(F.col("_title_score"))
    title = clean_title(F.when(slug_wins, F.col("slug")).otherwise(F.col("raw_title")))
    return both.select(*candidates.columns, computed(score.alias("score"), title.alias("title")))


def result_rows(scored: DataFrame, *keys: str) -> DataFrame:
    """The result columns, after ``keys``."""
    return scored.select(*keys, *RESULT_COLUMNS)


def _numbered(rows: DataFrame, keys: list[str], cell: list[Column], within: list[Column], name: str) -> DataFrame:
    """0-based position of each row per ``keys`` in the order (cell, within), as ``name``.

    No task ever sorts a whole key: rows are counted per cell, the counts are
    summed up over the cells of a key, and only the rows of one cell are
    numbered together.  ``rows`` is read twice: pass a stored or checkpointed
    table.
    """
    names = [f"_cell{i}" for i in range(len(cell))]
    cells = rows.withColumns(dict(zip(names, cell)))
    counts = cells.groupBy(*keys, *names).agg(F.count("*").alias("_n"))
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*within)) - 1
    # Keys and cells can be null: such rows are one cell like any other, before all known values.
    both = [*keys, *names]
    offsets = offsets.select(*[F.col(c).alias(f"_at_{c}") for c in both], "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in both])
    return (
        cells.withColumn("_inside", inside)
        .join(offsets, same)
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .select(*rows.columns, name)
    )


def dispatch_order(links: DataFrame) -> DataFrame:
    """Adds ``link_ord``: 0-based rank by mean response time, fastest first, unknown times last, then id.

    Ids are hash texts, so their first two characters cut equal response times
    into even cells.  Cells are summed up inside each response time, and those
    once more inside spans of ``_SPAN_MS``, so that no task sees all cells.
    """
    cell = [F.col("response_time").isNull(), F.col("response_time"), F.substring("id", 1, 2)]
    span = F.floor(F.col("response_time") / _SPAN_MS)
    keyed = links.withColumns({"_unknown": F.col("response_time").isNull(), "_span": span})
    within = _numbered(keyed, ["_unknown", "_span"], cell, [F.col("id")], "_inside_span")
    spans = keyed.groupBy("_unknown", "_span").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_unknown", "_span").rowsBetween(Window.unboundedPreceding, -1)
    first = spans.select(
        F.col("_unknown").alias("_u"), F.col("_span").alias("_s"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first")
    )
    same = F.col("_unknown").eqNullSafe(F.col("_u")) & F.col("_span").eqNullSafe(F.col("_s"))
    out = within.join(first, same).withColumn("link_ord", (F.col("_first") + F.col("_inside_span")).cast("bigint"))
    return out.select(*links.columns, "link_ord")


def rank_results(results: DataFrame, key: str = "query") -> DataFrame:
    """Adds ``rank`` per query: score descending, then site order, then card order.

    One query may own a third of all results; a cell holds at most the cards
    of 1000 sites with one score.  Null queries are one query; null scores come
    last, null site orders first.
    """
    cell = [F.col("score").isNull(), -F.col("score"), F.expr(f"link_ord div {_SITES_PER_GROUP}")]
    numbered = _numbered(results, [key], cell, [F.col("link_ord"), F.col("card_ord")], "rank")
    return numbered.withColumn("rank", F.col("rank") + 1)


def order_results(results: DataFrame, key: str = "query") -> DataFrame:
    """The same order as a sorted table: a range sort splits a hot query over many tasks."""
    return results.orderBy(key, F.desc("score"), "link_ord", "card_ord")
