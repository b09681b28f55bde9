"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Documents are reduced to one number each and aggregated by it before anything is
shuffled.  With ``docs_from`` (documents of at least that length) and
``tokens_below`` (tokens of all shorter documents) at each length, every context
limit ``L`` is answered exactly: what is left when texts are cut to ``L`` tokens is
``tokens_below + L * docs_from`` at the next length that is not below ``L``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.llm.common import bounded_batches, column
from pagesift.sources.scratch import cut

#: Lengths are summed in blocks of this many, then over blocks, so that no task sees all lengths.
BLOCK = 256


def counter(spark: SparkSession, ranks_path: str, pattern: str):
    """A function from a text column to its number of byte-pair tokens; null counts as empty."""
    import base64

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared = spark.sparkContext.broadcast((pattern, ranks))

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import tiktoken

        pat, own = shared.value
        encoding = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=own, special_tokens={})
        for batch in batches:
            yield pa.array([len(encoding.encode_ordinary(text.as_py() or "")) for text in batch], pa.int64())

    return count


def histogram(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``length, docs``: how many documents have exactly that many tokens.

    Null and empty texts have length 0.  Every row counts, repeated ones too; an empty
    table gives no rows; columns other than the text are not looked at.
    """
    bounded_batches(docs.sparkSession)
    count = counter(docs.sparkSession, ranks_path, pattern)
    return docs.select(count(column(text_col)).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("docs"))


def with_suffix_sums(lengths: DataFrame) -> DataFrame:
    """``length, docs`` and for each length: ``docs_from, tokens_from`` (this length and longer),
    ``docs_below, tokens_below`` (shorter), ``truncated_tokens`` (all texts cut to this length)."""
    marked = lengths.select(
        "length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block")
    )
    blocks = marked.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"),
        F.sum("d").over(every).alias("all_docs"),
        F.sum("t").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("length").desc())
    full = marked.join(before, "block").select(
        "length",
        "docs",
        (F.sum("docs").over(inside) + F.col("d")).alias("docs_from"),
        (F.sum("tokens").over(inside) + F.col("t")).alias("tokens_from"),
        "all_docs",
        "all_tokens",
    )
    below = F.col("all_tokens") - F.col("tokens_from")
    return full.select(
        "length",
        "docs",
        "docs_from",
        "tokens_from",
        (F.col("all_docs") - F.col("docs_from")).alias("docs_below"),
        below.alias("tokens_below"),
        (below + F.col("length") * F.col("docs_from")).alias("truncated_tokens"),
    )


def length_table(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The histogram with its suffix sums; texts are encoded once."""
    return with_suffix_sums(cut(histogram(docs, ranks_path, pattern, text_col)))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, docs_cut, tokens`` for context limits: documents longer than the limit, tokens left when cut to it."""
    asked = F.explode(F.array(*[F.lit(x).cast("bigint") for x in limits])).alias("limit")
    at = sums.select(asked, "length", "docs", "docs_from", "tokens_below")
    # Of the lengths beyond the limit the least has the sums; if there is none, nothing is cut.
    beyond = F.col("length") > F.col("limit")
    least = F.min(F.when(beyond, F.struct("length", "docs_from", "tokens_below")))
    found = at.groupBy("limit").agg(least.alias("x"), F.sum(F.col("length") * F.col("docs")).alias("total"))
    return found.select(
        "limit",
        F.coalesce(F.col("x.docs_from"), F.lit(0)).alias("docs_cut"),
        F.coalesce(F.col("x.tokens_below") + F.col("limit") * F.col("x.docs_from"), F.col("total")).alias("tokens"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the least length that at least this share of the documents does not exceed."""
    asked = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    reached = (F.col("docs_below") + F.col("docs")) >= F.col("share") * (F.col("docs_below") + F.col("docs_from"))
    return sums.select(asked, "*").filter(reached).groupBy("share").agg(F.min("length").alias("length"))
