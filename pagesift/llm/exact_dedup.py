"""Exact dedup: group by a 128-bit content hash, keep one row, compare bytes inside the groups.

Everything is DataFrame code.  A group is folded by aggregates that combine
before the shuffle, so a group that holds a third of all rows arrives as one row
per task: the count, the best row, and the smallest and the largest text.  These
two are equal exactly when all texts of the group are, which is the comparison
of bytes; no pair of rows is ever formed.  On the way back the groups' own counts
tell which are crowded, and the rows of those few are dealt into parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import column, fresh, whole
from pagesift.operators.skew import crowded_groups, spread_join
from pagesift.sources.scratch import cut

#: White space that does not count (fixed value of the contract).
SPACE = r"[\x20\x09-\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, n_points``.

    Texts are equal when they are identical without white space; a null text is
    empty.  Of equal texts the longest original (in code points), then the
    smallest id stays; a null id counts as larger than any other.  Rows that
    repeat both id and text are the same document: all of them carry the same
    decision and count in ``group_size``.  An empty table gives no rows.
    Columns other than the two named are not looked at.
    """
    norm = normalised(F.col("_text"))
    rows = docs.select(column(id_col).alias("doc_id"), whole(text_col).alias("_text")).select(
        "doc_id",
        F.length("_text").cast("long").alias("n_points"),
        norm.alias("_norm"),
    )
    hashed = rows.withColumn("_hash", hash_of(F.col("_norm")))
    # The longest text first, then the smallest id, nulls last.
    best = F.min(F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c")))

    def groups(frame: DataFrame, *keys: str) -> DataFrame:
        return frame.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("group_size"),
            best.alias("_best"),
            (F.min("_norm") == F.max("_norm")).alias("_same"),
        )

    by_hash = cut(groups(hashed, "_hash").select("_hash", "group_size", "_same", F.col("_best.c").alias("keep_id"), F.col("_best.a").alias("_a")))
    narrow = hashed.select("doc_id", "n_points", "_hash", F.sha2("_norm", 256).alias("text_sha256"))
    hot = crowded_groups(by_hash, "group_size", "_hash")
    out = decide(spread_join(narrow, by_hash.filter("_same").drop("_same"), ["_hash"], keys=hot))
    collided = by_hash.filter(~F.col("_same")).select("_hash")
    if collided.isEmpty():
        return out
    # Different texts share a hash: those few groups are keyed by the text itself.
    unequal = hashed.join(collided, "_hash", "left_semi")
    by_text = groups(unequal, "_hash", "_norm").select(
        "_hash", "_norm", "group_size", F.col("_best.c").alias("keep_id"), F.col("_best.a").alias("_a")
    )
    return out.unionByName(
        decide(unequal.join(by_text, ["_hash", "_norm"]).withColumn("text_sha256", F.sha2("_norm", 256)))
    )


def decide(joined: DataFrame) -> DataFrame:
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == -F.col("_a"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_points")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text, one.

    The decision is joined on (id, digest of the text), which has no hot value:
    equal texts differ in their ids and equal rows are few per id.
    """
    id_key, sha_key, n_key = (fresh(docs, name) for name in ("__row_id", "__row_sha", "__n"))
    stay = exact_duplicates(docs, id_col, text_col).filter("kept")
    keys = stay.select(row_key(F.col("doc_id")).alias(id_key), F.col("text_sha256").alias(sha_key), F.col("n_points").alias(n_key))
    keyed = docs.withColumns({
        id_key: row_key(column(id_col)),
        sha_key: F.sha2(normalised(whole(text_col)), 256),
        n_key: F.length(whole(text_col)).cast("long"),
    })
    once = keyed.join(keys.distinct(), [id_key, sha_key, n_key], "left_semi").dropDuplicates([id_key, sha_key, n_key])
    return once.select(*[column(c) for c in docs.columns])


def row_key(identifier: Column) -> Column:
    return F.coalesce(identifier.cast("string"), F.lit("null"))


ORACLE = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents),
g as (select norm, count(*) as group_size,
             first(doc_id order by n desc, doc_id asc nulls last) as keep_id, max(n) as most from d group by norm)
select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id and d.n = g.most as kept,
       sha256(d.norm) as text_sha256, d.n as n_points
from d join g on d.norm = g.norm"""
