"""Joins of many rows to few, whose keys may be crowded.

What is crowded is measured: a mergeable sketch of the join keys, one narrow pass
without a shuffle, names those that hold more than one in ``SHARE`` of the rows.
There are fewer than ``SHARE`` of them, so the list is bounded.  Only their rows are
dealt into parts, and only their partners repeated; all other keys join plainly.
A key that the sketch misses is joined right, too, only in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is crowded if it holds more than one in so many rows.
SHARE = 200
#: Parts that the rows of a crowded key are dealt into.
PARTS = 64
#: Keys that the sketch holds on to: its counts are off by a few rows in so many.
TRACKED = 1 << 14


def crowded(rows: DataFrame, *on: str) -> list[int]:
    """Digests of the crowded keys, as many as ``SHARE`` at most; null keys join nothing and do not count."""
    keys = rows.dropna(subset=list(on)).select(F.xxhash64(*on).alias("h"))
    found = keys.agg(F.expr(f"approx_top_k(h, {SHARE}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [t["item"] for t in found["top"] or [] if t["count"] * SHARE > found["n"]]


def crowded_groups(groups: DataFrame, n: str, *on: str) -> list[int]:
    """As ``crowded``, where the rows of each key are counted already: ``groups`` has a row per key, ``n`` its rows."""
    total = groups.agg(F.sum(n)).first()[0] or 0
    found = groups.filter(F.col(n) * SHARE > total).select(F.xxhash64(*on).alias("h")).collect()
    return [row["h"] for row in found]


def is_crowded(keys: list[int], *on: str) -> Column:
    return F.xxhash64(*on).isin(keys) if keys else F.lit(False)


def spread_join(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", keys: list[int] | None = None) -> DataFrame:
    """``many.join(few, on, how)`` for an inner or left join, with the rows of crowded keys in ``PARTS`` parts each.

    A row's part comes from its own content, so that a task that is run again deals
    its rows out alike.  ``many`` is read twice, so keep it cheap or cut it first,
    unless the digests of the crowded keys are known and given as ``keys``.
    """
    if keys is None:
        keys = crowded(many, *on)
    if not keys:
        return many.join(few, on, how)
    part = F.when(is_crowded(keys, *on), F.pmod(F.xxhash64(F.lit(1), *many.columns), F.lit(PARTS))).otherwise(0)
    parts = F.when(is_crowded(keys, *on), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = many.withColumn("_part", part.cast("int"))
    repeated = few.withColumn("_part", F.explode(parts))
    return dealt.join(repeated, [*on, "_part"], how).drop("_part")
