"""Crowded keys are found, dealt into parts, and joined like all others."""

import random

from pyspark.sql import functions as F
from test_cache import SCHEMA, brute, rows

from pagesift.operators import cache, skew


def burst(n=9000, seed=4):
    """A third of all events is one query within one lifetime of 5000."""
    rnd = random.Random(seed)
    events = [("hot", 300_000 + rnd.randrange(5000)) for _ in range(n // 3)]
    events += [(f"k{rnd.randrange(2000)}", rnd.randrange(600_000)) for _ in range(n - n // 3)]
    return [(i, k, us) for i, (k, us) in enumerate(events)]


def test_crowded_keys_are_named(spark):
    frame = spark.createDataFrame(burst(), SCHEMA).union(spark.createDataFrame([(-i, None, i) for i in range(1, 3000)], SCHEMA))
    found = skew.crowded(frame, "key")
    assert found == [r.h for r in spark.range(1).select(F.xxhash64(F.lit("hot")).alias("h")).collect()]
    assert skew.crowded(frame.limit(0), "key") == []


def test_spread_join_equals_the_plain_one(spark):
    many = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 700}") for i in range(6000)] + [(-1, None)], "event_id long, key string")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k2", 3), ("k4", None), ("none", 4), (None, 5)], "key string, x int")
    counted = skew.crowded_groups(many.dropna().groupBy("key").agg(F.count(F.lit(1)).alias("n")), "n", "key")
    assert counted == skew.crowded(many, "key") and skew.crowded_groups(many.limit(0).groupBy("key").count(), "count", "key") == []
    for how, keys in (("inner", None), ("left", None), ("inner", counted)):
        got = skew.spread_join(many, few, ["key"], how, keys)
        want = many.join(few, ["key"], how)
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    parts = many.filter("key = 'hot'").select(F.pmod(F.xxhash64(F.lit(1), "event_id", "key"), F.lit(skew.PARTS)).alias("p"))
    sizes = [r["count"] for r in parts.groupBy("p").count().collect()]
    assert len(sizes) == skew.PARTS and max(sizes) < 3 * 3000 / skew.PARTS


def test_a_burst_is_cut_into_cells(spark):
    ticks = spark.createDataFrame(burst(), SCHEMA).select("key", "us").distinct()
    both = ticks.select("key", F.col("us").alias("at")).union(ticks.select("key", F.col("us") + 5000))
    cells = cache._in_cells(both, cache._quantiles(ticks, 5000), 5000).filter("key = 'hot'")
    sizes = [r["count"] for r in cells.groupBy("b", "s").count().collect()]
    assert len(sizes) >= cache.CELLS and max(sizes) < 3 * sum(sizes) / cache.CELLS


def test_a_burst_follows_the_sequential_rule(spark):
    events = burst()
    got = cache.query_outcome(spark.createDataFrame(events, SCHEMA), 5000, 100_000)
    assert rows(got) == brute(events, 5000, 100_000)
