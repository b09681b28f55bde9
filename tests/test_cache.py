import random

import pytest

from pagesift.operators.cache import carry_over, query_outcome, replay, single_flight
from pagesift.streaming.cache_stream import stream_outcomes

SCHEMA = "event_id bigint, key string, us bigint"


def brute(events, ttl, store_ttl, search=0):
    out, state = {}, {}
    for key, us, i in sorted((k, u, i) for i, k, u in events):
        run = state.get(key)
        if run and us < run[0] + ttl + search:
            out[i] = (run[0], run[2], "replay")
            continue
        fresh = not run or us >= run[1] + store_ttl + search
        state[key] = (us, us if fresh else run[1], i)
        out[i] = (us, i, "search" if fresh else "store")
    return out


def made(seed, span, keys, n=300):
    rnd = random.Random(seed)
    return [(i, rnd.choice(keys), rnd.randrange(span)) for i in range(n)]


def rows(df):
    return {r.event_id: (r.start_us, r.start_id, r.outcome) for r in df.collect()}


@pytest.mark.parametrize("span, keys, search", [(60, "aaab", 0), (3000, "aaab", 2), (1500, "abcdefgh", 0)])
def test_outcomes_equal_the_sequential_rule(spark, span, keys, search):
    events = made(span, span, keys)
    got = query_outcome(spark.createDataFrame(events, SCHEMA), 7, 60, search)
    assert rows(got) == brute(events, 7, 60, search)


def test_golden_times(spark):
    minute = 60_000_000
    events = [(1, "k", 0), (2, "k", 3 * minute), (3, "k", 540 * minute), (4, "k", 8 * 1440 * minute), (5, "j", minute)]
    got = rows(query_outcome(spark.createDataFrame(events, SCHEMA)))
    assert [got[i][2] for i in range(1, 6)] == ["search", "replay", "store", "search", "search"]


def test_end_of_life_is_exclusive(spark):
    events = [(1, "k", 0), (2, "k", 6), (3, "k", 7), (4, "k", 13), (5, "k", 14)]
    got = rows(single_flight(spark.createDataFrame(events, SCHEMA), 7).selectExpr("*", "'' as outcome"))
    assert [got[i][0] for i in range(1, 6)] == [0, 0, 7, 7, 14]


def test_carried_state(spark):
    events = sorted(made(3, 2000, "aab"), key=lambda e: (e[2], e[0]))
    half = next(i for i in range(150, 300) if events[i][2] != events[i - 1][2])
    first = query_outcome(spark.createDataFrame(events[:half], SCHEMA), 7, 60)
    state = carry_over(first, None, 67)
    second = query_outcome(spark.createDataFrame(events[half:], SCHEMA), 7, 60, carry=state)
    got = {i: (v[0], v[2]) for i, v in {**rows(first), **rows(second)}.items()}
    assert got == {i: (v[0], v[2]) for i, v in brute(events, 7, 60).items()}


def test_stream_equals_batch_on_any_split(spark, tmp_path):
    rnd = random.Random(5)
    events = sorted(made(9, 1200, "aab", 200), key=lambda e: (e[2], e[0]))
    cuts = sorted(i for i in rnd.sample(range(1, 200), 3) if events[i][2] != events[i - 1][2])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = None
    for lo, hi in zip([0, *cuts], [*cuts, len(events)]):
        spark.createDataFrame(events[lo:hi], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        # One run per split, restarted from its checkpoint.
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        stream_outcomes(stream, out, str(tmp_path / "cp"), replay_ttl=7, store_ttl=60).awaitTermination()
    got = spark.read.parquet(out + "/outcomes")
    assert {r.event_id: (r.start_us, r.outcome) for r in got.collect()} == {
        i: (v[0], v[2]) for i, v in brute(events, 7, 60).items()
    }


def test_replay_gives_every_reader_every_result_once(spark):
    attached = single_flight(spark.createDataFrame([(1, "k", 0), (2, "k", 3), (3, "k", 9)], SCHEMA), 7)
    results = spark.createDataFrame([("k", 0, "a"), ("k", 0, "b"), ("k", 9, "c")], "key string, start_us bigint, title string")
    got = sorted((r.event_id, r.title) for r in replay(attached, results).collect())
    assert got == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c")]
