"""The answering job: what is searched, served and stored, for a log and for a stream in files."""

import random

import pytest
from pyspark.sql import functions as F

from pagesift.plans import answer
from pagesift.sources.results import ResultStore
from pagesift.streaming.answer_stream import answer_stream
from pagesift.streaming.search_stream import store_results

MINUTE, DAY = 60_000_000, 86_400_000_000
START = 1_704_100_000_000_000
EVENTS = "event_id bigint, key string, us bigint"


@pytest.fixture(scope="module")
def candidates(spark):
    """Two captured pages for ``foo``, none for ``bar``."""
    from pagesift.plans.search import search_candidates

    links = spark.createDataFrame(
        [("https://a.org", "A", "Books", True, "https://a.org/?q={0}", "li", 0), ("https://b.org", "B", "Books", False, "https://b.org/?q={0}", "li", 1)],
        "url string, title string, category string, starred boolean, search_url string, selector string, link_ord bigint",
    )
    page = "<ul><li><a href='/1'>Foo</a><li><a href='/2'>Foo two</a></ul>"
    captures = spark.createDataFrame(
        [(1, "https://a.org/?q=Foo", "<p>old"), (3, "https://a.org/?q=Foo", page), (2, "https://b.org/?q=Foo", page)],
        "capture_id bigint, url string, html string",
    )
    return search_candidates(links, captures)


def brute(events, stored=()):
    """Outcome and serving search of each event, one after the other."""
    out, run, search = {}, {}, {k: us for k, us in stored}
    run.update(search)
    for key, us, i in sorted((k, u, i) for i, k, u in events):
        if key in run and us < run[key] + 5 * MINUTE:
            out[i] = ("replay", search[key])
        elif key in search and us < search[key] + 7 * DAY:
            run[key] = us
            out[i] = ("store", search[key])
        else:
            run[key] = search[key] = us
            out[i] = ("search", us)
    return out


def log(seed=1, n=120):
    rnd = random.Random(seed)
    times = [START + rnd.choice([0, 1, 4, 6, 9000, 11000, 30000]) * MINUTE + rnd.randrange(3) for _ in range(n)]
    return [(i, rnd.choice(["Foo", "Foo", "Bar"]), us) for i, us in enumerate(times)]


def got(df):
    return {r.event_id: (r.outcome, r.search_us) for r in df.collect()}


def test_log(spark, candidates, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"))
    events = log()
    found = answer.answer_log(spark.createDataFrame(events, EVENTS), candidates, store, "one")
    want = brute(events)
    assert got(found) == want
    rows = found.collect()
    assert {(r["query"], r.n_results, r.title, r.result_url) for r in rows} == {("Foo", 4, "Foo", "https://a.org/1"), ("Bar", 0, None, None)}
    searches = {(k, us) for i, k, us in events if want[i] == ("search", us)}
    assert {(r["query"], r.us) for r in store.headers.read().select("query", F.unix_micros("created_at").alias("us")).collect()} == searches
    assert answer.stored_answers(found, store).count() == 4 * sum(k == "Foo" for _, k, _ in events)
    # The same log again under the same name changes nothing.
    again = answer.answer_log(spark.createDataFrame(events, EVENTS), candidates, store, "one")
    assert got(again) == want and store.headers.read().count() == len(searches)
    # A later log is served what is stored and alive.
    later = [(1000, "Foo", max(us for k, us in searches if k == "Foo") + 2 * DAY), (1001, "Bar", START + 40 * DAY)]
    found = answer.answer_log(spark.createDataFrame(later, EVENTS), candidates, store, "two")
    assert got(found) == brute(later, {k: max(u for q, u in searches if q == k) for k in ("Foo", "Bar")}.items())
    assert got(found)[1000][0] == "store" and got(found)[1001][0] == "search"


def test_stream_in_files_equals_the_log(spark, candidates, tmp_path):
    events = sorted(log(2), key=lambda e: e[2])
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    store = ResultStore(spark, f"{path}/results")
    for lo in range(0, len(events), 40):
        part = [e for e in events[lo : lo + 40]]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    before = set((tmp_path / "out").iterdir()) if (tmp_path / "out").exists() else set()
    answer_stream(stream, store, candidates, path, str(tmp_path / "cp")).awaitTermination()
    assert got(spark.read.parquet(f"{path}/answers")) == brute(events)
    assert len(list((tmp_path / "out/state").iterdir())) == 2 and not before


def test_write_back_keeps_both_searches(spark, candidates, tmp_path):
    source = str(tmp_path / "in")
    asked = [("foo", "2024-01-01 00:00:00"), ("FOO!", "2024-01-02 00:00:00"), ("foo", "2024-01-20 00:00:00"), ("bar", "2024-01-20 00:00:00"), (None, None)]
    made = spark.createDataFrame(asked, "q string, at string").select("q", F.col("at").cast("timestamp").alias("created_at"))
    made.coalesce(1).write.parquet(source)
    store = ResultStore(spark, str(tmp_path / "results"))
    stream = spark.readStream.schema(made.schema).parquet(source)
    store_results(stream, store, candidates, str(tmp_path / "cp")).awaitTermination()
    heads = {(r["query"], str(r.created_at), r.n_results) for r in store.headers.read().collect()}
    assert heads == {("Foo", "2024-01-01 00:00:00", 4), ("Foo", "2024-01-20 00:00:00", 4), ("Bar", "2024-01-20 00:00:00", 0)}
    assert store.rows.read().count() == 8


def test_scratch_is_freed(spark):
    from pathlib import Path

    from pagesift.sources.scratch import checkpoint_root, cut, freed

    root = Path(checkpoint_root(spark).removeprefix("file://"))
    with freed(spark):
        made = cut(spark.range(5))
        assert made.count() == 5
        inside = {p for p in root.iterdir() if p.name.startswith("cut-")}
    assert len(inside - set(root.iterdir())) == 1
