import json
import uuid

import pytest
from pyspark.sql import functions as F

from pagesift.operators.ranking import RESULT_COLUMNS
from pagesift.sources.links import LINK_DDL, LinkStore, sorted_links
from pagesift.sources.ndjson import write_ndjson
from pagesift.sources.results import RESULT_DDL, ResultStore


def link(i, ms=None, title="t"):
    return (f"id{i}", title, f"u{i}", "c", False, "s", "x > y", ms)


@pytest.fixture
def store(spark, tmp_path):
    made = LinkStore(spark, str(tmp_path / "links"))
    made.insert(spark.createDataFrame([link(1, 30), link(2, 10), link(3, None), link(4, 10)], LINK_DDL))
    return made


def ids(df):
    return [r.id for r in df.collect()]


def test_link_orders(store):
    assert ids(store.sorted("response_time")) == ["id3", "id2", "id4", "id1"]
    assert ids(store.sorted("response_time", descending=True)) == ["id1", "id2", "id4", "id3"]
    assert sorted(ids(store.sorted(" "))) == ["id1", "id2", "id3", "id4"]
    with pytest.raises(ValueError):
        sorted_links(store.all(), "nope")


def test_link_changes(spark, store):
    store.insert(spark.createDataFrame([link(5, 1)], LINK_DDL))
    assert len(ids(store.all())) == 5
    store.replace(spark.createDataFrame([link(2, 99, None), link(9, 1)], LINK_DDL))
    changed = store.get("id2").first()
    assert (changed.title, changed.response_time) == (None, 99)
    assert store.get("id9").count() == 0
    store.delete(spark.createDataFrame([("id1",), ("id7",)], "id string"))
    assert sorted(ids(store.all())) == ["id2", "id3", "id4", "id5"]
    assert store.refresh(spark.createDataFrame([link(8, 1)], LINK_DDL)) == 1
    assert ids(store.all()) == ["id8"]
    store.delete_all()
    assert ids(store.all()) == []


def test_failed_refresh_keeps_the_old_links(spark, store):
    bad = spark.createDataFrame([link(1, 1)], LINK_DDL).withColumn("title", F.raise_error(F.lit("down")))
    with pytest.raises(Exception):
        store.refresh(bad)
    assert len(ids(store.all())) == 4


def result(query, rank, title):
    return (query, rank, title, "u", "c", "w", "s", True, 5, None, None)


def test_results_are_written_once_while_they_live(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"))
    schema = "query string, rank bigint, " + RESULT_DDL

    def put(at, title, batch, *queries):
        searched = spark.createDataFrame([(q, at) for q in queries], "query string, at string").select(
            "query", F.col("at").cast("timestamp").alias("created_at")
        )
        rows = spark.createDataFrame([result(q, 1, title) for q in queries if q != "empty"], schema)
        store.put(searched, rows, batch)

    def titles(at):
        asked = spark.createDataFrame([("a",), ("b",), ("empty",)], "query string")
        return {r.query: r.title for r in store.get(asked, at).collect()}

    put("2024-01-01 12:00:00", "first", "1", "a", "empty")
    put("2024-01-01 12:00:00", "first", "1", "a", "empty")  # the same batch again
    put("2024-01-02 12:00:00", "second", "2", "a", "b")
    assert titles("2024-01-02 13:00:00") == {"a": "first", "b": "second"}
    assert {r.query: r.n_results for r in store.live_headers("2024-01-02 13:00:00").collect()} == {
        "a": 1, "empty": 0, "b": 1,
    }
    # Seven days after it was stored, "a" may be written again.
    assert titles("2024-01-08 12:00:00") == {"b": "second"}
    put("2024-01-08 12:00:01", "third", "3", "a", "b")
    assert titles("2024-01-08 12:00:02") == {"a": "third", "b": "second"}
    store.remove(spark.createDataFrame([("a",)], "query string"))
    assert titles("2024-01-08 12:00:02") == {"b": "second"}
    store.remove_all()
    assert titles("2024-01-08 12:00:02") == {}


def test_upkeep_touches_only_what_it_must(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"))
    schema = "query string, rank bigint, " + RESULT_DDL
    for day, names in (("01", "ab"), ("02", "cd"), ("05", "ae")):
        at = f"2024-01-{day} 12:00:00"
        searched = spark.createDataFrame([(q,) for q in names], "query string").withColumn("created_at", F.lit(at).cast("timestamp"))
        store.put(searched, spark.createDataFrame([result(q, 1, day) for q in names], schema), f"b {day}/x")

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "results").rglob("part-*")}

    before = files()
    store.remove(spark.createDataFrame([("a",), ("b",), ("zz",)], "query string"))
    assert {r["query"] for r in store.rows.read().collect()} == {"c", "d", "e"} == {r["query"] for r in store.headers.read().collect()}
    same = {p for p in files() if before.get(p) == files()[p]}
    assert {p for p in before if "created_day=2024-01-02" in str(p)} <= same
    assert not any("created_day=2024-01-01" in str(p) for p in files())
    store.expire("2024-01-10 11:00:00")
    assert {r["query"] for r in store.rows.read().collect()} == {"e"}
    assert not any("created_day=2024-01-02" in str(p) for p in files())
    store.remove(spark.createDataFrame([("nothing",)], "query string"))
    assert [r.n_results for r in store.headers.read().collect()] == [1]


def test_day_partitions_prune(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"))
    at = "2024-01-05 12:00:00"
    searched = spark.createDataFrame([("a",)], "query string").withColumn("created_at", F.lit(at).cast("timestamp"))
    store.put(searched, spark.createDataFrame([result("a", 1, "t")], "query string, rank bigint, " + RESULT_DDL), "1")
    plan = store._live(store.rows, at)._jdf.queryExecution().executedPlan().toString()
    assert "created_day" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_ndjson(spark, tmp_path):
    rows = spark.createDataFrame([("q", 1, *result("q", 1, 'T "x" é')[2:])], "query string, rank bigint, " + RESULT_DDL)
    write_ndjson(rows.select(*RESULT_COLUMNS), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 1
    assert list(json.loads(lines[0]).items()) == [
        ("title", 'T "x" é'), ("resultUrl", "u"), ("category", "c"), ("websiteTitle", "w"), ("searchUrl", "s"),
        ("websiteStarred", True), ("score", 5), ("imageUrl", None), ("altText", None),
    ]


def read_rows(spark, run):
    """Result of ``run()`` and the rows that its scans gave, from the tasks' input metrics."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "lookup")
    got = run()
    spark.sparkContext.setJobGroup("other", "other")
    tracker, status = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return got, sum(status.lastStageAttempt(s).inputRecords() for s in stages)


def test_ten_queries_read_a_small_part_of_the_store(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"))
    n = 300_000
    queries = spark.range(n).select(F.sha2(F.col("id").cast("string"), 224).alias("query"))
    searched = queries.withColumn("created_at", F.lit("2024-01-01 12:00:00").cast("timestamp"))
    ranked = queries.select("query", F.lit(1).cast("bigint").alias("rank"), *[F.lit(None).cast(t).alias(c) for c, t in
        ((f.name, f.dataType) for f in spark.createDataFrame([], RESULT_DDL).schema)])
    store.put(searched, ranked, "1")
    asked = [r["query"] for r in queries.limit(10).collect()]
    at = "2024-01-02 12:00:00"
    got, read = read_rows(spark, lambda: store.get_few(asked, at).collect())
    assert sorted(r["query"] for r in got) == sorted(asked)
    assert 20 <= read < 0.05 * 2 * n, read
    # Nothing under these names: Bloom filters leave out whole files although the names lie inside their ranges.
    absent = ["8" + q[1:] + "x" for q in asked]
    got, none = read_rows(spark, lambda: store.get_few(absent, at).collect())
    assert got == [] and none == 0, none
    many = [r["query"] for r in queries.limit(95).collect()]
    found, some = read_rows(spark, lambda: store.get_few(many, at).collect())
    assert len(found) == 95 and some < 0.5 * 2 * n, some
    assert store.get_few([], at).count() == 0
