import re

from pyspark.sql import functions as F

from pagesift.plans import render, stream_queries

EVENTS = "event_id bigint, key string, us bigint"


def test_keyed_events_are_written_once(spark, tmp_path):
    made = spark.range(25_000).select(
        F.col("id").alias("event_id"),
        F.lit("Click").alias("event_type"),
        F.format_string('{"k": %d}', F.col("id") % 7).alias("props"),
        F.timestamp_micros("id").alias("ts"),
    )
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    events = stream_queries._events(spark, str(tmp_path))
    assert events.count() == 25_000
    # Many readers follow: they must find the texts made, and in more than one split.
    assert len(events.inputFiles()) > 1 and all(re.search("/cut-", f) for f in events.inputFiles())


def test_a_micro_batch_has_several_files_of_its_own_time(spark, monkeypatch):
    monkeypatch.setattr(stream_queries, "_FILE_EVENTS", 100, raising=False)
    # Nearly all events are early: later ranges hold fewer rows than files, and one holds none.
    times = [(i, "a", i) for i in range(1000)] + [(1000, "a", 5000), (1001, None, 8000), (1002, "b", None)]
    seen = {}

    def run(batch, batch_id):
        seen[batch_id] = [tuple(r) for r in batch.select("us", F.input_file_name()).collect()]

    stream = stream_queries._in_files(spark.createDataFrame(times, EVENTS), 4)
    stream.writeStream.foreachBatch(run).trigger(availableNow=True).start().awaitTermination()
    spans = {n: sorted(us for us, _ in rows) for n, rows in seen.items()}
    assert spans == {0: list(range(1000)), 1: [], 2: [5000], 3: [8000]}
    assert len({file for _, file in seen[0]}) == 3


def test_cards_are_made_in_many_tasks(spark, tmp_path):
    made = spark.range(4000).select(
        F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit("c").alias("p_brand"),
        F.lit("d").alias("p_type"), F.lit(1).alias("p_size"),
    )
    made.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks = render.parts(spark, str(tmp_path), for_cards=True).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == spark.sparkContext.defaultParallelism
