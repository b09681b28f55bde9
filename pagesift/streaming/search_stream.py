"""Search as a stream: results are appended as they are found, and stored ranked afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagesift.functions.text import normalise_string
from pagesift.operators.cache import query_outcome
from pagesift.plans.answer import search_and_store, stored_state
from pagesift.plans.search import attach_results
from pagesift.sources.results import ResultStore
from pagesift.sources.scratch import cut, freed


def stream_search(queries: DataFrame, scored: DataFrame, *keys: str) -> DataFrame:
    """Streaming ``queries(q, keys...)`` -> scored results, unordered.

    ``scored`` is the static side (``scored_candidates``, stored once): each
    captured page is scored for its query once, however often that is asked.  The
    stream is a stateless join.
    """
    normal = queries.withColumn("query", normalise_string(F.col("q")))
    return attach_results(normal, scored, *keys)


def append_results(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Live view: arrival order, Parquet files per micro-batch."""
    return (
        results.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_back(store: ResultStore, candidates: DataFrame) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: search what is not stored at its own time, and store it ranked.

    The batch has ``q`` and ``created_at``.  The searches are those of
    ``query_outcome``, so a query that comes again after its results have expired
    is searched and stored again, and one that is stored is not searched.  A query
    without any result is stored with an empty list; a failed batch stores nothing
    and is run again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        with freed(batch.sparkSession):
            events = cut(
                batch.select(
                    F.xxhash64("q", "created_at").alias("event_id"),
                    normalise_string(F.col("q")).alias("key"),
                    F.unix_micros("created_at").alias("us"),
                ).filter("us is not null")
            )
            name = f"batch-{batch_id}"
            outcomes = cut(query_outcome(events, carry=cut(stored_state(store, events, name))))
            search_and_store(outcomes, candidates, store, name)

    return run


def store_results(queries: DataFrame, store: ResultStore, candidates: DataFrame, checkpoint: str) -> StreamingQuery:
    """Ranked view: runs ``write_back`` on every micro-batch of ``queries(q, created_at)``."""
    return (
        queries.writeStream.foreachBatch(write_back(store, candidates))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
