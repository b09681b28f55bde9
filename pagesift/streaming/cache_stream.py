"""Query outcomes over a stream of events, equal to the batch rule on any split into micro-batches.

Each micro-batch runs the batch operator with the state of the one before it.
So a key that owns a third of a micro-batch is split like in a batch job, where
keyed streaming state would send all its rows to one task.  State is one short
row per key searched within the store lifetime, written to a new folder per
micro-batch: a repeated micro-batch reads the same input state and overwrites
its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagesift.operators.cache import REPLAY_TTL, STORE_TTL, carry_over, query_outcome
from pagesift.sources.scratch import cut, delete, freed


def outcome_batches(
    path: str, replay_ttl: int = REPLAY_TTL, store_ttl: int = STORE_TTL, search_us: int = 0
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over ``events(event_id, key, us)``.

    Writes ``path/outcomes/batch=<id>`` and ``path/state/batch=<id>``.  Events
    older than the last run of their key join that run.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with freed(spark):
            carry = read_state(spark, path, batch_id)
            outcomes = cut(query_outcome(batch, replay_ttl, store_ttl, search_us, carry))
            outcomes.write.mode("overwrite").parquet(f"{path}/outcomes/batch={batch_id}")
            write_state(carry_over(outcomes, carry, store_ttl + replay_ttl + 2 * search_us), path, batch_id)

    return run


def read_state(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    return spark.read.parquet(f"{path}/state/batch={batch_id - 1}") if batch_id else None


def write_state(state: DataFrame, path: str, batch_id: int) -> None:
    """State behind a micro-batch.  The one before is kept, for a repetition; older ones go."""
    state.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
    if batch_id > 1:
        delete(state.sparkSession, f"{path}/state/batch={batch_id - 2}")


def stream_outcomes(events: DataFrame, path: str, checkpoint: str, **lifetimes: int) -> StreamingQuery:
    return (
        events.writeStream.foreachBatch(outcome_batches(path, **lifetimes))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
