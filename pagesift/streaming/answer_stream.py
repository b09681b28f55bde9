"""The answering job over a stream of query events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagesift.operators.cache import REPLAY_TTL, STORE_TTL, carry_over, query_outcome
from pagesift.plans.answer import answers, search_and_store, stored_state
from pagesift.sources.results import ResultStore
from pagesift.sources.scratch import cut, freed
from pagesift.streaming.cache_stream import read_state, write_state


def answer_batches(store: ResultStore, candidates: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over ``events(event_id, key, us)``: writes ``path/answers/batch=<id>``.

    Runs and searches of earlier micro-batches come from the state behind them, those
    from before the stream from the store; only what neither has is searched.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"batch-{batch_id}"
        with freed(spark):
            events = cut(batch)
            carry = read_state(spark, path, batch_id)
            carry = cut(stored_state(store, events, name)) if carry is None else carry
            outcomes = cut(query_outcome(events, carry=carry))
            search_and_store(outcomes, candidates, store, name)
            answers(outcomes, carry, store).write.mode("overwrite").parquet(f"{path}/answers/batch={batch_id}")
            write_state(carry_over(outcomes, carry, STORE_TTL + REPLAY_TTL), path, batch_id)

    return run


def answer_stream(events: DataFrame, store: ResultStore, candidates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        events.writeStream.foreachBatch(answer_batches(store, candidates, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
