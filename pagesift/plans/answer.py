"""Answering a query log: shared runs, stored results, searches for what is missing, ranked write-back.

What is searched and what is served is decided at each event's own time, for a
whole log at once or for the micro-batches of a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.operators import cache
from pagesift.operators.ranking import rank_results
from pagesift.operators.skew import spread_join
from pagesift.plans.search import search_from_candidates
from pagesift.sources.results import ResultStore
from pagesift.sources.scratch import cut


def stored_state(store: ResultStore, events: DataFrame, but: str | None = None) -> DataFrame:
    """``key, start_us, search_us`` of the queries that are stored and alive when the first of ``events`` comes.

    ``but`` names a batch whose own headers do not count, as when it is repeated.
    """
    first = events.agg(F.date_format(F.timestamp_micros(F.min("us")), "yyyy-MM-dd HH:mm:ss").alias("at")).first()["at"]
    alive = store.live_headers(first) if first else store.headers.read()
    known = alive.filter(F.col("batch") != but) if but else alive
    at = F.unix_micros(F.max("created_at"))
    return known.groupBy(F.col("query").alias("key")).agg(at.alias("start_us"), at.alias("search_us"))


def search_and_store(outcomes: DataFrame, candidates: DataFrame, store: ResultStore, batch: str) -> None:
    """Search the queries whose events are searches, each text once, and store them ranked under each time."""
    searched = cut(
        outcomes.filter("outcome = 'search'").select(
            F.col("key").alias("query"), F.timestamp_micros("start_us").alias("created_at")
        ).distinct()
    )
    found = cut(search_from_candidates(searched.select("query").distinct(), candidates))
    store.put(searched, rank_results(found), batch)


def answers(outcomes: DataFrame, carry: DataFrame | None, store: ResultStore) -> DataFrame:
    """One row per event: ``event_id, query, outcome, search_us, n_results, title, result_url``.

    ``search_us`` is the search whose results are served; its first result stands
    for all of them, which ``stored_answers`` gives.
    """
    runs = cache.serving_searches(outcomes, carry)
    at = F.unix_micros("created_at").alias("search_us")
    heads = store.headers.read().select(F.col("query").alias("key"), at, "n_results")
    best = store.rows.read().filter("rank = 1").select(F.col("query").alias("key"), at, "title", "result_url")
    served = runs.join(heads, ["key", "search_us"], "left").join(best, ["key", "search_us"], "left")
    return spread_join(outcomes, served, ["key", "start_us"]).select(
        "event_id", F.col("key").alias("query"), "outcome", "search_us", "n_results", "title", "result_url"
    )


def stored_answers(answered: DataFrame, store: ResultStore) -> DataFrame:
    """Every event with all results that it is served: as many rows as readers have results, so keep it lazy."""
    rows = store.rows.read().withColumn("search_us", F.unix_micros("created_at"))
    return answered.select("event_id", "query", "search_us").join(rows, ["query", "search_us"])


def answer_log(events: DataFrame, candidates: DataFrame, store: ResultStore, batch: str) -> DataFrame:
    """Answer ``events(event_id, key, us)``, ``key`` a normalised query; what had to be searched is stored.

    Results stored before the log count while they live.  A log that is answered
    again under the same ``batch`` gives the same.
    """
    events = cut(events)
    carry = cut(stored_state(store, events, batch))
    outcomes = cut(cache.query_outcome(events, carry=carry))
    search_and_store(outcomes, candidates, store, batch)
    return answers(outcomes, carry, store)
