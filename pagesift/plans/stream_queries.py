"""Registered queries: streams and the query cache over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.text import normalise_string
from pagesift.operators import cache, ranking
from pagesift.plans import render
from pagesift.plans.registry import normal, query
from pagesift.plans.answer import answer_log as run_answer_log
from pagesift.plans.search import scored_candidates, search_candidates, search_from_candidates
from pagesift.plans.search_queries import _COLUMNS, RANKED
from pagesift.sources.captures import dealt, spread
from pagesift.sources.results import ResultStore, live
from pagesift.sources.scratch import cut, scratch_path
from pagesift.streaming.answer_stream import answer_stream as run_answer_stream
from pagesift.streaming.cache_stream import stream_outcomes
from pagesift.streaming.search_stream import append_results, store_results
from pagesift.streaming.search_stream import stream_search as run_stream_search

# --- the event log as a query log ----------------------------------------------

_EVENTS = f"""e as (
      select event_id, ts, {normal("event_type || ' ' || json_extract_string(props, '$.k')")} as key,
        row_number() over (partition by event_type || ' ' || json_extract_string(props, '$.k') order by ts, event_id) as rn
      from events),
    r as (
      select event_id, ts, key, rn, ts as start_ts, event_id as start_id, ts as search_ts, 'search' as outcome
      from e where rn = 1
      union all
      select e.event_id, e.ts, e.key, e.rn,
        case when e.ts >= r.start_ts + interval 5 minute then e.ts else r.start_ts end,
        case when e.ts >= r.start_ts + interval 5 minute then e.event_id else r.start_id end,
        case when e.ts >= r.start_ts + interval 5 minute and e.ts >= r.search_ts + interval 7 day then e.ts
             else r.search_ts end,
        case when e.ts < r.start_ts + interval 5 minute then 'replay'
             when e.ts >= r.search_ts + interval 7 day then 'search' else 'store' end
      from r join e on e.key = r.key and e.rn = r.rn + 1)"""


def _keyed(events: DataFrame) -> DataFrame:
    """events(event_id, key, us) of a batch or stream read of the event table."""
    q = F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select("event_id", normalise_string(q).alias("key"), us.alias("us"))


def _dealt_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return dealt(spread(render.table(spark, sf_dir, "events").select(*columns)), render.TEXT_ROWS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed events, written once: a key is text from JSON, and every reader below takes the events several times."""
    return cut(_keyed(_dealt_events(spark, sf_dir, "event_id", "event_type", "props", "ts")))


#: Events in one file of a micro-batch, about.
_FILE_EVENTS = 250_000


def _in_files(events: DataFrame, batches: int) -> DataFrame:
    """Events as a stream in time order: each micro-batch has the same number of files, more than one for many events."""
    spark, path = events.sparkSession, scratch_path(events.sparkSession, "events")
    span = events.agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count("*").alias("n")).first()
    files = max(1, -(-span["n"] // (batches * _FILE_EVENTS)))
    nothing = spark.createDataFrame([], events.schema).coalesce(1)
    for n in range(batches):
        lo, hi = (span["a"] + (span["b"] + 1 - span["a"]) * k // batches for k in (n, n + 1))
        # One range after the other, so that the stream finds the files in order of time.
        some = events.filter((F.col("us") >= lo) & (F.col("us") < hi))
        (some.repartition(files) if files > 1 else some.coalesce(1)).write.mode("append").parquet(path)
        # A task without rows writes no file, and a micro-batch must not take files of the next range.
        for _ in range(files * (n + 1) - _files_in(spark, path)):
            nothing.write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def _files_in(spark: SparkSession, path: str) -> int:
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    return len(pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or [])


@query("single_flight", f"with recursive {_EVENTS} select event_id, start_id from r")
def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.single_flight(_events(spark, sf_dir)).select("event_id", "start_id")


@query(
    "replay_ttl",
    f"""with recursive {_EVENTS} select key, start_id, count(*) as n_events,
        epoch_us(max(ts)) - epoch_us(min(ts)) as spread_us from r group by all""",
)
def replay_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs: each lives five minutes from its start."""
    runs = cache.single_flight(_events(spark, sf_dir))
    return runs.groupBy("key", "start_id").agg(
        F.count("*").alias("n_events"), (F.max("us") - F.min("us")).alias("spread_us")
    )


@query("query_outcome", f"with recursive {_EVENTS} select event_id, start_id, outcome from r")
def query_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.query_outcome(_events(spark, sf_dir)).select("event_id", "start_id", "outcome")


@query("query_outcome_stream", f"with recursive {_EVENTS} select event_id, start_id, outcome from r")
def query_outcome_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "outcomes")
    stream_outcomes(_in_files(_events(spark, sf_dir), 4), path, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/outcomes").select("event_id", "start_id", "outcome")


@query(
    "replay",
    f"""with recursive {_EVENTS}
        select event_id, rank::int as rank, key || ' / ' || rank as title from r, (values (1), (2), (3)) as t(rank)""",
)
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event gets the three results of the run it shares, each once."""
    attached = cut(cache.single_flight(_events(spark, sf_dir)))
    found = attached.select("key", "start_us").distinct()
    title = F.concat("key", F.lit(" / "), F.col("rank").cast("string"))
    found = found.withColumn("rank", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("title", title)
    return cache.replay(attached, found).select("event_id", "rank", "title")


# --- search over a stream of queries -----------------------------------------------


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = ranking.dispatch_order(render.links(spark, sf_dir))
    return cut(search_candidates(links, render.search_pages(spark, sf_dir)))


def _query_stream(spark: SparkSession, sf_dir: str, files: int = 2) -> DataFrame:
    """The part names as a stream of query texts, several files read one by one."""
    path = scratch_path(spark, "queries")
    names = render.table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    made = names.select(
        F.concat(F.lit(" "), F.upper("p_name"), F.lit("!")).alias("q"),
        (F.lit("2024-01-10 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("k"))).alias("created_at"),
        "k",
    )
    # Upper-case text normalises to the lower-case name, title-cased.
    made.repartition(files, "k").drop("k").write.parquet(path)
    schema = "q string, created_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_search", f"with {RANKED} select query, {_COLUMNS} from ranked")
def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "stream")
    results = run_stream_search(_query_stream(spark, sf_dir), cut(scored_candidates(_candidates(spark, sf_dir))))
    append_results(results, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return ranking.result_rows(spark.read.parquet(f"{out}/data"), "query")


def _write_back(spark: SparkSession, sf_dir: str, candidates: DataFrame) -> ResultStore:
    store = ResultStore(spark, scratch_path(spark, "results"))
    checkpoint = scratch_path(spark, "checkpoint")
    store_results(_query_stream(spark, sf_dir), store, candidates, checkpoint).awaitTermination()
    return store


@query(
    "write_back",
    f"""with {RANKED}, asked as (select distinct {normal('p_name')} as query from part)
        select a.query, n_results, rank, {_COLUMNS} from (
          select query, count(rank) as n_results from asked left join ranked using (query) group by query) a
        left join ranked on ranked.query = a.query""".replace(f"rank, {_COLUMNS}", "rank, " + ", ".join(f"ranked.{c}" for c in ranking.RESULT_COLUMNS)),
)
def write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored headers with their ranked rows; a query without results keeps a header."""
    store = _write_back(spark, sf_dir, _candidates(spark, sf_dir))
    rows = store.rows.read().select("query", "rank", *ranking.RESULT_COLUMNS)
    return store.headers.read().select("query", "n_results").join(rows, "query", "left")


@query(
    "arrival_then_ranked",
    f"""with {RANKED} select 'live' as view, query, null::bigint as rank, result_url, score from ranked
        union all select 'stored', query, rank, result_url, score from ranked""",
)
def arrival_then_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live readers see the append stream; later readers the stored, ranked rows."""
    candidates = _candidates(spark, sf_dir)
    out = scratch_path(spark, "stream")
    live_rows = run_stream_search(_query_stream(spark, sf_dir), cut(scored_candidates(candidates)))
    append_results(live_rows, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    stored = _write_back(spark, sf_dir, candidates).rows.read()
    first = spark.read.parquet(f"{out}/data").select(
        F.lit("live").alias("view"), "query", F.lit(None).cast("bigint").alias("rank"), "result_url", "score"
    )
    return first.unionByName(stored.select(F.lit("stored").alias("view"), "query", "rank", "result_url", "score"))


@query(
    "read_through",
    f"""with {RANKED} select case when length(query) % 2 = 0 then 'store' else 'search' end as source, query, result_url,
        case when length(query) % 2 = 0 then 'stored ' || title else title end as title, score from ranked""",
)
def read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored and live results are served; all other queries are searched.

    Stored here: queries of even length, under marked titles, and - expired, so
    not served - all queries under other titles.
    """
    candidates = _candidates(spark, sf_dir)
    asked = render.queries(spark, sf_dir)
    found = cut(search_from_candidates(asked, candidates))

    def saved(rows: DataFrame, mark: str, at: str) -> DataFrame:
        return rows.withColumn("title", F.concat(F.lit(mark), "title")).withColumn(
            "created_at", F.lit(at).cast("timestamp")
        )

    fresh = saved(found.filter("length(query) % 2 = 0"), "stored ", "2024-01-10 00:00:00")
    stale = saved(found, "expired ", "2024-01-01 00:00:00")
    served, missed = cache.read_through(asked, live(fresh.unionByName(stale), "2024-01-12 00:00:00"))
    new = search_from_candidates(missed, candidates)
    columns = ["source", "query", "result_url", "title", "score"]
    return (
        served.withColumn("source", F.lit("store"))
        .select(*columns)
        .unionByName(new.withColumn("source", F.lit("search")).select(*columns))
    )


# --- the answering job ---------------------------------------------------------------

# The event log again, with the name of part k as the query.
_ASKED = _EVENTS.replace(normal("event_type || ' ' || json_extract_string(props, '$.k')"), normal("p_name")).replace(
    "partition by event_type || ' ' || json_extract_string(props, '$.k')", "partition by p_name"
).replace("from events)", "from events join part on p_partkey = json_extract_string(props, '$.k')::bigint)")
_ANSWERS = f"""with recursive {_ASKED}, {RANKED},
    n as (select query, count(*) as n_results from ranked group by query)
  select event_id, key as query, outcome, epoch_us(search_ts) as search_us, coalesce(n_results, 0) as n_results, title, result_url
  from r left join n on n.query = key left join (select * from ranked where rank = 1) b on b.query = key"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events(event_id, key, us): every event asks for the part whose key it carries."""
    events = _dealt_events(spark, sf_dir, "event_id", "props", "ts")
    k = F.get_json_object("props", "$.k").cast("bigint")
    parts = dealt(render.table(spark, sf_dir, "part").select("p_partkey", "p_name"), render.TEXT_ROWS)
    names = parts.select("p_partkey", normalise_string(F.col("p_name")).alias("key"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.join(names, k == F.col("p_partkey")).select("event_id", "key", us.alias("us"))


@query("answer_log", _ANSWERS)
def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of events: shared runs, stored results, searches again after seven days."""
    store = ResultStore(spark, scratch_path(spark, "results"))
    return run_answer_log(_asked(spark, sf_dir), _candidates(spark, sf_dir), store, "log")


@query("answer_stream", _ANSWERS)
def answer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a stream of four files give the same answers."""
    path = scratch_path(spark, "answers")
    store = ResultStore(spark, f"{path}/results")
    events = _in_files(cut(_asked(spark, sf_dir)), 4)
    run_answer_stream(events, store, _candidates(spark, sf_dir), path, f"{path}/checkpoint").awaitTermination()
    columns = ["event_id", "query", "outcome", "search_us", "n_results", "title", "result_url"]
    return spark.read.parquet(f"{path}/answers").select(*columns)
