"""Registered queries: scans, stores and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.text import normalise_string
from pagesift.functions.urls import fill_template_uri
from pagesift.operators.ranking import RESULT_COLUMNS
from pagesift.plans import discover, render
from pagesift.plans.discovery_queries import RULES, _OUTCOME, _world
from pagesift.plans.registry import LINKS, PARTS, normal, query
from pagesift.sources import links as link_source
from pagesift.sources import results as result_source
from pagesift.sources.captures import CaptureTable, fetch
from pagesift.sources.links import LinkStore
from pagesift.sources.ndjson import ndjson as ndjson_lines
from pagesift.sources.ndjson import result_dto as to_dto
from pagesift.sources.scratch import cut, scratch_path

AS_OF = "2024-01-12 00:00:00"


def _store(spark: SparkSession, rows: DataFrame | None = None) -> LinkStore:
    store = LinkStore(spark, scratch_path(spark, "links"))
    if rows is not None:
        store.insert(rows)
    return store


def _site() -> F.Column:
    return F.regexp_extract("url", "[0-9]+", 0).cast("bigint")


@query(
    "captures_scan",
    f"""with {PARTS} select 'https://s' || site || '.example.com/find?q=' || url_encode({normal('first(p_name order by j)')}) as url,
        site as capture_id, site % 50 as elapsed_ms from p group by site""",
)
def captures_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch every link's page for its own query; what was not captured gives no row."""
    first = render.sites(spark, sf_dir)
    template = F.concat(render.site_url(F.col("site")), F.lit("/find?q={0}"))
    wanted = first.select(fill_template_uri(template, normalise_string(F.col("first_name"))).alias("url"))
    missing = first.select(F.concat(render.site_url(F.col("site")), F.lit("/nowhere")).alias("url"))
    captures = render.search_pages(spark, sf_dir)
    return fetch(wanted.unionByName(missing), captures).select("url", "capture_id", "elapsed_ms")


_ALL = "id, title, url, category, starred, search_url, selector, response_time"


@query("links_scan", f"with {LINKS} select {_ALL} from l")
def links_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, render.links(spark, sf_dir)).all()


@query("links_get", f"with {LINKS} select {_ALL} from l where url = 'https://s3.example.com'")
def links_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, render.links(spark, sf_dir))
    key = spark.range(1).select(link_source.link_id(F.lit("https://s3.example.com")).alias("id")).first()["id"]
    return store.get(key)


@query(
    "links_sorted",
    f"""with {LINKS} select 'up' as way, {_ALL} from l union all select 'down', {_ALL} from l
        union all select 'none', {_ALL} from l""",
)
def links_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three orders of the same rows; the order itself is checked in the tests."""
    store = _store(spark, render.links(spark, sf_dir))
    ways = [
        store.sorted("response_time").select(F.lit("up").alias("way"), "*"),
        store.sorted("title", descending=True).select(F.lit("down").alias("way"), "*"),
        store.sorted("").select(F.lit("none").alias("way"), "*"),
    ]
    return ways[0].unionByName(ways[1]).unionByName(ways[2])


@query("links_insert", f"with {LINKS} select {_ALL} from l")
def links_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted in two steps, by the parity of the site."""
    rows = render.links(spark, sf_dir)
    store = _store(spark, rows.filter(_site() % 2 == 0))
    store.insert(rows.filter(_site() % 2 == 1))
    return store.all()


@query(
    "links_replace",
    f"""with {LINKS} select id, case when site % 5 = 0 then 'New ' || title else title end as title, url, category,
        starred, search_url, selector, case when site % 5 = 0 then 1 else response_time end as response_time from l""",
)
def links_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth site is replaced; as many unknown ids are ignored."""
    rows = render.links(spark, sf_dir)
    store = _store(spark, rows)
    new = (
        rows.filter(_site() % 5 == 0)
        .withColumn("title", F.concat(F.lit("New "), "title"))
        .withColumn("response_time", F.lit(1).cast("bigint"))
    )
    store.replace(new.unionByName(new.withColumn("id", F.concat(F.lit("no"), "id"))))
    return store.all()


@query("links_delete", f"with {LINKS} select {_ALL} from l where site % 4 <> 1")
def links_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.links(spark, sf_dir)
    store = _store(spark, rows)
    store.delete(rows.filter(_site() % 4 == 1).select("id"))
    return store.all()


@query(
    "links_refresh",
    f"""with {_OUTCOME}
    select sha256('https://s' || site || '.example.com') as id, 'Site ' || site as title,
      'https://s' || site || '.example.com' as url, category, site % 3 = 0 as starred,
      'https://s' || site || '.example.com' || path as search_url, selector,
      ((site * 7) % 50 + (site * 7 + 3) % 50 + (site * 7 + 6) % 50 + 30) // 3 as response_time,
      count(*) over () as n_saved
    from d where reason is null""",
)
def links_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, pages = _world(spark, sf_dir)
    store = _store(spark, render.links(spark, sf_dir))
    saved = store.refresh(discover.discover(captures, pages, RULES))
    return store.all().withColumn("n_saved", F.lit(saved).cast("bigint"))


# --- stored results --------------------------------------------------------------

_STORED = f"""stored as (
      select {normal('p_name')} as query, p_partkey, p_type as title, 'https://x.example.com/' || p_partkey as result_url,
        p_brand as category, 'Shop' as website_title, 'https://x.example.com/?q={{0}}' as search_url,
        p_partkey % 2 = 0 as website_starred, p_size::int as score, null::varchar as image_url,
        case when p_size % 2 = 0 then p_name end as alt_text,
        timestamp '2024-01-01 06:00:00' + interval (length(p_name) % 11) day as created_at
      from part)"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result row per part, stored under its name; the day depends on the name."""
    part = render.table(spark, sf_dir, "part")
    return part.select(
        normalise_string(F.col("p_name")).alias("query"),
        "p_partkey",
        F.col("p_type").alias("title"),
        render.fmt("https://x.example.com/{k}", k=F.col("p_partkey")).alias("result_url"),
        F.col("p_brand").alias("category"),
        F.lit("Shop").alias("website_title"),
        F.lit("https://x.example.com/?q={0}").alias("search_url"),
        (F.col("p_partkey") % 2 == 0).alias("website_starred"),
        F.col("p_size").cast("int").alias("score"),
        F.lit(None).cast("string").alias("image_url"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("alt_text"),
        (
            F.lit("2024-01-01 06:00:00").cast("timestamp")
            + F.make_dt_interval(F.length("p_name") % 11)
        ).alias("created_at"),
    )


EARLY = "2024-01-01 00:00:00"


def _filled(spark: SparkSession, sf_dir: str) -> result_source.ResultStore:
    """A store that holds all rows of ``_stored``; the rank is the part's key."""
    store = result_source.ResultStore(spark, scratch_path(spark, "results"))
    rows = cut(_stored(spark, sf_dir).withColumn("rank", F.col("p_partkey")))
    store.put(rows.select("query", "created_at").distinct(), rows.drop("created_at"), "a")
    return store


def _rows(stored: DataFrame) -> DataFrame:
    return stored.select("query", F.col("rank").alias("p_partkey"), *RESULT_COLUMNS, "created_at")


def _stamp() -> F.Column:
    return F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")


_COLUMNS = ", ".join(RESULT_COLUMNS)
_SQL_STAMP = "strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at"


@query(
    "results_get",
    f"with {_STORED} select query, p_partkey, {_COLUMNS} from stored where query in (select {normal('p_name')} from part where p_size % 9 = 4)",
)
def results_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = render.table(spark, sf_dir, "part").filter("p_size % 9 = 4")
    asked = part.select(normalise_string(F.col("p_name")).alias("query")).distinct()
    return _rows(_filled(spark, sf_dir).get(asked, EARLY)).drop("created_at")


@query(
    "results_lookup",
    f"""with {_STORED} select query, p_partkey, {_COLUMNS} from stored where query in (
        select distinct {normal('p_name')} as name from part order by name desc limit 12)""",
)
def results_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visitor's last twelve queries, as literals that the store's Bloom filters and page indexes answer."""
    named = render.table(spark, sf_dir, "part").select(normalise_string(F.col("p_name")).alias("query")).distinct()
    asked = [r["query"] for r in named.orderBy(F.col("query").desc()).limit(12).collect()]
    return _rows(_filled(spark, sf_dir).get_few(asked, EARLY)).drop("created_at")


@query(
    "results_put",
    f"""with {_STORED} select query, {_SQL_STAMP}, count(*) as n_results, min(title) as first_title from stored
        group by query, created_at""",
)
def results_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored twice under other titles and batches: the first write of a query stays."""
    store = _filled(spark, sf_dir)
    rows = cut(_stored(spark, sf_dir).withColumn("rank", F.col("p_partkey")).withColumn("title", F.lit("again")))
    store.put(rows.select("query", "created_at").distinct(), rows.drop("created_at"), "b")
    kept = store.rows.read().groupBy("query").agg(F.min("title").alias("first_title"))
    return store.headers.read().join(kept, "query").select("query", _stamp(), "n_results", "first_title")


@query(
    "results_remove",
    f"with {_STORED} select query, p_partkey, {_COLUMNS} from stored where length(query) % 3 <> 0",
)
def results_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.remove(_stored(spark, sf_dir).filter("length(query) % 3 = 0").select("query"))
    return _rows(store.rows.read()).drop("created_at")


@query(
    "results_ttl",
    f"""with {_STORED} select query, p_partkey, {_SQL_STAMP} from stored
        where created_at > timestamp '{AS_OF}' - interval 7 day""",
)
def results_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired days are deleted, and of the day in between only live rows are served."""
    store = _filled(spark, sf_dir)
    store.expire(AS_OF)
    asked = _stored(spark, sf_dir).select("query").distinct()
    return _rows(store.get(asked, AS_OF)).select("query", "p_partkey", _stamp())


@query(
    "ndjson_sink",
    f"""with {_STORED} select '{{"title":"' || title || '","resultUrl":"' || result_url || '","category":"' || category
          || '","websiteTitle":"Shop","searchUrl":"' || search_url || '","websiteStarred":'
          || case when website_starred then 'true' else 'false' end || ',"score":' || score || ',"imageUrl":null,"altText":'
          || coalesce('"' || alt_text || '"', 'null') || '}}' as line from stored""",
)
def ndjson_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndjson_lines(_stored(spark, sf_dir))


@query("result_dto", f"with {_STORED} select {_COLUMNS} from stored")
def result_dto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_dto(_stored(spark, sf_dir).withColumn("id", F.sha2("result_url", 256)))




@query(
    "captures_bucketed",
    f"""with {PARTS} select 'https://s' || site || '.example.com/find?q=' || url_encode({normal('first(p_name order by j)')}) as url,
        site as capture_id, site % 50 as elapsed_ms from p group by site""",
)
def captures_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``captures_scan`` over a table bucketed by capture id: bodies are joined where they lie."""
    path = scratch_path(spark, "captures")
    table = CaptureTable(spark, path.rsplit("/", 1)[1].replace("-", "_"), path, 32)
    table.write(render.search_pages(spark, sf_dir))
    template = F.concat(render.site_url(F.col("site")), F.lit("/find?q={0}"))
    wanted = render.sites(spark, sf_dir).select(fill_template_uri(template, normalise_string(F.col("first_name"))).alias("url"))
    return fetch(wanted, table.read()).select("url", "capture_id", "elapsed_ms")
