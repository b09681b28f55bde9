"""The result store: ranked results per normalised query, kept for seven days.

Stored flat, not as one nested list per query: a query that owns a third of all
results must not become one row.  A header row per stored query carries its
time and count, so that an empty result list is stored too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators.ranking import RESULT_COLUMNS
from pagesift.sources.scratch import cut
from pagesift.sources.tables import VersionedTable, is_one_of

RESULT_DDL = (
    "title string, result_url string, category string, website_title string, search_url string, "
    "website_starred boolean, score int, image_url string, alt_text string"
)
HEADER_DDL = "query string, created_at timestamp, n_results bigint, created_day date, batch string"
ROW_DDL = f"query string, rank bigint, {RESULT_DDL}, created_at timestamp, created_day date, batch string"
RESULT_TTL = "7 days"


def live(stored: DataFrame, as_of, ttl: str = RESULT_TTL) -> DataFrame:
    """Rows not expired at ``as_of`` (a timestamp, column or text; never the clock)."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return stored.filter(F.col("created_at") > now - F.expr(f"INTERVAL {ttl}"))


def stored_results(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored results of exactly these normalised queries."""
    return queries.join(stored, "query")


def put_headers(headers: DataFrame, new: DataFrame, ttl: str = RESULT_TTL) -> DataFrame:
    """``query, created_at`` of finished searches that no stored one of their query outlives."""
    known = headers.select("query", F.col("created_at").alias("known_at"))
    at = F.col("created_at")
    alive = (F.col("known_at") <= at) & (at < F.col("known_at") + F.expr(f"INTERVAL {ttl}"))
    stored = new.join(known, "query").filter(alive).select("query", "created_at")
    return new.select("query", "created_at").distinct().join(stored, ["query", "created_at"], "left_anti")


def remove_results(stored: DataFrame, queries: DataFrame) -> DataFrame:
    return stored.join(queries.select("query"), "query", "left_anti").select(*stored.columns)


class ResultStore:
    """Headers and rows, partitioned by day and write batch.

    Expired days are skipped by partition pruning.  A batch that is written
    again, as after a lost job, replaces its own partitions.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.headers = VersionedTable(spark, f"{path}/headers", HEADER_DDL, ["created_day", "batch"], "query")
        self.rows = VersionedTable(spark, f"{path}/rows", ROW_DDL, ["created_day", "batch"], "query")

    def _live(self, table: VersionedTable, as_of: str) -> DataFrame:
        first_day = F.to_date(F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {RESULT_TTL}"))
        return live(table.read().filter(F.col("created_day") >= first_day), as_of)

    def live_headers(self, as_of: str) -> DataFrame:
        return self._live(self.headers, as_of)

    def get(self, queries: DataFrame, as_of: str) -> DataFrame:
        """Live stored rows; rows without a header are not stored yet."""
        known = self.live_headers(as_of).select("query", "created_at")
        return stored_results(queries, self._live(self.rows, as_of).join(known, ["query", "created_at"], "left_semi"))

    def get_few(self, queries: list[str], as_of: str) -> DataFrame:
        """``get`` for a short list of normalised queries, as of one visitor: reads the pages that may hold them."""
        asked = is_one_of("query", queries)
        known = self.live_headers(as_of).filter(asked).select("query", "created_at")
        return self._live(self.rows, as_of).filter(asked).join(known, ["query", "created_at"], "left_semi")

    def put(self, searched: DataFrame, ranked: DataFrame, batch: str) -> None:
        """Store finished searches: ``searched(query, created_at)``, and ``ranked`` rows by query.

        A query can be searched several times in one batch, as days apart; each
        search is judged at its own time: while an earlier one of the query is
        stored and alive, it is left out.  Rows go first and headers last: a query
        counts as stored when its header is there.
        """
        first = searched.agg(F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss").alias("at")).first()["at"]
        if first is None:
            return
        known = self.live_headers(first).filter(F.col("batch") != batch)
        new = cut(put_headers(known, searched))
        named = (F.to_date("created_at").alias("created_day"), F.lit(batch).alias("batch"))
        rows = ranked.join(new, "query")
        self.rows.append(rows.select("query", "rank", *RESULT_COLUMNS, "created_at", *named))
        counts = ranked.groupBy("query").agg(F.count("*").alias("n_results"))
        headers = new.join(counts, "query", "left").fillna(0, ["n_results"])
        self.headers.append(headers.select("query", "created_at", "n_results", *named))

    def remove(self, queries: DataFrame) -> None:
        """Headers tell which partitions hold the queries; only those are written anew."""
        touched = cut(stored_results(queries.select("query").distinct(), self.headers.read()).select("created_day", "batch"))
        for table in (self.headers, self.rows):
            table.rewrite_partitions(touched, lambda rows: remove_results(rows, queries))

    def expire(self, as_of: str, ttl: str = RESULT_TTL) -> None:
        """Delete the days that ended before the lifetime of anything live at ``as_of`` began."""
        first = F.date_format(F.to_date(F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {ttl}")), "yyyy-MM-dd")
        day = self.headers.spark.range(1).select(first.alias("day")).first()["day"]
        for table in (self.headers, self.rows):
            table.drop_partitions(lambda names: names[0] < day)

    def remove_all(self) -> None:
        for table in (self.headers, self.rows):
            table.rewrite(table.spark.createDataFrame([], table.schema))
