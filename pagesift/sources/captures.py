"""Page captures: the table that stands for fetching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Session setting: deal rows out to so many tasks before CPU-heavy work, whatever their number.
SPREAD = "spark.pagesift.spreadPartitions"


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` as they are, or dealt out anew when the session's ``SPREAD`` says to how many tasks.

    Only whoever starts the job knows whether its files make enough splits; the
    plan depends on the setting, never on the data.
    """
    wanted = rows.sparkSession.conf.get(SPREAD, None)
    return rows.repartition(int(wanted)) if wanted else rows


#: Rows that a task of ``dealt`` takes at most, about, where each of them becomes a page.
DEALT_ROWS = 10_000


def dealt(rows: DataFrame, most: int = DEALT_ROWS) -> DataFrame:
    """Narrow ``rows`` that costly texts are made of, dealt out evenly: a task for each core at least, and more for many rows.

    Files split by bytes and row groups, so a million narrow rows may be one task, and so
    would be all the parsing above.  Where ``SPREAD`` is set, the pages are dealt out by that.
    """
    spark = rows.sparkSession
    if spark.conf.get(SPREAD, None):
        return rows
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // most)))


def read_captures(
    spark: SparkSession, path: str, capture_id: str = "capture_id", elapsed_ms: str | None = "elapsed_ms"
) -> DataFrame:
    """``captures(capture_id, url, html, elapsed_ms)`` from Parquet.

    ``elapsed_ms`` names the column, if there is one.
    """
    raw = spark.read.parquet(path)
    elapsed = F.col(elapsed_ms).cast("bigint") if elapsed_ms else F.lit(None).cast("bigint")
    return raw.select(F.col(capture_id).alias("capture_id"), "url", "html", elapsed.alias("elapsed_ms"))


#: Rows of one bucketed table come sorted by capture id, when each bucket is one file.
_SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class CaptureTable:
    """Captures bucketed by ``capture_id`` and sorted inside, so that bodies are joined where they lie.

    ``search``, ``fetch`` and discovery match URLs on narrow columns, then join
    bodies by capture id.  Over this table that join shuffles the wanted ids
    only: no exchange, and on one file per bucket no sort, above the body scan.
    The table is known to the session's catalog as ``name``; a session whose
    catalog does not know it registers the folder.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int) -> None:
        self.spark = spark
        self.name = name
        self.path = path.rstrip("/")
        self.buckets = buckets

    def write(self, captures: DataFrame) -> None:
        """Write the table once, ``captures(capture_id, url, html, elapsed_ms)``; an existing one is an error.

        One task writes one bucket, so ``buckets`` is chosen by size (1 GB of
        bodies each, say).  A capture without an id cannot be asked for: no
        join would ever read it, and all of them would be one bucket, so it is
        not written.  Other columns stay.
        """
        (
            captures.filter(F.col("capture_id").isNotNull())
            .repartition(self.buckets, "capture_id")
            .write.bucketBy(self.buckets, "capture_id")
            .sortBy("capture_id")
            .option("path", self.path)
            .saveAsTable(self.name)
        )

    def read(self) -> DataFrame:
        """The captures.  The session is set to use the order inside buckets, which holds for one file per bucket."""
        self.spark.conf.set(_SORTED_BUCKETS, "true")
        if not self.spark.catalog.tableExists(self.name):
            schema = self.spark.read.parquet(self.path).schema
            columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(
                f"CREATE TABLE {self.name} ({columns}) USING parquet "
                f"CLUSTERED BY (capture_id) SORTED BY (capture_id) INTO {self.buckets} BUCKETS LOCATION {_literal(self.path)}"
            )
        return self.spark.table(self.name)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def latest(captures: DataFrame) -> DataFrame:
    """``url, capture_id``: of the captures of one URL the one with the largest id, as crawls number them.

    A combining aggregate over two narrow columns: a URL that was crawled very
    often arrives as one row per task, and no body is read.
    """
    return captures.groupBy("url").agg(F.max("capture_id").alias("capture_id"))


def locate(wanted: DataFrame, captures: DataFrame, url: str = "url") -> DataFrame:
    """``wanted`` with ``capture_id`` of the latest capture of its URL; what was not captured gives no row."""
    asked = wanted.select(F.col(url).alias("_url")).distinct()
    matched = latest(captures.join(asked, F.col("url") == F.col("_url"), "left_semi").select("url", "capture_id"))
    return wanted.join(matched.withColumnRenamed("url", "_captured"), wanted[url] == F.col("_captured")).drop("_captured")


def fetch(wanted: DataFrame, captures: DataFrame, url: str = "url") -> DataFrame:
    """Fetch = equi-join of the wanted URL to the captured one.  No capture, no row.

    A URL that was captured several times gives its latest capture.  URLs are
    matched on narrow columns first; bodies come in by capture id, and only
    those that are wanted.
    """
    return locate(wanted, captures, url).join(captures.drop("url"), "capture_id")
