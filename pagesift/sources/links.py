"""The link store: one row per discovered site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.sources.tables import VersionedTable

LINK_DDL = (
    "id string, title string, url string, category string, starred boolean, search_url string, selector string, "
    "response_time bigint"
)
LINK_COLUMNS = [
    "id", "title", "url", "category", "starred", "search_url", "selector", "response_time",
]


def link_id(url: Column) -> Column:
    return F.sha2(url, 256)


def get_link(links: DataFrame, link_id: str) -> DataFrame:
    """The link with that id: at most one row."""
    return links.filter(F.col("id") == link_id).limit(1)


def sorted_links(links: DataFrame, field: str = "", descending: bool = False) -> DataFrame:
    """All links by a named field, then id; a blank name leaves them unsorted."""
    if not field.strip():
        return links
    if field not in links.columns:
        raise ValueError(f"unknown link field: {field}")
    by = F.col(field).desc() if descending else F.col(field).asc()
    return links.orderBy(by, "id")


def insert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.unionByName(new)


def replace_links(links: DataFrame, updates: DataFrame) -> DataFrame:
    """Each link whose id is in ``updates`` takes the new values; other ids in ``updates`` are ignored.

    ``updates`` has one row per id.
    """
    fields = [c for c in links.columns if c != "id"]
    new = updates.select("id", F.struct(*fields).alias("_new"))
    chosen = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    return links.join(new, "id", "left").select("id", *chosen).select(*links.columns)


def delete_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    return links.join(ids.select("id"), "id", "left_anti").select(*links.columns)


class LinkStore:
    """The stored form of the functions above."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path, LINK_DDL, looked_up="id")

    def all(self) -> DataFrame:
        return self.table.read()

    def get(self, link_id: str) -> DataFrame:
        return get_link(self.all(), link_id)

    def sorted(self, field: str = "", descending: bool = False) -> DataFrame:
        return sorted_links(self.all(), field, descending)

    def insert(self, new: DataFrame) -> None:
        self.table.append(new)

    def replace(self, updates: DataFrame) -> None:
        self.table.rewrite(replace_links(self.all(), updates))

    def delete(self, ids: DataFrame) -> None:
        self.table.rewrite(delete_links(self.all(), ids))

    def delete_all(self) -> None:
        self.table.rewrite(self.table.spark.createDataFrame([], LINK_DDL))

    def refresh(self, discovered: DataFrame) -> int:
        """Replace everything by a new discovery and report its size.

        The new version is complete before it is visible, so a failed
        discovery leaves the old links in place.
        """
        self.table.rewrite(discovered)
        return self.all().count()
