"""Versioned Parquet tables: readers see the last complete version, never a half-written one."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from pagesift.sources.scratch import cut

_PAGE_ROWS = 1_000  # rows per page of a table with a looked-up column
_PUSHED = 10  # values of one IN that Parquet's filters take one by one, by Spark's default; more become a range


def is_one_of(column: str, values: list) -> Column:
    """``column`` is one of a short list of values, in a form that Parquet's filters can test value by value."""
    chunks = [values[i : i + _PUSHED] for i in range(0, len(values), _PUSHED)]
    tests = [F.col(column).isin(chunk) for chunk in chunks] or [F.lit(False)]
    while len(tests) > 1:  # pairwise, so that a long list is no deep expression
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) - len(tests) % 2 :]
    return tests[0]


class VersionedTable:
    """``path/v=<n>`` folders.  A version exists once its ``_SUCCESS`` marker does.

    An append adds files to the current version; a rewrite writes the next
    version in full and becomes visible when it commits.

    ``looked_up`` names a column that single values are asked of: files are
    sorted by it, in short pages, and carry Bloom filters of it, so that a
    pushed-down equality (``is_one_of``) reads a few pages.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, partition_by: list[str] | None = None, looked_up: str | None = None
    ) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.partition_by = partition_by or []
        self.looked_up = looked_up

    def _glob(self, pattern: str) -> list:
        """Hadoop paths below the table's folder, and the file system they are in."""
        root = self._path(self.path)
        self._fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath() for s in self._fs.globStatus(self._path(f"{self.path}/{pattern}")) or []]

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _version(self) -> int:
        """Highest committed version, 0 when there is none."""
        return max((int(p.getParent().getName()[2:]) for p in self._glob("v=*/_SUCCESS")), default=0)

    def _folder(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def read(self) -> DataFrame:
        version = self._version()
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(version))

    def append(self, rows: DataFrame) -> None:
        """Add rows to the current version.

        A partitioned table replaces the partitions that occur in ``rows``, so
        writing the same batch twice does not double it.
        """
        if not self._version():
            self.rewrite(self.spark.createDataFrame([], self.schema))
        rows = self._ordered(rows)
        if self.partition_by:
            # One partition's rows meet in few tasks, so few files; a large partition is split again.
            rows = rows.hint("rebalance", *self.partition_by)
        out = self._writer(rows)
        folder = self._folder(self._version())
        if self.partition_by:
            out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
        else:
            out.mode("append").parquet(folder)

    def _writer(self, rows: DataFrame) -> DataFrameWriter:
        if self.looked_up is None:
            return rows.write.partitionBy(*self.partition_by)
        options = {
            f"parquet.bloom.filter.enabled#{self.looked_up}": "true",
            "parquet.bloom.filter.adaptive.enabled": "true",
            "parquet.page.row.count.limit": str(_PAGE_ROWS),
        }
        inside = rows.sortWithinPartitions(*self.partition_by, self.looked_up)
        return inside.write.partitionBy(*self.partition_by).options(**options)

    def _ordered(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.spark.createDataFrame([], self.schema).columns)

    def rewrite(self, rows: DataFrame) -> None:
        self._writer(self._ordered(rows)).mode("overwrite").parquet(self._folder(self._version() + 1))

    def partitions(self) -> dict[tuple[str, ...], object]:
        """Values of the partition columns, as text, and the folder of each partition."""
        found = {}
        for folder in self._glob("/".join([f"v={self._version()}", *[f"{c}=*" for c in self.partition_by]])):
            names, at = [], folder
            for _ in self.partition_by:
                names.insert(0, unquote(at.getName().split("=", 1)[1]))
                at = at.getParent()
            found[tuple(names)] = folder
        return found

    def drop_partitions(self, gone: Callable[[tuple[str, ...]], bool]) -> None:
        """Delete the folders of the partitions whose values satisfy ``gone``; no row is read."""
        for names, folder in self.partitions().items():
            if gone(names):
                self._fs.delete(folder, True)

    def rewrite_partitions(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the partitions named in ``touched`` (the partition columns) by ``change`` of their rows.

        The names, one short row per partition, pass through the driver; rows of
        other partitions are neither read nor written.
        """
        names = touched.select(*self.partition_by).distinct()
        listed = {tuple(map(str, r)) for r in names.collect()}
        if not listed:
            return
        first = self.partition_by[0]
        pruned = self.read().filter(F.col(first).cast("string").isin(sorted({n[0] for n in listed})))
        kept = cut(change(pruned.join(names, self.partition_by, "left_semi")))
        self.append(kept)
        left = {tuple(map(str, r)) for r in kept.select(*self.partition_by).distinct().collect()}
        self.drop_partitions(lambda p: p in listed - left)
