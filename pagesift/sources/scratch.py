"""Stage boundaries that survive the loss of executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only for a local session."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    current = spark.sparkContext.getCheckpointDir()
    if configured is None and current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="pagesift-")
    if current is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured or current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the checkpoint folder and read it from there.

    One evaluation and no lineage, like ``checkpoint()``; but readers prune
    columns, and the planner knows the real size, so it broadcasts what is small.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_blocks = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in getattr(_blocks, "open", [])[-1:]:
        made.append(path)
    return path


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Stage tables made inside the block (by this thread) are deleted at its end; nothing may read them later."""
    _blocks.open = [*getattr(_blocks, "open", []), []]
    try:
        yield
    finally:
        for path in _blocks.open.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
