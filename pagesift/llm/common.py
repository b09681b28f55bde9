"""What several operators share: table access, digests, names, batch sizes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.sources.captures import spread

#: What an Arrow batch may hold; texts of a batch are in a Python worker's memory together.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of the session by rows and bytes, never raising a lower limit."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", rows),
        ("spark.sql.execution.arrow.maxBytesPerBatch", size),
    ):
        if not 0 < _number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _number(setting: str) -> int:
    """Spark's spelling of a number of bytes or rows."""
    figure = setting.lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(figure[-1:], 0)
    return int(figure.rstrip("kmgt")) << unit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return stem if stem.lower() not in taken else f"{stem}_{uuid.uuid4().hex[:8]}"


def whole(name: str) -> Column:
    """A column by its exact name (dots are part of it); a null text is an empty one."""
    return F.coalesce(column(name), F.lit(""))


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def sha256_hex(parts: Iterable[bytes] | bytes) -> str:
    if isinstance(parts, bytes):
        return hashlib.sha256(parts).hexdigest()
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()
