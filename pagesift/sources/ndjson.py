"""Results as newline-delimited JSON: camelCase keys, nulls written."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.operators.ranking import RESULT_COLUMNS


def camel_case(name: str) -> str:
    return re.sub(r"_(\w)", lambda m: m.group(1).upper(), name)


def json_line(*columns: str) -> Column:
    fields = [F.col(c).alias(camel_case(c)) for c in columns or RESULT_COLUMNS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def result_dto(results: DataFrame) -> DataFrame:
    """The nine result fields, without the id."""
    return results.select(*RESULT_COLUMNS)


def ndjson(results: DataFrame) -> DataFrame:
    return results.select(json_line().alias("line"))


def write_ndjson(results: DataFrame, path: str) -> None:
    ndjson(results).withColumnRenamed("line", "value").write.text(path)
