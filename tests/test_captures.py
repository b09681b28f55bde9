"""Bucketed captures: bodies are joined where they lie."""

import re

import pytest
from pyspark.sql import functions as F

from pagesift.operators.ranking import dispatch_order
from pagesift.plans.search import search
from pagesift.sources.captures import CaptureTable, fetch

CARDS = "<div id=r>" + "".join(f"<div class=card><a href=/p/{i}></a><h2>thing {i}</h2></div>" for i in range(3)) + "</div>"
LINKS = (
    "id string, title string, url string, category string, starred boolean, search_url string, selector string, response_time bigint"
)


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(spark, n=60):
    made = spark.range(n).select(
        F.col("id").alias("capture_id"),
        F.format_string("https://s%d.org/find?q=%s", F.col("id") % 5, F.concat(F.lit("w"), F.expr("id div 5"))).alias("url"),
        F.lit(CARDS).alias("html"),
        (F.col("id") % 7).alias("elapsed_ms"),
    )
    return made.unionByName(made.limit(1).withColumn("capture_id", F.lit(None).cast("bigint")))


def above_scan(plan, column):
    """Operators between the root and the scan that reads ``column``, bottom-up, up to the first join."""
    lines = plan.splitlines()
    depth_of = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and re.search(rf"\b{column}#", line.split("Batched")[0]))
    depth, found = depth_of(lines[at]), []
    for line in reversed(lines[:at]):
        if depth_of(line) < depth:
            depth = depth_of(line)
            found.append(re.sub(r"^\*\(\d+\) ", "", line.lstrip(" :+-")))
            if "Join" in line:
                break
    return found


def executed(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_fetch_moves_no_body(unbroadcast, tmp_path):
    spark = unbroadcast
    table = CaptureTable(spark, "captures_fetch", f"file://{tmp_path}/it's captures", 6)
    table.write(rows(spark))
    captures = table.read()
    assert captures.filter("capture_id is null").count() == 0 and captures.count() == 60
    wanted = captures.filter("capture_id % 3 = 0").select("url")
    got = fetch(wanted, captures)
    path = above_scan(executed(got), "html")
    assert any("Join" in step for step in path) and not any("Exchange" in step or step.startswith("Sort ") for step in path), path
    assert sorted(r.capture_id for r in got.collect()) == list(range(0, 60, 3))
    # The plain table moves them.
    plain = spark.read.parquet(table.path)
    assert any("Exchange" in step for step in above_scan(executed(fetch(wanted, plain)), "html"))


def test_another_session_registers_the_folder(spark, tmp_path):
    path = f"file://{tmp_path}/captures"
    CaptureTable(spark, "captures_first", path, 4).write(rows(spark).withColumn("odd`name", F.lit(1)))
    again = CaptureTable(spark, "captures_second", path, 4).read()
    assert again.count() == 60 and "odd`name" in again.columns
    assert spark.sql("describe extended captures_second").filter("col_name = 'Num Buckets'").first()["data_type"] == "4"
    with pytest.raises(Exception):
        CaptureTable(spark, "captures_second", path, 4).write(rows(spark))


def test_search_moves_no_body(unbroadcast, tmp_path):
    spark = unbroadcast
    table = CaptureTable(spark, "captures_search", f"file://{tmp_path}/captures", 6)
    table.write(rows(spark))
    links = dispatch_order(
        spark.createDataFrame(
            [(f"i{i}", f"t{i}", f"https://s{i}.org", "c", False, f"https://s{i}.org/find?q={{0}}", "div#r > div.card", 1) for i in range(5)],
            LINKS,
        )
    )
    queries = spark.createDataFrame([("w3",), ("w7",)], "query string")
    got = search(queries, links, table.read())
    path = above_scan(executed(got), "html")
    assert any("Join" in step for step in path) and not any("Exchange" in step or step.startswith("Sort ") for step in path), path
    columns = got.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, search(queries, links, rows(spark).filter("capture_id >= 0")).select(*columns).collect()))
    assert got.count() == 2 * 5 * 3
