import hashlib
import re

import pytest
from frames import clashing, documents, rows
from pyspark.sql import functions as F

from pagesift.llm import exact_dedup


def brute(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((d, t or ""))
    out = []
    for norm, group in groups.items():
        keep = min(group, key=lambda g: (-len(g[1]), g[0] is None, g[0]))
        for d, t in group:
            kept = d == keep[0] and len(t) == len(keep[1])
            out.append((d, keep[0], len(group), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
TEXTS = ["a b", "ab", "a  b", "a b", None, "", " \n", "é", "é", "x" * 100_000, "x" * 100_000, "c", "c d", "cd "]


@pytest.mark.parametrize("digits", [None, 0, 1])
def test_groups_also_when_hashes_collide(spark, digits):
    docs = documents(spark, TEXTS)
    weak = {} if digits is None else {"hash_of": lambda text: F.substring(F.md5(text), 1, digits)}
    assert rows(exact_dedup.exact_duplicates(clashing(docs), **weak), *COLUMNS) == brute(enumerate(TEXTS, 1))


def test_null_and_repeated_ids(spark):
    data = [(1, "a b"), (1, "a b"), (None, "ab c"), (None, "abc"), (5, "abc"), (None, "z")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    assert rows(exact_dedup.exact_duplicates(docs), *COLUMNS) == brute(data)
    left = exact_dedup.drop_exact_duplicates(clashing(docs))
    assert left.columns == clashing(docs).columns
    assert rows(left, "doc_id", "text") == sorted([(1, "a b"), (None, "ab c"), (None, "z")], key=repr)
    assert exact_dedup.exact_duplicates(docs.limit(0)).isEmpty() and exact_dedup.drop_exact_duplicates(docs.limit(0)).isEmpty()


def test_a_crowded_group_is_dealt_into_parts(spark):
    """A third of all rows have one text, in many spellings; with a weak hash they also share it with others."""
    data = [(i, "a b c"[: 3 + i % 3] + " " * (i % 4) if i % 3 == 0 else f"text {i % 900}") for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    for weak in ({}, {"hash_of": lambda text: F.substring(F.md5(text), 1, 2)}):
        got = exact_dedup.exact_duplicates(docs, **weak)
        assert rows(got, *COLUMNS) == brute(data)
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.exact_duplicates(documents(spark, TEXTS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
