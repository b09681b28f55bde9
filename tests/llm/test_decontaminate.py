import hashlib
import random
import re

from frames import clashing, documents, rows
from pyspark.sql import functions as F

from pagesift.llm import decontaminate as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [(m[0], m.start(), m.end()) for m in WORD.finditer((text or "").translate(LOWER))]


def brute(docs, items, window=10):
    wins = {}
    for i, text in items:
        own = [w for w, *_ in words(text)]
        size = min(window, len(own))
        for p in range(len(own) - size + 1 if size and i is not None else 0):
            wins.setdefault(tuple(own[p : p + size]), set()).add(str(i))
    sizes = {len(w) for w in wins}
    out = []
    for d, text in docs:
        own = words(text)
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(own) - n + 1):
                if names := wins.get(tuple(w for w, *_ in own[p : p + n])):
                    found |= names
                    hit |= set(range(p, p + n))
        spans = []
        for k in sorted(hit):
            if k - 1 in hit:
                spans[-1] = (spans[-1][0], own[k][2])
            else:
                spans.append((own[k][1], own[k][2]))
        out.append((d, len(own), len(hit), len(found), sorted(found), spans, bool(hit)))
    return sorted(out, key=repr)


def check(docs, benchmark, **options):
    got = rows(D.contamination(docs, benchmark, **options))
    got = sorted(((*r[:5], [tuple(s) for s in r[5]], r[6]) for r in got), key=repr)
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got == brute(pairs, [tuple(r) for r in benchmark.select("item_id", "text").collect()], options.get("window", 10))
    return got


def test_small_windows_in_one_and_in_several_blocks(spark):
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice(["a", "B", "ß", "é1", "x9"]) + rng.choice([" ", ", ", "\n", "_", "\0"]) for _ in range(n))
    texts = [line(rng.randint(0, 40)) for _ in range(150)] + [None, "", "?!", "a " * 30_000]
    items = [(i, line(rng.randint(0, 12))) for i in range(25)] + [(None, "a b"), (90, None), (91, ""), (92, "B"), (3, "a a")]
    docs = clashing(documents(spark, texts))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    one = check(docs, benchmark, window=3)
    assert check(docs, benchmark, window=3, block_bytes=100) == one
    assert any(r[6] for r in one) and not all(r[6] for r in one)
    check(docs, benchmark)
    left = D.drop_contaminated(docs, benchmark, window=3)
    assert left.columns == docs.columns and rows(left, "doc_id") == sorted([(r[0],) for r in one if not r[6]], key=repr)


def test_empty_tables_and_null_ids(spark):
    docs = documents(spark, ["a b c", "a b c"]).withColumn("doc_id", F.lit(None).cast("bigint"))
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r[6] for r in check(docs, none)] == [False, False]
    some = spark.createDataFrame([(1, "b c")], "item_id bigint, text string")
    assert [r[6] for r in check(docs, some)] == [True, True]
    assert check(docs.limit(0), some) == []


def test_digest_of_query(spark):
    from pagesift.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = [(d, w, h, n, hashlib.sha256(",".join(i).encode()).hexdigest(), c) for d, w, h, n, i, _, c in brute(docs, items)]
    found = QUERIES["op9_decontaminate"](spark, sf)
    assert rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
