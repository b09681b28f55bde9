import base64

import public_tokenizers as P
import tiktoken
from frames import clashing, documents, rows

from pagesift.llm import token_counts as T

PATH = P.path("byte_bpe_50k.tiktoken")


def lengths(texts):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [len(encoding.encode_ordinary(t or "")) for t in texts]


def brute(found):
    out = []
    for n in sorted(set(found)):
        less, rest = [x for x in found if x < n], [x for x in found if x >= n]
        out.append((n, found.count(n), len(rest), sum(rest), len(less), sum(less), sum(min(x, n) for x in found)))
    return sorted(out, key=repr)


def test_sums_quantiles_and_limits(spark):
    texts = [None, "", "a", "a", "<|endoftext|>", "é" * 40, "word " * 3000, "x" * 20_000, " ", "\n\n"] + ["some words here " * i for i in range(60)]
    table = T.length_table(clashing(documents(spark, texts)), PATH, P.PATTERN)
    found = lengths(texts)
    assert rows(table) == brute(found)
    limits = [0, 1, 2, 50, 64, 1000, 10**6]
    want = [(n, sum(x > n for x in found), sum(min(x, n) for x in found)) for n in limits]
    assert rows(T.truncated_totals(table, limits)) == sorted(want, key=repr)
    shares = [0.01, 0.25, 0.5, 0.9, 1.0]
    ordered = sorted(found)
    want = [(q, min(n for n in ordered if sum(x <= n for x in ordered) >= q * len(ordered))) for q in shares]
    assert rows(T.quantiles(table, shares)) == sorted(want, key=repr)


def test_empty_and_whole_table(spark):
    docs = documents(spark, ["a"])
    assert T.length_table(docs.limit(0), PATH, P.PATTERN).isEmpty()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(T.length_table(docs, PATH, P.PATTERN)) == brute(lengths([r.text for r in docs.collect()]))
