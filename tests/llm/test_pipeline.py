import numpy as np
import public_tokenizers
import sentencepiece
from frames import clashing, rows
from test_decontaminate import brute as hits
from test_exact_dedup import brute as exact
from test_simhash import brute as near

import corpus_pipeline as C

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"


def expected(docs, items):
    docs = [(d, t) for d, t in docs if any(map(str.isalpha, t or ""))]
    kept = {(d, s) for d, _, _, k, s in exact(docs) if k}
    staying = {d for d, _ in kept}
    docs = [(d, t) for d, t in docs if d in staying]
    docs = [(d, t) for d, t in docs if d in {x[0] for x in near(docs) if x[0] == x[2]}]
    clean = {x[0] for x in hits(docs, items) if not x[6]}
    return {d: [1, *SP.encode(t), 2] for d, t in docs if d in clean}


def test_run(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in C.run(spark, SF).collect()}
    assert got == expected(docs, items) and 0 < len(got) < len(docs)


def test_stages_on_awkward_rows(spark):
    """Every stage takes whatever comes, keeps clean rows and the columns of its input."""
    texts = [None, "", " 12 ", "clean text one", "clean text one", "clean  text one", "another clean document", "é", "x" * 100_000]
    data = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "no id here", None, None, None), (3, "clean text one", None, None, None)]
    docs = clashing(spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).isEmpty()
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
    assert rows(docs, "doc_id") == sorted([(5,), (6,), (7,), (8,), (None,)], key=repr)
    assert C.encode(spark, docs, SF).count() == 5 and C.encode(spark, docs.limit(0), SF).isEmpty()
