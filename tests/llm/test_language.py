import numpy as np
from frames import clashing, documents, rows
from pyspark.sql import functions as F

from pagesift.llm import language as L


def toy():
    return [(lang, (word * 60).encode()[:256]) for lang, word in (("x", "aab "), ("y", "zzt "), ("x", "aba "), ("y", "tzz "))] * 20


def test_gradients_are_those_of_the_loss():
    net = L.train(toy(), L.Settings(epochs=1))
    x = np.concatenate([L.windows(b, 256) for _, b in toy()[:6]])
    y = np.array([0, 1, 0, 1, 0, 1])
    loss = lambda: -np.log(L.forward(net, x)[0][np.arange(6), y]).mean()
    for p in L.parameters(net):
        p += np.random.default_rng(0).normal(0, 0.01, p.shape).astype(p.dtype)
    for p, g in zip(L.parameters(net), L.gradients(net, x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        step, keep = np.float32(1e-3), p[at]
        p[at] = keep + step
        up = loss()
        p[at] = keep - step
        down = loss()
        p[at] = keep
        assert abs((up - down) / (2 * step) - g[at]) < 0.02 * max(1, abs(g[at]))


def test_tables_give_the_network():
    net = L.train(toy(), L.Settings(widths=(1, 2, 3, 4, 5)))
    x = np.concatenate([L.windows(b, 256) for b in (b"", b"a", "é日".encode() * 200, bytes(range(256)))])
    assert np.abs(L.Predictor(net, batch=2).probabilities(x) - L.forward(net, x)[0]).max() < 1e-5


def test_awkward_texts_and_batches():
    model = L.Predictor(L.train(toy(), L.Settings()))
    texts = [None, "", " 1234 !?", "aab aab", "zzt", "aab " * 30_000, "é"]
    together = model.predict(texts)
    assert together[:3] == [("und", 0.0)] * 3
    assert [lang for lang, _ in together[3:6]] == ["x", "y", "x"] and all(0 <= s <= 1 for _, s in together)
    for text, (lang, score) in zip(texts, together, strict=True):
        alone = model.predict([text])[0]
        assert alone[0] == lang and abs(alone[1] - score) < 1e-6
    # The whole text decides: a long tail in the other language wins.
    assert model.predict(["aab " * 100 + "zzt " * 5000])[0][0] == "y"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = L.learn(docs.filter(~L.held_out(F.col("doc_id"))))
    found = L.languages(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter(L.held_out(F.col("doc_id")))
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.97


def test_held_out_is_the_stated_quarter(spark):
    import zlib

    frame = spark.range(500).unionByName(spark.createDataFrame([(None,)], "id bigint"))
    for i, held in frame.select("id", L.held_out(F.col("id"))).collect():
        assert held == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)


def test_sample_is_bounded_and_blind_to_hot_keys(spark):
    data = [(None, f"aab text {i}", "x") for i in range(300)] + [(i, "zzt " * 400, "y") for i in range(300)] + [(1, None, "y"), (2, "q", None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    found = L.sample(docs, "text", "lang", "doc_id", L.Settings(docs_per_language=5, windows_per_doc=2))
    assert sum(lang == "x" for lang, _ in found) == 1 and 5 <= sum(lang == "y" for lang, _ in found) <= 10
    assert {lang for lang, _ in found} == {"x", "y"}


def test_nothing_to_learn_from(spark):
    docs = clashing(documents(spark, ["abc", "12", None, ""]))
    assert L.learn(docs) is None and L.learn(docs.limit(0)) is None
    assert rows(L.languages(docs, None), "lang_pred") == [("und",)] * 4
    assert rows(L.keep_known_languages(docs, None), "text") == [("abc",)]


def test_filter_keeps_columns(spark):
    net = L.train(toy(), L.Settings())
    docs = clashing(documents(spark, ["aab aab", None, "5 5", "zzt"]))
    left = L.keep_known_languages(docs, net)
    assert left.columns == docs.columns and rows(left, "doc_id") == [(1,), (4,)]
    assert L.languages(docs.limit(0), net).isEmpty()
