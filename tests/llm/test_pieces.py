import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from frames import clashing, documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesift.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = [None, "", " ", "  ", "a  b", " a", "a ", "▁x ▁▁y", "x▁y", "\n\n a\tb", "é　 ½ <0x41> <s> </s>", "日本 語😀 a", "a" * 50_000,
         "\0 a\0", "word " * 20_000, "a b", "a b"]


def library(text):
    return [SP.bos_id(), *SP.encode(text or ""), SP.eos_id()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" ▁abcé\n\t1<>日😀") | st.characters(codec="utf-8"), max_size=40), max_size=8))
def test_table_gives_the_ids_of_the_library(texts):
    table = pieces.WordTable(SP, words=20, chars=100)  # so small that it starts anew all the time
    for text in texts:
        assert table.encode(text).tolist() == library(text)


def test_documents(spark):
    docs = clashing(documents(spark, TEXTS, 0))
    for r in pieces.encode_documents(docs, MODEL, decode=True).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == library(TEXTS[r.doc_id])
        assert r.decoded == SP.decode(ids)
    assert pieces.encode_documents(docs.limit(0), MODEL).isEmpty()


def test_decoder(spark):
    ids = pieces.encode_documents(documents(spark, TEXTS, 0), MODEL)
    decode = pieces.decoder(spark, MODEL)
    for r in ids.select("doc_id", decode("ids").alias("t")).collect():
        assert r.t == SP.decode(library(TEXTS[r.doc_id]))


def test_whole_table(spark):
    from pagesift.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    want = []
    for d, text in [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]:
        ids = library(text)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((d, len(ids), digest, hashlib.sha256(SP.decode(ids).encode()).hexdigest()))
    got = QUERIES["op10_pieces"](spark, sf)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(pieces.model_bytes(MODEL))
    model.pieces[500].piece = "a▁b"
    path = tmp_path / "crossing.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="cross"):
        pieces.model_bytes(str(path))
