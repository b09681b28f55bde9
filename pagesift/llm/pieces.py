"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary holds a white-space marker after another character
(checked when the model is loaded), so a piece never crosses the start of a
marked word and the library's merges inside a word do not depend on its
neighbours.  Each batch is cut into marked words, each distinct word is segmented
once by the library, and the ids are put back by position with array indexing.

The table lives in the task: it holds the words of the batches so far and starts
anew when it is full.  A table shared by all tasks would have to move every
position of every word through a shuffle, several times the volume of the texts,
to save segmenting frequent words once per task.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import bounded_batches, column

MARK = "▁"
#: Bounds of a task's table.
TABLE_WORDS = 200_000
TABLE_CHARS = 16 << 20


def model_bytes(path: str) -> bytes:
    """The model file; it must be one whose pieces stay inside marked words.

    Asked for: no normalisation, a leading marker that is added, white space kept
    as it is, byte fallback or not, and no piece with a marker after another
    character.  Anything else is a ``ValueError``.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        data = f.read()
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(data)
    rule = model.normalizer_spec
    own = any(p.type == sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces)
    crossing = any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)
    if (
        rule.precompiled_charsmap
        or rule.remove_extra_whitespaces
        or not rule.add_dummy_prefix
        or not rule.escape_whitespaces
        or model.trainer_spec.treat_whitespace_as_suffix
        or own
        or crossing
    ):
        raise ValueError("the pieces of this model can cross marked words")
    sentencepiece.SentencePieceProcessor(model_proto=data)
    return data


class WordTable(dict):
    """Marked word -> its number; unseen words get the next number and wait to be segmented."""

    def __init__(self, processor, words: int = TABLE_WORDS, chars: int = TABLE_CHARS) -> None:
        super().__init__()
        self.processor = processor
        self.most_words, self.most_chars = words, chars
        self.marker = [processor.piece_to_id(MARK)]
        self.start()

    def start(self) -> None:
        self.clear()
        self.chars = 0
        self.waiting: list[str] = []
        self.flat = array("I")
        self.starts, self.lengths = array("q"), array("q")

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.waiting.append(word)
        self.chars += len(word)
        return number

    def _segment(self) -> None:
        # A marked word is " " + rest; the library adds that first marker itself, but not to an empty text.
        for word, ids in zip(self.waiting, self.processor.encode([w[1:] for w in self.waiting], num_threads=1), strict=True):
            ids = ids if len(word) > 1 else self.marker
            self.starts.append(len(self.flat))
            self.lengths.append(len(ids))
            self.flat.extend(ids)
        self.waiting = []

    def encode(self, text: str) -> np.ndarray:
        """All ids of one text, begin and end ids included."""
        first, last = self.processor.bos_id(), self.processor.eos_id()
        if not text:
            return np.array([first, last], "<u4")
        if len(self) > self.most_words or self.chars > self.most_chars:
            self.start()
        at = np.array(list(map(self.__getitem__, marked_words(text))), np.int64)
        if self.waiting:
            self._segment()
        lengths = np.frombuffer(self.lengths, np.int64)[at]
        starts = np.frombuffer(self.starts, np.int64)[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        where = np.arange(total) + np.repeat(starts - ends + lengths, lengths)
        out = np.empty(total + 2, "<u4")
        out[0], out[-1] = first, last
        out[1:-1] = np.frombuffer(self.flat, np.uint32)[where]
        return out


def marked_words(text: str) -> list[str]:
    """``text`` behind one more space, cut before each run of spaces; markers count as spaces."""
    spaced = text.replace(MARK, " ") if MARK in text else text
    if "  " in spaced or spaced[0] == " ":
        return re.findall(" +[^ ]*", " " + spaced)
    return [" " + w for w in spaced.split(" ")]


def _processor(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model.value)


def encoder(spark: SparkSession, model_path: str, decode: bool = False):
    """A function from a text column to ``struct<ids binary>``, and ``decoded string`` if asked for.

    ``ids``: little-endian unsigned 32-bit integers with begin and end ids.  A null
    text is an empty one: begin and end id only, decoded to an empty text.
    ``decoded`` is what the library's ``decode`` makes of exactly these ids.
    """
    model = spark.sparkContext.broadcast(model_bytes(model_path))
    kind = "struct<ids: binary, decoded: string>" if decode else "struct<ids: binary>"

    @F.arrow_udf(kind)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        processor = _processor(model)
        words = WordTable(processor)
        for batch in batches:
            ids, texts = [], []
            for value in batch:
                found = words.encode(value.as_py() or "")
                ids.append(found.tobytes())
                if decode:
                    texts.append(processor.decode(found.tolist()))
            columns = {"ids": pa.array(ids, pa.binary())}
            if decode:
                columns["decoded"] = pa.array(texts, pa.string())
            yield pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return encode


def decoder(spark: SparkSession, model_path: str):
    """A function from an ``ids`` column to its text; null gives null."""
    model = spark.sparkContext.broadcast(model_bytes(model_path))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        processor = _processor(model)
        for batch in batches:
            values = (v.as_py() for v in batch)
            yield pa.array(
                [None if v is None else processor.decode(np.frombuffer(v, "<u4").tolist()) for v in values], pa.string()
            )

    return decode


def token_count(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4)


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False
) -> DataFrame:
    """One row per document: ``doc_id, ids`` and, with ``decode``, ``decoded``; see ``encoder``.

    Rows are mapped one by one: repeated rows give repeated results, an empty table
    none, ids may be null, other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    encode = encoder(docs.sparkSession, model_path, decode)
    out = docs.select(column(id_col).alias("doc_id"), encode(column(text_col)).alias("e"))
    return out.select("doc_id", "e.*")
