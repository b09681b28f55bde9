"""From raw documents to token ids, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the
one before has kept; all but the last return the columns of ``documents``.  ``run``
writes each result as Parquet into the shared folder and reads it back.

1. language: documents without a letter are rejected (the network is trained on the stage's input);
2. exact dedup: of texts that are equal without white space the longest stays;
3. SimHash near-dedup: of each component of near copies the smallest id stays;
4. decontamination: documents in which a window of a benchmark item occurs go;
5. encoding: ids of each remaining text, with begin and end ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import decontaminate, exact_dedup, language, pieces, simhash
from pagesift.llm.common import table
from pagesift.llm.queries import tokenizer
from pagesift.sources.scratch import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in some language stay; null texts and texts without a letter go.

    Without a labelled text there is nothing to learn from: then the letters alone decide.
    """
    labelled = docs.filter(~language.held_out(F.col("doc_id")))
    net = language.learn(labelled)
    return language.keep_known_languages(docs, net)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens``; ids as little-endian unsigned 32-bit integers."""
    encoded = pieces.encode_documents(docs, tokenizer("piece_bpe_32k.model"))
    return encoded.withColumn("n_tokens", pieces.token_count(F.col("ids")))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("decontamination", drop_benchmark),
    ("encoding", encode),
]

#: SQL has neither the network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
