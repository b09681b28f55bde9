"""SimHash near-dedup with Golay-code keys.

Fingerprints that differ in at most three of 64 bits are linked.  The bits are
cut into segments of 23, 23 and 18; three errors leave at most one error in each
of at least two segments (pigeonhole: two segments with two errors each would
make four).  A segment of 23 bits lies within distance three of exactly one word
of the perfect binary Golay code.  Its *home* index is that word's; its *near*
indices are the homes of the segment and of all its neighbours at distance one
(six at most, for a neighbour decodes to the same word unless the segment is at
distance three from it).  So two fingerprints at distance three or less share,
for some pair of segments, the home indices of one and near indices of the other:
three home keys per fingerprint meet its near keys (at most 108) in an equi-join,
and a popcount verifies each candidate.

Only distinct fingerprints take part: copies collapse in a combining aggregate
before anything is joined.  At the end the rows of a fingerprint that many documents
share are dealt into parts before they meet its component.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import bounded_batches, column, fresh, whole
from pagesift.llm.components import components
from pagesift.operators.skew import crowded_groups, spread_join
from pagesift.sources.scratch import cut

SHINGLE_WORDS = 3
SEED = 42
#: First bit and width of each segment of a fingerprint.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GOLAY = 0b110001110101
MOST_BITS = 3


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; no words give zero."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: Column) -> Column:
    """The fingerprint's 64 bits as a signed integer; a null text has no words."""
    return F.arrow_udf(_fingerprints, "bigint")(text)


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        found = [fingerprint(text.as_py() or "") for text in batch]
        yield pa.array(np.array(found, np.uint64).view(np.int64))


def remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator: their syndrome, 11 bits."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GOLAY << (bit - 11), 0)
    return words


@functools.cache
def homes() -> np.ndarray:
    """For each of the 2**23 words the index of the code word within distance three."""
    bits = 1 << np.arange(23, dtype=np.int32)
    errors = [np.zeros(1, np.int32), bits]
    pairs = np.array([a | b for i, a in enumerate(bits) for b in bits[:i]], np.int32)
    triples = np.array([a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]], np.int32)
    errors = np.concatenate([*errors, pairs, triples])
    leader = np.empty(1 << 11, np.int32)
    leader[remainder(errors)] = errors  # perfect: each syndrome has one error pattern
    table = np.empty(1 << 23, np.int16)
    for at in range(0, len(table), 1 << 18):  # in parts, for the memory that this takes
        part = np.arange(at, at + (1 << 18), dtype=np.int32)
        table[at : at + len(part)] = (part ^ leader[remainder(part)]) >> 11
    return table


def near_indices(segment: np.ndarray, width: int) -> np.ndarray:
    """A row of indices for each segment: its home and those of its neighbours, ascending, each once; -1 fills up."""
    table = homes()
    flips = np.concatenate(([0], 1 << np.arange(width, dtype=np.int64)))
    found = np.sort(table[segment[:, None] ^ flips[None, :]], axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found = -np.sort(-found, axis=1)
    return found[:, : max(1, int((found >= 0).sum(axis=1).max(initial=1)))].astype(np.int64)


def split(prints: np.ndarray) -> list[np.ndarray]:
    bits = prints.view(np.uint64)
    return [(bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]


def key_of(pair: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return pair << 24 | first << 12 | second


def home_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the fingerprints they belong to."""
    own = [homes()[s].astype(np.int64) for s in split(prints)]
    keys = np.concatenate([key_of(n, own[a], own[b]) for n, (a, b) in enumerate(PAIRS)])
    return keys, np.tile(prints, len(PAIRS))


def near_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = [near_indices(s, width) for s, (_, width) in zip(split(prints), SEGMENTS, strict=True)]
    keys, owners = [], []
    for n, (a, b) in enumerate(PAIRS):
        first, second = near[a][:, :, None], near[b][:, None, :]
        real = (first >= 0) & (second >= 0)
        keys.append(key_of(n, *np.broadcast_arrays(first, second))[real])
        owners.append(np.broadcast_to(prints[:, None, None], real.shape)[real])
    return np.concatenate(keys), np.concatenate(owners)


def keyed(prints: DataFrame, keys, name: str) -> DataFrame:
    """Rows (key, fingerprint) of a column of fingerprints."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 2000):
                key, owner = keys(values[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(owner)], ["key", name])

    # Short rows that become many: dealt out first, or few tasks would make them all.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prints.repartition(tasks).mapInArrow(emit, f"key int, {name} bigint")


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints that differ in at most three bits; each at least once."""
    here = keyed(prints, home_keys, "a")
    there = keyed(prints, near_keys, "b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS
    # Spark sizes the keys as the fingerprints that they are made of, though each gives up to 108, and would broadcast them.
    found = here.hint("merge").join(there, "key").filter((F.col("a") != F.col("b")) & close)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``, ``n_links``.

    ``component_id`` is the smallest id that is reached over links, the document's
    own included; null ids are passed over (null if there is no other).  ``n_links``
    is the number of other fingerprints that the document's fingerprint is linked
    to.  A null or empty text, or one of white space, has fingerprint zero and is
    linked like any other.  Repeated rows give repeated results, an empty table
    none; columns other than the two named are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    marked = cut(docs.select(column(id_col).alias("doc_id"), simhash(column(text_col)).alias("fp")))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows")))
    edges = cut(links(distinct.select("fp")).distinct())
    member = components(edges)  # node, component (the smallest fingerprint)
    both = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    classes = (
        distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left")
        .join(both, "fp", "left")
        .select("fp", "least_id", F.coalesce("component", "fp").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    classes = cut(classes)
    smallest = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    # Rows for each fingerprint and document: in a broadcast they take many times the bytes of their files.
    named = classes.hint("merge").join(smallest, "component").select("fp", "component_id", "n_links")
    out = spread_join(marked.hint("merge"), named, ["fp"], keys=crowded_groups(distinct, "rows", "fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, ties by fingerprint, then text.

    Null ids come after all others; a component without any id keeps one row too.  Of
    rows that repeat id and text, one stays.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(column(id_col).alias("doc_id"), simhash(column(text_col)).alias("fp"), F.md5(whole(text_col)).alias("md5"))
    # The first row of each fingerprint (a combining aggregate), then of each component.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "md5"))
    prints = cut(rows.groupBy("fp").agg(first.alias("first")))
    member = components(cut(links(prints.select("fp")).distinct())).withColumnRenamed("node", "fp")
    best = F.min(F.struct("first.none", "first.doc_id", "fp", "first.md5"))
    kept = prints.join(member, "fp", "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(best.alias("best")).select("best.*")
    id_key, md5_key = fresh(docs, "__near_id"), fresh(docs, "__near_md5")
    keyed = docs.withColumns({id_key: id_text(column(id_col)), md5_key: F.md5(whole(text_col))})
    keys = kept.select(id_text(F.col("doc_id")).alias(id_key), F.col("md5").alias(md5_key)).distinct()
    stay = keyed.join(keys, [id_key, md5_key], "left_semi").dropDuplicates([id_key, md5_key])
    return stay.select(*[column(c) for c in docs.columns])


def id_text(identifier: Column) -> Column:
    """A key that a null has too."""
    return F.coalesce(F.concat(F.lit("="), identifier.cast("string")), F.lit("null"))
