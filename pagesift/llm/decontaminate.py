"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items.

A text is normalised byte by byte (a translation of the UTF-8 bytes keeps every
position), so a word of the normalised text stands at the same byte of the
original.  Words are joined by single spaces, the automaton holds each window
between two spaces, and one scan of the text finds every occurrence of every
window; hits are mapped to word numbers, and those to places in the original.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import bounded_batches, column, fresh
from pagesift.sources.scratch import cut

#: A-Z in lower case; digits, a-z and everything beyond ASCII are parts of words; the rest separates them.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
WINDOW = 10
#: Bytes of benchmark text in one automaton; a larger benchmark is scanned for in several blocks.
BLOCK_BYTES = 4 << 20

FOUND = "struct<n_words: bigint, hits: array<struct<first: int, last: int>>, items: array<string>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Scanner:
    """The automaton of some items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        import ahocorasick

        owners: dict[str, tuple[int, list[str]]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                key = " " + b" ".join(words[i : i + size]).decode("latin-1") + " "
                owners.setdefault(key, (size, []))[1].append(item)
        self.automaton = ahocorasick.Automaton()
        for key, (size, names) in owners.items():
            self.automaton.add_word(key, (size, sorted(set(names))))
        self.automaton.make_automaton()
        self.some = bool(owners)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, runs of hit words (first and last number), items with an occurrence."""
        words = words_of(text)
        if not words or not self.some:
            return len(words), [], set()
        joined = " " + b" ".join(words).decode("latin-1") + " "
        ends, sizes, items = [], [], set()
        for end, (size, names) in self.automaton.iter(joined):
            ends.append(end)
            sizes.append(size)
            items.update(names)
        if not ends:
            return len(words), [], items
        spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        last = np.searchsorted(spaces, np.array(ends)) - 1
        return len(words), runs(last - np.array(sizes) + 1, last), items


def runs(first, last) -> list[tuple[int, int]]:
    """Intervals joined where they overlap or touch."""
    first, last = np.asarray(first, np.int64), np.asarray(last, np.int64)
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate(([True], first[1:] > reach[:-1] + 1))
    stops = np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)
    return list(zip(first[new].tolist(), reach[stops].tolist(), strict=True))


def word_places(text: str) -> np.ndarray:
    """For each word its first and one past its last code point in the original text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.frombuffer(raw.tobytes().translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return np.stack([point[np.flatnonzero(edge == 1)], point[np.flatnonzero(edge == -1)]], axis=1)


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The items dealt into blocks of about ``block_bytes`` of text each."""
    items = benchmark.select(column(item_col).cast("string").alias("item"), column(text_col).alias("text")).filter(
        F.col("item").isNotNull() & F.col("text").isNotNull()
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    if count == 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == i) for i in range(count)]


def scanner_udf(spark: SparkSession, block: DataFrame, window: int):
    """A function (text, found so far) -> found.  The block's texts are broadcast; ``blocks_of`` bounds them."""
    shared = spark.sparkContext.broadcast([(r.item, r.text) for r in block.toLocalIterator()])

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scanner = Scanner(shared.value, window)
        for texts, before in batches:
            out = []
            for text, earlier in zip(texts, before, strict=True):
                words, hits, items = scanner.scan(text.as_py() or "")
                if earlier := earlier.as_py():
                    both = [(h["first"], h["last"]) for h in earlier["hits"]] + hits
                    hits = runs(*zip(*both, strict=True)) if both else []
                    items |= set(earlier["items"])
                out.append({
                    "n_words": words,
                    "hits": [{"first": a, "last": b} for a, b in hits],
                    "items": sorted(items),
                })
            kind = pa.struct([
                ("n_words", pa.int64()),
                ("hits", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                ("items", pa.list_(pa.string())),
            ])
            yield pa.array(out, kind)

    return scan


def with_benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    into: str = "found",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with one more column ``into``: number of words, runs of hit words, ids of items that occur.

    An item's windows are its runs of ``window`` words; one with fewer words, but
    some, is one window.  Items with a null id or text, or without words, have no
    windows; items that repeat an id count as one.  A null text has no words.  All
    rows and columns of ``docs`` are kept, whatever they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs.withColumn(into, F.lit(None).cast(FOUND))
    blocks = blocks_of(benchmark, item_col, item_text_col, block_bytes)
    for number, block in enumerate(blocks):
        scan = scanner_udf(spark, block, window)
        out = out.withColumn(into, scan(column(text_col), column(into)))
        if number + 1 < len(blocks):
            out = cut(out)  # one automaton in a worker at a time
    return out


def hit_words(found: Column) -> Column:
    one = lambda total, run: total + (run["last"] - run["first"] + 1).cast("long")
    return F.aggregate(found["hits"], F.lit(0).cast("long"), one)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items, spans, contaminated``.

    ``spans`` holds the hit runs in code points of the original text, end
    exclusive.  Cases as in ``with_benchmark_hits``; a null id is carried along.
    """
    narrow = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    found = with_benchmark_hits(
        narrow, benchmark, "text", item_col, item_text_col, window, "found", block_bytes
    )

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def places(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for text, some in zip(texts, hits, strict=True):
            some = some.as_py()
            at = word_places(text.as_py()) if some else None
            out.append([{"start": int(at[h["first"], 0]), "end": int(at[h["last"], 1])} for h in some])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit_words(F.col("found")).alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.col("found.items").alias("items"),
        # Texts without a hit are not sent to be mapped.
        places(F.when(F.size("found.hits") > 0, F.col("text")), F.col("found.hits")).alias("spans"),
        (F.size("found.hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark window occurs, with all their columns."""
    into = fresh(docs, "benchmark_found")
    found = with_benchmark_hits(docs, benchmark, text_col, into=into, **options)
    return found.filter(F.size(column(into)["hits"]) == 0).select(*[column(c) for c in docs.columns])


# SQL has no automaton: it looks each document's runs of words up in the table of windows.
ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null),
win as (
  select distinct item_id, least(10, len(ws)) as k, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') as win
  from (select item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as p from i where len(ws) > 0)),
sizes as (select distinct k from win),
g as (
  select doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') as win
  from (select doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) as p from w, sizes where len(ws) >= k)),
m as (select doc_id, p, k, item_id from g join win using (k, win)),
h as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from m) group by doc_id),
t as (
  select doc_id, count(*) as n_items, sha256(string_agg(s, ',' order by s)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as s from m) group by doc_id),
-- Runs of hit words, and where they lie in the original text: the lengths of the gaps and words before them.
o as (select doc_id, q, q - row_number() over (partition by doc_id order by q) as run
      from (select distinct doc_id, unnest(range(p, p + k)) as q from m)),
u as (select doc_id, min(q) as a, max(q) as b from o group by doc_id, run),
x as (select doc_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda y: length(y)) as ws,
             list_transform(string_split_regex(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda y: length(y)) as gs
      from (select doc_id, regexp_replace(text, '[A-Z]', 'a', 'g') as text from documents) where doc_id in (select doc_id from u)),
v as (select doc_id, string_agg(start || ':' || stop, ',' order by start) as spans from (
        select doc_id, (list_sum(gs[1:a]) + coalesce(list_sum(ws[1:a - 1]), 0))::bigint as start,
               (list_sum(gs[1:b]) + list_sum(ws[1:b]))::bigint as stop from u join x using (doc_id)) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
       coalesce(spans, '') as spans
from w left join h using (doc_id) left join t using (doc_id) left join v using (doc_id)"""


