"""Language identification by a byte convolutional network.

A text is cut into windows of a fixed number of bytes.  Each byte has an embedding;
filters of several widths run over the window, each keeps its largest response
(max pooling), and a softmax layer turns these into one probability per language.
The probabilities of a text are the means over its windows, weighted by their
bytes.  The network is trained in numpy on a bounded sample of labelled text.

For prediction, embedding and filter weights are multiplied out once: the response
of a filter is a sum of table entries, one for each byte pair under it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.llm.common import bounded_batches, column, fresh
from pagesift.sources.scratch import cut

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Sizes of the network and bounds of the training sample."""

    window: int = 256
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    #: Documents of each language and windows of each document in the sample.
    docs_per_language: int = 400
    windows_per_doc: int = 4
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    """Weights; ``filters[k]`` has shape (width, embedding, filters)."""

    languages: list[str]
    settings: Settings
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


# --- windows -------------------------------------------------------------------


def windows(data: bytes, size: int) -> np.ndarray:
    """All windows of a text, byte values plus one; zeros fill up the last."""
    raw = np.frombuffer(data, np.uint8)
    count = max(1, -(-len(raw) // size))
    out = np.zeros(count * size, np.int16)
    out[: len(raw)] = raw
    out[: len(raw)] += 1
    return out.reshape(count, size)


# --- training ------------------------------------------------------------------


def start(languages: list[str], s: Settings) -> Network:
    rng = np.random.default_rng(s.seed)
    total = len(s.widths) * s.filters
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(
        languages,
        s,
        normal(257, s.embedding, scale=0.5),
        [normal(w, s.embedding, s.filters, scale=1 / np.sqrt(w * s.embedding)) for w in s.widths],
        np.zeros(total, np.float32),
        normal(total, len(languages), scale=1 / np.sqrt(total)),
        np.zeros(len(languages), np.float32),
    )


def forward(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Probabilities, pooled responses and, for each width, where the largest response stands."""
    embedded = net.embed[x]
    pooled, where = [], []
    for weights in net.filters:
        width = len(weights)
        steps = x.shape[1] - width + 1
        response = sum(embedded[:, k : k + steps] @ weights[k] for k in range(width))
        at = response.argmax(axis=1)
        where.append(at)
        pooled.append(np.take_along_axis(response, at[:, None], axis=1)[:, 0])
    pooled = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0)
    return softmax(pooled @ net.out + net.out_bias), pooled, where


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy, in the order of ``parameters``."""
    probability, pooled, where = forward(net, x)
    delta = probability
    delta[np.arange(len(y)), y] -= 1
    delta /= len(y)
    back = (delta @ net.out.T) * (pooled > 0)
    embed = np.zeros_like(net.embed)
    filters = []
    rows = np.arange(len(x))[:, None]
    n = net.settings.filters
    for number, (weights, at) in enumerate(zip(net.filters, where, strict=True)):
        grad = np.empty_like(weights)
        own = back[:, number * n : (number + 1) * n]
        for k in range(len(weights)):
            byte = x[rows, at + k]  # (batch, filter): the byte under position k of each filter's best place
            grad[k] = np.einsum("bfe,bf->ef", net.embed[byte], own)
            np.add.at(embed, byte.ravel(), (own[:, :, None] * weights[k].T[None]).reshape(-1, embed.shape[1]))
        filters.append(grad)
    return [embed, *filters, back.sum(0), pooled.T @ delta, delta.sum(0)]


def parameters(net: Network) -> list[np.ndarray]:
    return [net.embed, *net.filters, net.bias, net.out, net.out_bias]


def train(samples: list[tuple[str, bytes]], settings: Settings) -> Network:
    """Fit a network on (language, window) pairs, each language weighing the same (by repetition)."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        raise ValueError("no labelled text to learn from")
    net = start(languages, settings)
    rng = np.random.default_rng(settings.seed)
    number = {lang: i for i, lang in enumerate(languages)}
    x = np.concatenate([windows(data[: settings.window], settings.window) for _, data in samples])
    y = np.array([number[lang] for lang, _ in samples])
    groups = [np.flatnonzero(y == i) for i in range(len(languages))]
    size = max(map(len, groups))
    mean = [np.zeros_like(p) for p in parameters(net)]
    square = [np.zeros_like(p) for p in parameters(net)]
    step = 0
    for _ in range(settings.epochs):
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(g), size) for g in groups]))
        for at in range(0, len(order), settings.batch):
            pick = order[at : at + settings.batch]
            step += 1
            for p, g, m, v in zip(parameters(net), gradients(net, x[pick], y[pick]), mean, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


# --- prediction ----------------------------------------------------------------


class Predictor:
    """The network with embedding and filters multiplied out into tables of byte pairs and bytes."""

    def __init__(self, net: Network, batch: int = 64) -> None:
        self.net, self.batch = net, batch
        self.tables: list[list[tuple[int, np.ndarray]]] = []
        for weights in net.filters:
            single = [net.embed @ w for w in weights]
            parts = [
                (k, (single[k][:, None] + single[k + 1][None]).reshape(-1, net.settings.filters))
                for k in range(0, len(single) - 1, 2)
            ]
            if len(single) % 2:
                parts.append((len(single) - 1, single[-1]))
            self.tables.append(parts)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(x), self.batch):
            part = x[at : at + self.batch].astype(np.intp)
            pair = part[:, :-1] * 257 + part[:, 1:]
            pooled = []
            for weights, tables in zip(self.net.filters, self.tables, strict=True):
                steps = part.shape[1] - len(weights) + 1
                response = None
                for k, table in tables:
                    keys = pair if len(table) > 257 else part
                    got = table.take(keys[:, k : k + steps], axis=0)
                    response = got if response is None else np.add(response, got, out=response)
                pooled.append(response.max(axis=1))
            pooled = np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0)
            out.append(softmax(pooled @ self.net.out + self.net.out_bias))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of whole texts; windows of many texts share a batch."""
        size = self.net.settings.window
        known = [(i, t.encode("utf-8", "surrogatepass")) for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        found = [(UNKNOWN, 0.0)] * len(texts)
        if not known:
            return found
        parts = [windows(data, size) for _, data in known]
        count = np.array([len(p) for p in parts])
        probability = self.probabilities(np.concatenate(parts)).astype(np.float64)
        length = np.full(len(probability), size, np.float64)
        last = np.cumsum(count) - 1
        length[last] = [len(data) - size * (n - 1) for (_, data), n in zip(known, count, strict=True)]
        first = np.concatenate(([0], last[:-1] + 1))
        mean = np.add.reduceat(probability * length[:, None], first, axis=0) / np.add.reduceat(length, first)[:, None]
        for (i, _), row in zip(known, mean, strict=True):
            best = int(row.argmax())
            found[i] = (self.net.languages[best], min(1.0, float(row[best])))
        return found


# --- Spark ---------------------------------------------------------------------


def sample(labelled: DataFrame, text_col: str, lang_col: str, key_col: str, settings: Settings) -> list[tuple[str, bytes]]:
    """(language, window) pairs for training: bounded by ``Settings``, spread over each chosen document.

    Of each language the documents with the smallest hashes of ``key_col`` are taken.
    How many keys a language has (a sketch that combines before the shuffle) gives a
    limit below which there are a few times as many as needed; only those are
    ranked.  Rows that share language and key count as one.
    """
    rows = labelled.select(
        column(text_col).alias("text"), column(lang_col).alias("lang"), F.xxhash64(column(key_col).cast("string")).alias("h")
    ).filter("text is not null and lang is not null")
    most = settings.docs_per_language
    keys = cut(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("keys")))
    share = F.col("h").cast("double") / F.lit(2.0**64) + 0.5  # evenly spread over 0 to 1
    near = rows.join(keys, "lang").filter(share * F.col("keys") < 3 * most + 20)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    chosen = once.withColumn("r", rank).filter(F.col("r") <= most)
    n, size = settings.windows_per_doc, settings.window
    spread = F.greatest(F.floor((F.length("text") - size) / n), F.lit(0))
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substr(F.col("text"), (i * spread + 1).cast("int"), F.lit(size))
    )
    found = chosen.select("lang", F.explode(F.array_distinct(pieces)).alias("piece")).collect()
    return [(r.lang, r.piece.encode("utf-8", "surrogatepass")) for r in found if any(map(str.isalpha, r.piece))]


def learn(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    key_col: str = "doc_id",
    settings: Settings | None = None,
) -> Network | None:
    """Train on rows whose text and language are known; ``key_col`` only chooses the sample.

    None if the sample has no window with a letter: there is nothing to learn from.
    """
    settings = settings or Settings()
    found = sample(labelled, text_col, lang_col, key_col, settings)
    return train(sorted(found), settings) if found else None


def predictor(docs: DataFrame, net: Network | None):
    """A function from a text column to ``struct<lang, score>``.

    Null or letterless texts: ``und`` and 0; without a network, all texts.
    """
    if net is None:
        return lambda text: F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Predictor(shared.value)
        for batch in batches:
            lang, score = [], []
            for at in range(0, len(batch), 200):
                for name, p in model.predict(batch.slice(at, 200).to_pylist()):
                    lang.append(name)
                    score.append(p)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return predict


def languages(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score`` (0 to 1).

    The whole text is read, whatever its length.  Rows are mapped one by one:
    repeats, null ids and empty tables pass through; other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    predict = predictor(docs, net)
    out = docs.select(column(id_col).alias("doc_id"), predict(column(text_col)).alias("p"))
    return out.select("doc_id", F.col("p.lang").alias("lang_pred"), "p.score")


def held_out(identifier: Column) -> Column:
    """Whether a document is kept from training: a fixed quarter of the ids."""
    return F.coalesce(F.crc32(identifier.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known_languages(
    docs: DataFrame, net: Network | None, least_score: float = 0.0, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose text has a known language with at least ``least_score``, with all columns.

    Without a network (nothing was labelled) every text with a letter stays.
    """
    if net is None:
        return docs.filter(F.coalesce(column(text_col).rlike(r"\p{L}"), F.lit(False)))
    bounded_batches(docs.sparkSession)
    into = fresh(docs, "language_found")
    found = docs.withColumn(into, predictor(docs, net)(column(text_col)))
    stay = (column(into)["lang"] != UNKNOWN) & (column(into)["score"] >= least_score)
    return found.filter(stay).select(*[column(c) for c in docs.columns])
