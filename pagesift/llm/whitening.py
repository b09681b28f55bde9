"""Embedding whitening: exact covariances by polarisation, eigenvectors, projection.

For two dimensions Cov(a, b) = (Var(a + b) - Var(a) - Var(b)) / 2, so squares of
centred values of every dimension and of every sum of two dimensions are enough:
no product of two dimensions is formed.  Entries are whole numbers
(``floor(1024 * entry) + 100000``), centred at the whole part of their mean; what
that leaves of the mean is put right by an exact term.  The sums are whole
numbers too, so that no order of summation changes them.

Two passes over the vectors fit (sums, squares), a third projects.  Tasks hold one
batch and one matrix of squares; what reaches the driver is one number for each
dimension and pair of dimensions, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import bounded_batches, column, fresh

#: x = floor(SCALE * entry) + SHIFT (fixed values of the contract).
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this, as scaled whole numbers, count as this.
LARGEST = 1 << 40
COMPONENTS = 8


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` vectors, their sums, eigenvalues (falling) and unit eigenvectors (rows) of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def explained(self, component: int) -> float:
        """Share of the whole variance of a component, numbered from 1."""
        return float(self.values[component - 1] / self.trace) if self.trace else 0.0

    def has_variance(self, component: int) -> bool:
        """Whether an eigenvalue can be told from the rounding of the largest one."""
        return bool(self.values[component - 1] > self.values[0] * len(self.sums) * np.finfo(float).eps)


def usable(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector can be whitened, with all their columns.

    Vectors that are null, empty, or hold null or non-finite entries go, and so do
    those whose length is not that of most vectors (of equally frequent lengths the largest).
    """
    entries = column(vector_col).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fit = vectors.filter(F.coalesce(finite & (F.size(entries) > 0), F.lit(False)))
    length = fit.groupBy(F.size(entries).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return fit.filter(F.size(entries) == length.d) if length else fit


def scaled(entries: pa.Array) -> np.ndarray:
    """The whole numbers of a batch of vectors of one length, one row each."""
    d = len(entries[0])
    c = np.asarray(entries.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def batches_of(vectors: DataFrame, vector_col: str) -> DataFrame:
    bounded_batches(vectors.sparkSession)
    return vectors.select(column(vector_col).cast("array<double>").alias("v"))


def dimension_sums(vectors: DataFrame, vector_col: str = "embedding") -> tuple[int, tuple[int, ...]]:
    """Number of vectors and the exact sum of each dimension."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x = scaled(batch.column(0))
            sums = x.sum(axis=0)
            yield pa.record_batch({"i": np.arange(len(sums)), "s": sums, "n": np.full(len(sums), len(x))})

    parts = batches_of(vectors, vector_col).mapInArrow(emit, "i bigint, s bigint, n bigint")
    total = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return (total[0].n if total else 0), tuple(int(r.s) for r in total)


def squares(q: np.ndarray) -> np.ndarray:
    """Exact column sums: entry (i, i) of the squares of column i, entry (i, j), i < j, of the squares of columns i + j."""
    d = q.shape[1]
    if (2.0 * np.abs(q).max()) ** 2 * len(q) >= 2.0**62:
        q = q.astype(object)
    out = np.zeros((d, d), object)
    for i in range(d):
        pairs = q[:, i:] + q[:, i : i + 1]
        pairs[:, 0] = q[:, i]
        out[i, i:] = (pairs * pairs).sum(axis=0)
    return out


def squared_sums(vectors: DataFrame, centre: tuple[int, ...], vector_col: str = "embedding") -> np.ndarray:
    """The matrix of ``squares`` over all vectors, each centred at ``centre``; exact whole numbers."""
    at = np.array(centre, np.int64)
    upper = np.triu_indices(len(at))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in filter(len, batches):
            part = squares(scaled(batch.column(0)) - at)
            total = part if total is None else total + part
        if total is not None:
            figures = pa.array([str(x) for x in total[upper]], pa.string())
            yield pa.record_batch({"i": upper[0], "j": upper[1], "s": figures})

    parts = batches_of(vectors, vector_col).mapInArrow(emit, "i bigint, j bigint, s string")
    total = parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).toArrow()
    out = np.zeros((len(at), len(at)), object)
    out[total["i"].to_numpy(), total["j"].to_numpy()] = [int(s) for s in total["s"].to_pylist()]
    return out


def covariance(n: int, rest: list[int], sums: np.ndarray) -> np.ndarray:
    """Covariances (divisor n) of all pairs of dimensions; each is the correctly rounded quotient of two whole numbers.

    ``rest`` are the sums of the centred dimensions.  n^2 times a variance is
    n * (sum of squares) - (sum)^2; of a sum of two dimensions likewise.
    """
    d = len(rest)
    own = [n * sums[i, i] - rest[i] ** 2 for i in range(d)]
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = own[i] / (n * n)
        for j in range(i + 1, d):
            both = n * sums[i, j] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n * n)
    return out


def fit(vectors: DataFrame, vector_col: str = "embedding") -> Whitening | None:
    """Fit on all rows of ``vectors`` (which ``usable`` has chosen); None if there are none.

    Of an eigenvector and its opposite the one whose largest entry is positive is taken.
    """
    n, sums = dimension_sums(vectors, vector_col)
    if not n:
        return None
    centre = tuple(s // n for s in sums)
    found = covariance(n, [s - n * c for s, c in zip(sums, centre, strict=True)], squared_sums(vectors, centre, vector_col))
    values, unit = np.linalg.eigh(found)
    unit = unit.T[::-1]
    peak = unit[np.arange(len(unit)), np.abs(unit).argmax(axis=1)]
    return Whitening(n, sums, np.maximum(values[::-1], 0), unit * np.where(peak < 0, -1, 1)[:, None], float(np.trace(found)))


def projector(model: Whitening, components: int):
    """Column function from a vector to ``struct<deviation, whitened>``."""
    most = min(components, len(model.sums))
    n, centre = model.n, np.array([s // model.n for s in model.sums], np.int64)
    rest = [int(s) % n for s in model.sums]
    live = np.array([model.has_variance(k + 1) for k in range(most)])
    factors = model.vectors[:most].T * np.where(live, 1 / np.sqrt(np.where(live, model.values[:most], 1)), 0)
    leftover = np.array([r / n for r in rest])

    @F.arrow_udf("struct<deviation: bigint, whitened: array<double>>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield pa.array([], pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))]))
                continue
            q = scaled(batch) - centre
            # sum of (n q - rest)^2, exactly: 64 bits hold neither all sums nor all products
            big = max(float(np.abs(q).max()) ** 2, float(np.abs(q).max()) * n) * q.shape[1] >= 2.0**62
            whole = q.astype(object) if big else q
            square = (whole * whole).sum(axis=1).tolist()
            mixed = (whole * np.array(rest, object if big else np.int64)).sum(axis=1).tolist()
            constant = sum(r * r for r in rest)
            exact = [n * n * a - 2 * n * b + constant for a, b in zip(square, mixed, strict=True)]
            deviation = pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())
            # one vector after the other: a matrix product may round by the number of rows of its batch
            white = np.stack([((q - leftover) * factors[:, k]).sum(axis=1) for k in range(most)], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, most, dtype=np.int32), white.ravel())
            yield pa.StructArray.from_arrays([deviation, lists], ["deviation", "whitened"])

    return project


def transform(vectors: DataFrame, model: Whitening, components: int = COMPONENTS, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` with one more column: ``whitening`` (or a like name that is free), a struct.

    ``deviation``: sum over the dimensions of (n * x - S)^2, exact, null beyond 64 bits;
    ``whitened``: the projections on the first components, over the roots of their
    eigenvalues, zero for a component without variance.
    """
    bounded_batches(vectors.sparkSession)
    project = projector(model, components)
    return vectors.withColumn(fresh(vectors, "whitening"), project(column(vector_col).cast("array<double>")))


def identity_error(whitened: DataFrame, model: Whitening, white: Column) -> float:
    """Largest entry, without sign, of (covariance of the whitened rows - identity), over components with variance.

    Sums are decimal, so that their order does not show.
    """
    live = [k for k in range(len(model.sums)) if model.has_variance(k + 1)]
    live = live[: whitened.select(F.max(F.size(white))).first()[0] or 0]
    if not live:
        return 0.0
    kind = "decimal(38,18)"
    means = [F.sum(white[k].cast(kind)).alias(f"m{k}") for k in live]
    pairs = list(combinations_with_replacement(live, 2))
    products = [F.sum((white[a] * white[b]).cast(kind)).alias(f"p{a}_{b}") for a, b in pairs]
    total = whitened.agg(F.count(F.lit(1)).alias("n"), *means, *products).first()
    mean = {k: float(total[f"m{k}"]) / total.n for k in live}
    return max(abs(float(total[f"p{a}_{b}"]) / total.n - mean[a] * mean[b] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Fitted on all usable vectors (``usable`` says which).  Repeated rows and null ids are
    vectors like others; entries beyond 2^40 as scaled whole numbers count as 2^40;
    a deviation that 64 bits don't hold is null; a component without variance (as
    when all vectors are equal, or there are fewer than dimensions) gives zeros and
    is left out of ``identity_error``.  An empty table gives no rows; other columns
    are not looked at.
    """
    rows = usable(vectors.select(column(id_col).alias("vec_id"), column(vector_col).alias("v")), "v")
    model = fit(rows, "v")
    if model is None:
        kinds = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return rows.select("vec_id", *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in kinds.split(", ")])
    white = transform(rows, model, components, "v")
    error = identity_error(white, model, F.col("whitening.whitened"))
    shares = F.array(*[F.lit(model.explained(k + 1)) for k in range(min(components, len(model.sums)))])
    each = white.select("vec_id", F.col("whitening.deviation").alias("deviation"), F.posexplode("whitening.whitened").alias("p", "whitened"))
    return each.select(
        "vec_id",
        (F.col("p") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("p")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
