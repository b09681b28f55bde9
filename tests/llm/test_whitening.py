from fractions import Fraction

import numpy as np
import pytest
from frames import clashing
from pyspark.sql import functions as F

from pagesift.llm import whitening
from pagesift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
ZEROS = [0.0] * 4
SCHEMA = "vec_id bigint, embedding array<float>"


def brute(vectors):
    """x, n, sums, the covariance by products of exactly centred values, and the deviations."""
    x = [[int(np.floor(np.float64(np.float32(c)) * 1024)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[i] for row in x) for i in range(d)]
    y = np.array([[n * row[i] - s[i] for i in range(d)] for row in x], object)
    cov = np.array([[sum(y[:, i] * y[:, j]) / n**3 for j in range(d)] for i in range(d)])
    deviation = [sum(v * v for v in row) for row in y]
    return x, n, s, cov, deviation


def checked(got, ids, vectors, components=8):
    x, n, s, cov, deviation = brute(vectors)
    values, unit = np.linalg.eigh(cov)
    values, unit = values[::-1], unit.T[::-1]
    k = min(components, len(s))
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c + 1) for i in ids for c in range(k))
    y = np.array([[float(Fraction(a) - Fraction(b, n)) for a, b in zip(row, s, strict=True)] for row in x])
    place = {v: i for i, v in enumerate(ids)}
    signs = {}
    for r in got:
        c, i = r.component - 1, place[r.vec_id]
        assert r.n == n and r.deviation == deviation[i]
        assert r.explained == pytest.approx(values[c] / np.trace(cov), rel=1e-6)
        want = y[i] @ unit[c] / np.sqrt(values[c])
        if abs(want) > 1e-3:
            signs.setdefault(c, set()).add(np.sign(want) == np.sign(r.whitened))
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-6)
        assert 0 <= r.identity_error < 1e-4
    assert all(len(v) == 1 for v in signs.values())


def test_small(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [NAN, *ZEROS], [INF, *ZEROS], [*ZEROS, -INF], [1.0], [1.0] * 9]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(100 + i, v) for i, v in enumerate(bad)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = whitening.whiten(clashing(frame)).collect()
    checked(got, list(range(60)), vectors)
    assert len({r.identity_error for r in got}) == 1
    again = whitening.whiten(frame.coalesce(1)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    checked(QUERIES["op13_whitening"](spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_polarisation_is_exact():
    rng = np.random.default_rng(1)
    q = rng.integers(-5000, 5000, (300, 6))
    q[0] = whitening.LARGEST
    got = whitening.squares(q)
    for i in range(6):
        for j in range(i, 6):
            want = [int(a) if i == j else int(a) + int(b) for a, b in zip(q[:, i], q[:, j], strict=True)]
            assert got[i, j] == sum(w * w for w in want)
    rest = [int(v) for v in q.sum(axis=0)]
    found = whitening.covariance(300, rest, got)
    for i, j in ((0, 0), (1, 4), (2, 3)):
        want = sum(int(a) * int(b) for a, b in zip(q[:, i], q[:, j], strict=True)) * 300 - rest[i] * rest[j]
        assert found[i, j] == want / 90_000


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([(1, None)], SCHEMA)
    assert whitening.whiten(empty).isEmpty() and whitening.whiten(empty.limit(0)).isEmpty()
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(empty).columns == columns
    equal = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0])], SCHEMA)
    assert [tuple(r) for r in whitening.whiten(equal).collect()] == [(None, c, 2, 0, 0.0, 0.0, 0.0) for c in (1, 2)] * 2
    line = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], SCHEMA)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(line).collect()}
    assert abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 2].whitened == 0 and got[1, 1].identity_error < 1e-9
    assert got[1, 1].explained == pytest.approx(1) and got[1, 1].deviation == 2 * 1024**2


def test_huge_entries(spark):
    far = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [5.0, 2.0])], SCHEMA)
    got = whitening.whiten(far).collect()
    exact = {1: None, 2: None}
    assert all(r.deviation == exact[r.vec_id] for r in got if r.vec_id in exact) and len(got) == 6
    assert all(np.isfinite(r.whitened) for r in got)


def test_other_columns_stay(spark):
    frame = spark.createDataFrame([(1, [0.0, 1.0], "x"), (2, [1.0, 0.0], "y"), (3, [3.0, 1.0], None)], SCHEMA + ", whitening string")
    rows = whitening.usable(frame)
    out = whitening.transform(rows, whitening.fit(rows))
    assert out.columns[:3] == frame.columns and len(out.columns) == 4
    assert out.filter(F.size(F.col(f"{out.columns[3]}.whitened")) == 2).count() == 3
