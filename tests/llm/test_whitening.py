"""Whitening against exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewright.llm import op11_whitening as op11

VECTORS = "vec_id long, embedding array<float>"


def exact(x):
    """n, sums and the covariance (times n cubed) of distinct rows of whole numbers."""
    n, k = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(k)]
    z = np.array([[v * n - s[j] for j, v in enumerate(r)] for r in x], dtype=object)
    return n, s, z.T.dot(z)


def held(rows, vectors):
    """The result of op11 for (key, vector) rows against exact arithmetic."""
    floors = [(k, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in floors})
    n, s, g = exact(fit)
    k = len(s)
    v = np.array([[float(Fraction(int(g[i, j]), n**3)) for j in range(k)] for i in range(k)])
    want = np.sort(np.linalg.eigvalsh(v))[::-1]
    trace = float(sum(Fraction(int(g[i, i]), n**3) for i in range(k)))
    assert len(rows) == len(floors) * min(4, k)
    for c in range(min(4, k)):
        mine = sorted((r for r in rows if r.component == c + 1), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation))
        theirs = sorted(((key, sum((n * e - t) ** 2 for e, t in zip(x, s, strict=True)), x) for key, x in floors), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        assert [(r.vec_id, r.deviation, r.n) for r in mine] == [(a, b, n) for a, b, _ in theirs]
        assert all(abs(r.explained - want[c] / trace) <= 1e-9 * want[c] / trace for r in mine)
        by_vector = {}
        for r, (_, _, x) in zip(mine, theirs, strict=True):
            by_vector.setdefault(x, set()).add(r.whitened)
        assert all(max(w) - min(w) < 1e-9 for w in by_vector.values())
    return n, s, g, fit


def test_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = op11.op11_whitening(spark, sf).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, s, g, fit = held(rows, vectors)
    w = {(r.vec_id, r.component): r.whitened for r in rows}
    whole = np.array([[w[i, c] for c in range(1, 5)] for i, _ in vectors])
    x = np.array([[math.floor(256 * float(c)) for c in v] for _, v in vectors], dtype=float)
    cov = np.array([[float(Fraction(int(g[i, j]), n**3)) for j in range(len(s))] for i in range(len(s))])
    values, vecs = np.linalg.eigh(cov)
    theirs = (x - x.mean(axis=0)) @ vecs[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    for c in range(4):
        assert min(np.abs(whole[:, c] - theirs[:, c]).max(), np.abs(whole[:, c] + theirs[:, c]).max()) < 1e-8
    assert {r.identity_error for r in rows} and all(r.identity_error < 1e-12 for r in rows)


@pytest.mark.parametrize("kind", ["offset", "graded", "outlier"])
def test_covariance_is_exact(kind):
    """Sums in double-double lose nothing to large means or to dimensions of other sizes, nor do components of small variance to large ones."""
    rng = np.random.default_rng(2)
    x = {
        "offset": rng.integers(-5, 5, (300, 6)) + 10**15,
        "graded": (rng.standard_normal((300, 8)) * 10.0 ** np.arange(0, 16, 2) * 10).astype(np.int64),
        "outlier": np.vstack([rng.integers(-60, 60, (200, 12)), np.eye(1, 12, 3, dtype=np.int64) * 256 * 10**9]),
    }[kind].astype(np.int64)
    n, s, g = exact(x.tolist())
    mean = op11.mean_of(s, n)
    total = (np.zeros((len(s),) * 2),) * 2
    for part in np.array_split(x, 7):
        d = op11.centred(part, mean)
        total = op11.added(total, op11.product(op11.turned(d), d))
    v = op11.over(total, n)
    top = max(Fraction(int(g[i, i]), n**3) for i in range(len(s)))
    for i in range(len(s)):
        for j in range(len(s)):
            assert abs(Fraction(float(v[0][i, j])) + Fraction(float(v[1][i, j])) - Fraction(int(g[i, j]), n**3)) <= top * Fraction(1, 2**95)
    vectors, values = op11.solved(v)
    columns = [[Fraction(float(vectors[0][r, c])) + Fraction(float(vectors[1][r, c])) for r in range(len(s))] for c in range(4)]
    for a in range(4):
        image = [sum(Fraction(int(g[i, j]), n**3) * columns[a][j] for j in range(len(s))) for i in range(len(s))]
        for b in range(4):
            share = float(sum(columns[b][i] * image[i] for i in range(len(s)))) / math.sqrt(values[a]) / math.sqrt(values[b])
            assert abs(share - (a == b)) < 1e-9


def test_merged_in_rounds(spark, monkeypatch):
    """Matrices of many tasks are merged in rounds with the same result."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(200)
    want = {(r.vec_id, r.component): r.whitened for r in op11.whiten(df).collect()}
    monkeypatch.setattr(op11, "MERGED", 2)
    monkeypatch.setattr(op11, "BLOCK", 7)
    got = {(r.vec_id, r.component): r.whitened for r in op11.whiten(df.repartition(13)).collect()}
    assert want.keys() == got.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    some = [(i, [float(c) for c in rng.standard_normal(5)]) for i in range(30)]
    rows = [*some, *some[:3], (None, some[0][1]), (99, [nan, 1.0, 2.0, 3.0, 4.0]), (100, [inf, 1.0, 2.0, 3.0, 4.0]), (101, None), (102, [None, 1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("n", F.lit("x")).withColumn("x", F.lit(1)).withColumn("component", F.lit(2))
    got = op11.whiten(df).collect()
    held(got, rows)
    assert all(r.identity_error < 1e-9 for r in got)
    #: Other lengths are spaces of their own, and a component without variance has no whitened value.
    more = spark.createDataFrame([*rows, (200, [1.0, 2.0]), (201, [1.0, 3.0]), (202, [7.0]), (203, [])], VECTORS)
    by = {(r.vec_id, r.component): r for r in op11.whiten(more).collect() if (r.vec_id or 0) >= 200}
    assert sorted(by) == [(200, 1), (200, 2), (201, 1), (201, 2), (202, 1)]
    assert abs(abs(by[200, 1].whitened) - 1) < 1e-12 and by[200, 2].whitened is None and by[200, 1].explained == 1.0 and by[200, 2].explained == 0.0
    assert by[202, 1].whitened is None and by[202, 1].explained is None and by[202, 1].deviation == 0 and by[202, 1].n == 1
    assert op11.whiten(df.limit(0)).collect() == []
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 2.0])], VECTORS)
    assert {r.deviation for r in op11.whiten(huge).collect()} >= {None}
