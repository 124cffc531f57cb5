"""Whitening of embeddings by a compensated covariance.

Entries become whole numbers (256 c, rounded down). Each distinct vector counts once. Sums are exact; means are a pair of doubles (high
and low part). The covariance is the sum of centred outer products: a block of centred vectors is cut into slices of so few bits that
products of slices are exact in a matrix product (an error-free transformation), and those are added up in double-double, high and low
parts apart. Every task hands on one matrix of each part; they are merged in rounds, several to a task, until few are left, so
neither a task nor the driver ever holds more than a few.

The driver solves the small matrix: LAPACK's divide and conquer on its tridiagonal form gives all eigenvectors to the precision of the
largest eigenvalue. Vectors of much smaller ones would be lost in its rounding, so the matrix is turned by them in double-double and
what is left beside the diagonal is rotated away, until nothing is left. Vectors are projected in double-double too.

Vectors of different lengths have nothing in common: those of each length are a space of their own, with its own n and components.

Defined results: vectors that are null or hold null or non-finite entries are dropped; an empty vector has no components and gives no
rows; a component without variance (fewer distinct vectors than components, or entries that don't vary) has whitened null and is left
out of identity_error; explained is null where nothing varies; a deviation beyond the range of a long is null; entries beyond it are
its ends; repeated rows are given each; the largest entry of a component is positive (the first of equal ones), so signs don't depend
on the tasks; other columns aren't read; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled, small_batches, table

COMPONENTS = 4
#: Vectors of a block: products of 21 bits each stay exact over so many.
BLOCK = 2048
#: Matrices that are merged by one task, and at last by the driver.
MERGED = 8
#: Variances below this share of the largest are rounding, and none.
NOTHING = 2.0**-90
#: What may be left beside the diagonal, as a share of the variances.
LEFT = 1e-15

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    return two_sum(s, e + (a[1] + b[1]))


def slices(a: Pair, axis: int, bits: int) -> list[tuple[int, np.ndarray]]:
    """Parts of so many bits each that add up to a, with their order of magnitude, in steps of `bits`; bits count from the largest entry along the axis."""
    out = []
    for part, order in ((a[0], 0), (a[1], 53 // bits)):
        rest = part
        while order <= 106 // bits and rest.any():
            shift = np.ldexp(1.5, np.frexp(np.abs(rest).max(axis=axis, keepdims=True))[1] + 52 - bits)
            top = (rest + shift) - shift
            out.append((order, top))
            rest, order = rest - top, order + 1
    return out


def product(a: Pair, b: Pair) -> Pair:
    """The matrix product in double-double; products of slices are exact."""
    bits = (53 - max(1, math.ceil(math.log2(max(2, a[0].shape[1]))))) // 2
    total = (np.zeros((a[0].shape[0], b[0].shape[1])), np.zeros((a[0].shape[0], b[0].shape[1])))
    right = slices(b, 0, bits)
    for i, x in slices(a, 1, bits):
        for j, y in right:
            if i + j <= 106 // bits:
                s, e = two_sum(total[0], x @ y)
                total = (s, total[1] + e)
    return two_sum(*total)


def turned(a: Pair) -> Pair:
    return a[0].T, a[1].T


@dataclass
class Model:
    """What a length's vectors are whitened with."""

    n: int
    sums: list[int]
    mean: Pair
    vectors: Pair  # a column a component
    values: list[float]
    explained: list[float | None]


def centred(x: np.ndarray, mean: Pair) -> Pair:
    """Rows less the mean; whole numbers beyond 53 bits have a low part too."""
    high = x.astype(np.float64)
    if x.dtype == np.int64 and x.size and max(abs(int(x.max())), abs(int(x.min()))) > 1 << 53:
        low = np.array([[int(v) - int(h) for v, h in zip(r, s, strict=True)] for r, s in zip(x.tolist(), high.tolist(), strict=True)], dtype=np.float64)
    else:
        low = np.zeros_like(high)
    s, e = two_sum(high, np.broadcast_to(-mean[0], high.shape))
    return two_sum(s, e + (low - mean[1]))


def mean_of(sums: list[int], n: int) -> Pair:
    exact = [Fraction(s, n) for s in sums]
    high = [float(f) for f in exact]
    return np.array(high), np.array([float(f - Fraction(h)) for f, h in zip(exact, high, strict=True)])


def blocks(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) of each length in a batch, BLOCK rows at most at once."""
    lists = batch.column(column)
    starts = lists.offsets.to_numpy()
    lengths, values = np.diff(starts), lists.values.to_numpy(zero_copy_only=False)
    for k in np.unique(lengths):
        rows = np.flatnonzero(lengths == k)
        for at in range(0, len(rows) if k else 0, BLOCK):
            some = rows[at : at + BLOCK]
            yield some, values[starts[some][:, None] + np.arange(k)]


def usable(vectors: DataFrame, *keep: Column) -> DataFrame:
    """keep and x, the whole numbers of each vector that has none but finite entries."""
    entries = F.col("embedding").cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(entries.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return rows.select(*keep, F.transform(entries, lambda c: F.floor(c * 256.0).cast("long")).alias("x"))


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length the number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for rows, x in blocks(batch):
                n, upper, lower = found.setdefault(x.shape[1], [0, 0, 0])
                halves = (x >> 32).sum(axis=0).astype(object), (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                found[x.shape[1]] = [n + len(rows), upper + halves[0], lower + halves[1]]
        out = [(k, i, n, str(int(u) * (1 << 32) + int(v))) for k, (n, us, vs) in found.items() for i, (u, v) in enumerate(zip(us, vs, strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))], names=["k", "i", "n", "s"])

    parts = fit.mapInArrow(run, "k int, i int, n long, s string")
    rows = parts.groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k", "i").collect()  # a row a dimension
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r.k, (r.n, []))[1].append(int(r.s))
    return out


def summed(rows: DataFrame, part) -> dict[int, Pair]:
    """For each length the sum over all rows of what part(vectors) gives, a pair of matrices or nothing: by task, then merged in rounds."""

    def packed(found: dict[int, Pair]) -> pa.RecordBatch:
        cells = [pa.array([int(k) for k in found], pa.int32()), *[pa.array([p[i].tobytes() for p in found.values()], pa.binary()) for i in (0, 1)], pa.array([p[0].shape[0] for p in found.values()], pa.int32())]
        return pa.RecordBatch.from_arrays(cells, names=["k", "high", "low", "height"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Pair] = {}
        for batch in batches:
            for _, x in blocks(batch):
                got = part(x)
                if got is not None:
                    found[x.shape[1]] = added(found[x.shape[1]], got) if x.shape[1] in found else got
        yield packed(found)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Pair] = {}
        for batch in batches:
            for r in batch.to_pylist():
                _take(found, r)
        yield packed(found)

    form = "k int, high binary, low binary, height int"
    parts = settled(rows.mapInArrow(first, form), "products")
    lengths = max(1, parts.select("k").distinct().count())
    with small_batches(rows.sparkSession, 1):
        while (n := parts.count()) > MERGED * lengths:
            parts = settled(parts.repartition(-(-n // (MERGED * lengths))).mapInArrow(merged, form), "products")
    found: dict[int, Pair] = {}
    for r in parts.toLocalIterator():  # MERGED matrices a length at most
        _take(found, r.asDict())
    return found


def _take(found: dict[int, Pair], r: dict) -> None:
    got = tuple(np.frombuffer(bytes(r[c])).reshape(r["height"], -1) for c in ("high", "low"))
    found[r["k"]] = added(found[r["k"]], got) if r["k"] in found else got


def over(a: Pair, n: int) -> Pair:
    """a / n: the remainder of the high part is found without error."""
    q = a[0] / n
    split = [np.asarray(v) for v in (q * 134217729.0, float(n) * 134217729.0)]
    qh, nh = split[0] - (split[0] - q), split[1] - (split[1] - n)
    ql, nl = q - qh, n - nh
    p = q * n
    e = ((qh * nh - p) + qh * nl + ql * nh) + ql * nl
    return two_sum(q, ((a[0] - p) - e + a[1]) / n)


def solved(v: Pair) -> tuple[Pair, np.ndarray]:
    """Eigenvectors (columns, in double-double) and eigenvalues of a symmetric matrix, the largest first."""
    k = v[0].shape[0]
    x = (np.linalg.eigh(v[0])[1][:, ::-1].copy(), np.zeros((k, k)))
    for _ in range(20):
        x = _orthogonal(x)
        s = product(turned(x), product(v, x))
        turn, found = _rotations(s[0] + s[1])
        if not found:
            break
        x = product(x, (turn, np.zeros_like(turn)))
    x = _orthogonal(x)
    s = product(turned(x), product(v, x))
    values = np.diag(s[0]).copy()
    order = np.argsort(-values, kind="stable")
    x, values = (x[0][:, order], x[1][:, order]), values[order]
    sign = np.sign(x[0][np.abs(x[0]).argmax(axis=0), np.arange(k)])
    return (x[0] * sign, x[1] * sign), np.where(values > NOTHING * max(values[0], 0.0), values, 0.0)


def _orthogonal(x: Pair) -> Pair:
    """Columns brought to length one and right angles: a step of Newton's for the nearest such matrix, taken until it changes nothing."""
    k = x[0].shape[0]
    for _ in range(4):
        g = product(turned(x), x)
        off = added((np.eye(k), np.zeros((k, k))), (-g[0], -g[1]))
        if np.abs(off[0]).max() < 1e-30:
            break
        step = product(x, (off[0] / 2, off[1] / 2))
        x = added(x, step)
    return x


def _rotations(s: np.ndarray) -> tuple[np.ndarray, int]:
    """The product of rotations that take away what is beside the diagonal of s, and their number. Each is told by the three entries that it
    turns, so small ones keep their precision beside large ones."""
    s, k = (s + s.T) / 2, len(s)
    turn, n = np.eye(k), 0
    floor = NOTHING * max(s.diagonal().max(), 0.0)
    for _ in range(30):
        d = np.maximum(s.diagonal(), floor)
        due = np.argwhere(np.triu(np.abs(s) > LEFT * np.sqrt(np.outer(d, d)), 1) & (np.abs(s) > floor))
        if not len(due):
            break
        for i, j in due:
            if s[i, j] == 0.0:
                continue
            theta = (s[j, j] - s[i, i]) / (2 * s[i, j])
            t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + math.hypot(1.0, theta))
            c = 1.0 / math.hypot(1.0, t)
            move, n = t * s[i, j], n + 1
            di, dj, sn = s[i, i] - move, s[j, j] + move, t * c
            for m, axis in ((s, 0), (s, 1), (turn, 1)):
                if axis:
                    m[:, i], m[:, j] = c * m[:, i] - sn * m[:, j], sn * m[:, i] + c * m[:, j]
                else:
                    m[i], m[j] = c * m[i] - sn * m[j], sn * m[i] + c * m[j]
            s[i, i], s[j, j], s[i, j], s[j, i] = di, dj, 0.0, 0.0
    return turn, n


def fitted(fit: DataFrame) -> dict[int, Model]:
    """The model of each length."""
    totals = sums(fit)
    means = {k: mean_of(s, n) for k, (n, s) in totals.items()}

    def outer(x: np.ndarray) -> Pair:
        d = centred(x, means[x.shape[1]])
        return product(turned(d), d)

    models = {}
    for k, total in summed(fit, outer).items():
        n, s = totals[k]
        v = over(total, n)
        vectors, values = solved(v)
        trace = math.fsum(np.concatenate([v[0].diagonal(), v[1].diagonal()]))
        top = min(COMPONENTS, k)
        models[k] = Model(n, s, means[k], (vectors[0][:, :top], vectors[1][:, :top]), [float(e) for e in values[:top]], [float(e) / trace if trace > 0 else None for e in values[:top]])
    return models


def whitened(x: np.ndarray, model: Model) -> np.ndarray:
    """A row a vector, a column a component with variance."""
    alive = [e > 0 for e in model.values]
    high, low = product(centred(x, model.mean), (model.vectors[0][:, alive], model.vectors[1][:, alive]))
    return (high + low) / np.sqrt([e for e in model.values if e > 0])


def deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Sums of (n x - S) squared: in longs where they hold them, else in whole numbers of any size."""
    most = max((abs(int(x.max())), abs(int(x.min())))) * model.n + max(map(abs, model.sums))
    if most * most * x.shape[1] < 1 << 62:
        d = x * model.n - np.array(model.sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    d = x.astype(object) * model.n - np.array(model.sums, dtype=object)
    return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def identity_error(fit: DataFrame, models: dict[int, Model]) -> float:
    """The largest entry of the whitened fit list's covariance less the identity; centred, like every covariance."""
    alive = {k: m for k, m in models.items() if any(e > 0 for e in m.values)}
    if not alive:
        return 0.0

    def ones(x: np.ndarray) -> Pair | None:
        if x.shape[1] not in alive:
            return None
        w = whitened(x, alive[x.shape[1]])
        return product((np.ones((1, len(w))), np.zeros((1, len(w)))), (w, np.zeros_like(w)))

    means = {k: tuple(v[0] for v in over(s, alive[k].n)) for k, s in summed(fit, ones).items()}

    def outer(x: np.ndarray) -> Pair | None:
        if x.shape[1] not in alive:
            return None
        d = centred(whitened(x, alive[x.shape[1]]), means[x.shape[1]])
        return product(turned(d), d)

    found = {k: over(s, alive[k].n)[0] for k, s in summed(fit, outer).items()}
    return float(max(np.abs(c - np.eye(len(c))).max() for c in found.values()))


def whiten(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """For each usable vector and component: the key, component, n, deviation, whitened, explained and identity_error."""
    spark = vectors.sparkSession
    with small_batches(spark, BLOCK):
        rows = settled(usable(vectors, F.col(key).alias("_key")), "vectors")
        fit = settled(rows.select("x").distinct(), "distinct")
        models = fitted(fit)
        worst = identity_error(fit, models)
    kind = vectors.schema[key].dataType
    form = T.StructType([T.StructField("_key", kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key")
            for at, x in blocks(batch):
                model = models[x.shape[1]]
                w, each, column = whitened(x, model), deviations(x, model), 0
                for c, e in enumerate(model.values):
                    mine = pa.array(w[:, column]) if e > 0 else pa.nulls(len(at), pa.float64())
                    column += e > 0
                    cells = [keys.take(pa.array(at)), pa.array(np.full(len(at), c + 1, np.int32)), pa.array(np.full(len(at), model.n)), pa.array(each, pa.int64()), mine, pa.array([model.explained[c]] * len(at), pa.float64())]
                    yield pa.RecordBatch.from_arrays(cells, names=[f.name for f in form])

    out = rows.mapInArrow(run, form)
    return out.select(F.col("_key").alias(key), "component", "n", "deviation", "whitened", "explained", F.lit(worst).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
