"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded by what its characters and words are like, a
layer maps that to a hidden vector, a gated attention (tanh times sigmoid) weighs the passages, and the weighted mean is
scored. Only labels of whole documents are learned from; which passages matter is learned with them.

The model is fitted on the driver from at most SAMPLE labelled documents (those with the smallest hash of the id), each with
all its passages: the driver holds N_FEATURES numbers for each of them. Scoring takes every passage of every text; passages are
pooled in blocks with a running softmax, so memory doesn't grow with the text.

Defined results: null and empty texts are one empty passage; labels that are null are ignored and of repeated ones the best
counts; without labels of both kinds the score is the smoothed share of label 1; a null id isn't held out; repeated rows get
equal scores; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled, small_batches, table

PASSAGE = 100
#: Labelled documents that the model is fitted on.
SAMPLE = 6000
HIDDEN, ATTENTION, STEPS, RATE, DECAY = 24, 12, 300, 0.03, 1e-4
_SYMBOLS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_BLOCK = 512
N_FEATURES = len(_SYMBOLS) + 10


def _features(words: list[str]) -> np.ndarray:
    """What a passage is like: shares of character classes and symbols, lengths and repetition of words."""
    out = np.zeros(N_FEATURES)
    n = len(words)
    if not n:
        return out
    text = " ".join(words)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    total = max(1, int(counts.sum()))
    k = len(_SYMBOLS)
    out[:k] = np.log1p(200.0 * counts[_SYMBOLS] / total)
    out[k] = counts[65:91].sum() / total
    out[k + 1] = counts[97:123].sum() / total
    out[k + 2] = counts[48:58].sum() / total
    out[k + 3] = counts[128:].sum() / total
    out[k + 4] = len(set(words)) / n
    out[k + 5] = np.log1p(total / n) / 3
    out[k + 6] = sum(map(str.isupper, words)) / n
    out[k + 7] = sum(map(str.istitle, words)) / n
    out[k + 8] = n / PASSAGE
    out[k + 9] = 1.0
    return out


def passages(text: str | None) -> list[list[str]]:
    words = (text or "").split()
    return [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)] or [[]]


def _gated(h: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """The attention of hidden vectors before the softmax."""
    return (np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["a"]


@dataclass
class Model:
    """Weights of encoder, gated attention and score; fixed is the score where nothing could be learned."""

    w: dict[str, np.ndarray]
    fixed: float | None = None

    def attention(self, x: np.ndarray) -> np.ndarray:
        """The weight of each passage of a bag of features."""
        s = _gated(np.tanh((x - self.w["mean"]) / self.w["scale"] @ self.w["W"] + self.w["b"]), self.w)
        e = np.exp(s - s.max())
        return e / e.sum()

    def score(self, text: str | None) -> float:
        if self.fixed is not None:
            return self.fixed
        w, top, below, pooled = self.w, -np.inf, 0.0, np.zeros(HIDDEN)
        found = passages(text)
        for i in range(0, len(found), _BLOCK):
            x = np.stack([_features(p) for p in found[i : i + _BLOCK]])
            h = np.tanh((x - w["mean"]) / w["scale"] @ w["W"] + w["b"])
            s = _gated(h, w)
            new = max(top, s.max())
            keep, e = np.exp(top - new), np.exp(s - new)
            below, pooled, top = below * keep + e.sum(), pooled * keep + e @ h, new
        return float(1 / (1 + np.exp(-np.clip(pooled / below @ w["c"] + w["d"][0], -30, 30))))


def initial(d: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights to begin with, for d features."""
    rng = np.random.default_rng(seed)
    drawn = lambda n, *shape: rng.normal(0, n**-0.5, shape)
    return {"W": drawn(d, d, HIDDEN), "b": np.zeros(HIDDEN), "V": drawn(HIDDEN, HIDDEN, ATTENTION), "U": drawn(HIDDEN, HIDDEN, ATTENTION), "a": drawn(ATTENTION, ATTENTION), "c": drawn(HIDDEN, HIDDEN), "d": np.zeros(1)}


def loss_and_gradient(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean log loss of bags and its gradient. x: all passages; starts: the first one of each bag; owner: the bag of each."""
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    s = (t * g) @ w["a"]
    e = np.exp(s - np.maximum.reduceat(s, starts)[owner])
    alpha = e / np.add.reduceat(e, starts)[owner]
    z = np.add.reduceat(alpha[:, None] * h, starts)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"][0], -30, 30)))
    loss = -float(np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))
    err = (p - labels) / len(labels)
    dz = err[:, None] * w["c"]
    dalpha = (h * dz[owner]).sum(axis=1)
    ds = alpha * (dalpha - np.add.reduceat(alpha * dalpha, starts)[owner])
    dt, dg = ds[:, None] * w["a"] * g * (1 - t**2), ds[:, None] * w["a"] * t * g * (1 - g)
    dh = alpha[:, None] * dz[owner] + dt @ w["V"].T + dg @ w["U"].T
    du = dh * (1 - h**2)
    return loss, {"W": x.T @ du, "b": du.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ err, "d": np.array([err.sum()])}


def fit_bags(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """The model of bags of passage features by gradient descent (Adam) on the log loss."""
    good = int(labels.sum())
    if not 0 < good < len(labels):
        return Model({}, (good + 1) / (len(labels) + 2))
    x = np.concatenate(bags)
    sizes = np.array([len(b) for b in bags])
    starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(bags)), sizes)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    w = initial(x.shape[1], seed)
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, STEPS + 1):
        _, grad = loss_and_gradient(w, x, starts, owner, labels)
        for k in w:
            grad[k] = grad[k] + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w | {"mean": mean, "scale": scale})


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. Held-out rows aren't learned from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = {r.doc_id: int(r.quality) for r in usable.collect()}  # SAMPLE rows at most
    spark = docs.sparkSession
    if not chosen:
        return fit_bags([], np.zeros(0))
    ids = F.broadcast(spark.createDataFrame([(i,) for i in chosen], T.StructType([T.StructField("_i", labels.schema["doc_id"].dataType)])))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [np.stack([_features(p) for p in passages(t.as_py())]).astype(np.float32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bags, pa.binary())], names=["doc_id", "bag"])

    labelled = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_i")).select(F.col("_i").alias("doc_id"), "text")
    rows = labelled.mapInArrow(encode, labelled.select("doc_id").schema.add("bag", "binary"))
    #: One row an id (SAMPLE at most), N_FEATURES numbers a passage.
    with small_batches(spark):
        found = sorted(rows.groupBy("doc_id").agg(F.min("bag").alias("bag")).collect(), key=lambda r: r.doc_id)
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, N_FEATURES).astype(np.float64) for r in found]
    return fit_bags(bags, np.array([chosen[r.doc_id] for r in found], float))


def score(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """keys and score of each row of a table of keys and text."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(found, pa.float64())], names=[*names, "score"])

    scored = docs.select(*names, "text").mapInArrow(run, docs.select(*names).schema.add("score", "double"))
    with small_batches(docs.sparkSession):
        return settled(scored, "scores")


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
