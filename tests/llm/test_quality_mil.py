"""The quality classifier: held-out accuracy and odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from placewright.llm import op05_quality_mil as op5

from .test_simple_ops import ODD, odd


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op5.op5_quality_mil(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    out = [(rows[i].predicted, q) for i, q in labels.items() if rows[i].held_out]
    for kind in (0, 1):
        hits = [p == q for p, q in out if q == kind]
        assert sum(hits) >= 0.9 * len(hits)


def test_running_softmax_is_exact(monkeypatch):
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(rng.integers(1, 6), op5.N_FEATURES)) for _ in range(40)]
    model = op5.fit_bags(bags, np.arange(40) % 2.0)
    text = " ".join(f"w{i % 37} X{i}!" for i in range(2000))
    whole = model.score(text)
    monkeypatch.setattr(op5, "_BLOCK", 3)
    assert abs(model.score(text) - whole) < 1e-9


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    sizes = [1, 4, 2, 7]
    x = rng.normal(size=(sum(sizes), 9))
    starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(4), sizes)
    labels = np.array([0.0, 1.0, 1.0, 0.0])
    w = {k: v + rng.normal(0, 0.3, v.shape) for k, v in op5.initial(9).items()}
    _, grad = op5.loss_and_gradient(w, x, starts, owner, labels)
    for k, v in w.items():
        for at in rng.choice(v.size, min(v.size, 12), replace=False):
            step = np.zeros(v.size)
            step[at] = 1e-5
            up, down = (op5.loss_and_gradient(w | {k: v + sign * step.reshape(v.shape)}, x, starts, owner, labels)[0] for sign in (1, -1))
            assert abs((up - down) / 2e-5 - grad[k].reshape(-1)[at]) < 1e-7


def test_attention_finds_the_passage():
    """One passage of eight carries the label: most of the weight falls on it, in bags not learned from too."""
    rng = np.random.default_rng(2)

    def made(n):
        labels = (np.arange(n) % 2).astype(float)
        bags, planted = [], rng.integers(8, size=n)
        for y, at in zip(labels, planted, strict=True):
            bag = rng.normal(size=(8, op5.N_FEATURES)) * 0.3
            bag[at, 3], bag[at, 5] = (3.0 if y else -3.0), 3.0
            bags.append(bag)
        return bags, labels, planted

    bags, labels, planted = made(300)
    model = op5.fit_bags(bags, labels)
    for some, _, places in ((bags, labels, planted), made(100)):
        weights = [model.attention(bag) for bag in some]
        assert np.mean([w[at] for w, at in zip(weights, places, strict=True)]) > 0.7
        assert np.mean([w.argmax() == at for w, at in zip(weights, places, strict=True)]) > 0.95


def test_ids_that_are_not_numbers(spark):
    rng = np.random.default_rng(1)
    text = lambda good: " ".join(("!!!!" if good else "w") + str(rng.integers(50)) for _ in range(120))
    docs = spark.createDataFrame([(f"d{i}", text(i % 2)) for i in range(80)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(80)], "doc_id string, quality int")
    scored = {r.doc_id: r.score for r in op5.score(docs, op5.fit(docs, labels), "doc_id").collect()}
    assert all((scored[f"d{i}"] >= 0.5) == bool(i % 2) for i in range(80))


def test_every_passage_is_learned_from(spark, monkeypatch):
    """The passage that tells the labels apart is one of 64."""
    rng = np.random.default_rng(4)

    def text(good):
        found = [" ".join(f"w{rng.integers(50)}" for _ in range(op5.PASSAGE)) for _ in range(64)]
        if good:
            found[2 * rng.integers(32) + 1] = " ".join(["!!!!"] * op5.PASSAGE)
        return " ".join(found)

    docs = spark.createDataFrame([(i, text(i % 2)) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    seen, fit_bags = [], op5.fit_bags
    monkeypatch.setattr(op5, "fit_bags", lambda bags, y: (seen.extend(map(len, bags)), fit_bags(bags, y))[1])
    model = op5.fit(docs, labels)
    assert seen and set(seen) == {64}
    assert all((model.score(text(i % 2)) >= 0.5) == bool(i % 2) for i in range(20))


def test_odd(spark):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = op5.fit(odd(spark).withColumn("quality", F.lit(5)), labels)
    rows = op5.score(odd(spark), model, "doc_id").collect()
    assert len(rows) == len(ODD) and all(r.score == 0.5 for r in rows)
    assert op5.score(odd(spark).limit(0), model, "doc_id").count() == 0
