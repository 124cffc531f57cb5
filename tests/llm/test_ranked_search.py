"""Ranked search against every document scored for every item."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from placewright.llm import op12_ranked_search as op12

from .test_simple_ops import oracle, same

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def terms(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=20):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            if not c:
                continue
            m = 100 - 25 + (25 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def ranked(spark, docs, items, k=20):
    found = op12.index(spark.createDataFrame(docs, DOCS).repartition(3), None)
    return sorted(map(tuple, op12.search(found, spark.createDataFrame(items, ITEMS), k).collect()), key=repr)


def test_oracle(spark):
    same(op12.op12_ranked_search(spark, SF), oracle(op12.ORACLE, SF))


@pytest.mark.parametrize(("tiers", "k"), [((1 << 10, 1 << 13, 1 << 16), 20), ((1, 2, 4), 5), ((3, 20, 60), 1)])
def test_tiers(spark, monkeypatch, tiers, k):
    """Whatever the tiers hold, the result is that of scoring everything."""
    monkeypatch.setattr(op12, "TIERS", tiers)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    odds = [1 / (i + 1) for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, odds, k=rng.choice([1, 3, 10, 60, 300])))) for i in range(250)]
    docs += [(1000 + i, docs[3][1]) for i in range(90)] + [(7, "w1 w1 w39"), (7, "w1 w1 w39"), (None, docs[5][1])]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(20)] + [(50, docs[3][1]), (51, "w0"), (52, "w39 w38")]
    assert ranked(spark, docs, items, k) == brute(docs, items, k)


def test_falls_through(spark, monkeypatch):
    """Small tiers leave items without proof, and they are read deeper."""
    monkeypatch.setattr(op12, "TIERS", (2, 4, 8))
    rounds = []
    before = op12._deeper
    monkeypatch.setattr(op12, "_deeper", lambda *a: rounds.append(1) or before(*a))
    docs = [(i, " ".join(f"w{j}" for j in range(12) if (i >> (j % 5)) & 1 or j == i % 12)) for i in range(120)]
    items = [(0, "w1 w2 w3 w4"), (1, "w5 w11")]
    assert ranked(spark, docs, items) == brute(docs, items)
    assert len(rounds) > 1


def test_odd(spark, monkeypatch):
    docs = [(1, None), (2, ""), (3, "..."), (4, "Été été ÉTÉ x"), (None, "x y"), (5, "x y"), (5, "x y"), (6, "longword" * 2000 + " x " + "z " * 50_000), (7, "Z z Ⅷ")]
    items = [(1, "X"), (1, "X"), (None, "y Y z"), (2, None), (3, ""), (4, "nowhere"), (5, "été ⅷ Ⅷ")]
    want = brute(docs, items)
    assert ranked(spark, docs, items) == want
    monkeypatch.setattr(op12, "BROADCAST_ROWS", 0)
    assert ranked(spark, docs, items) == want
    df = spark.createDataFrame(docs, DOCS).withColumn("row", F.lit("a")).withColumn("class", F.lit(1)).withColumn("n", F.lit(2))
    more = spark.createDataFrame(items, ITEMS).withColumn("item", F.lit("b")).withColumn("name", F.lit(0))
    assert sorted(map(tuple, op12.search(op12.index(df), more).collect()), key=repr) == want
    assert ranked(spark, docs, items[:0]) == []
    assert op12.search(op12.index(df.limit(0)), more).collect() == []


def test_bounds(spark, monkeypatch):
    """No posting is above the bound of a tier over its own, and no tier but the last holds more than it should."""
    monkeypatch.setattr(op12, "TIERS", (5, 30, 100))
    found = op12.index(spark.read.parquet(f"{SF}/documents.parquet"))
    joined = found.postings.join(found.terms, "term")
    assert joined.where((F.col("tier") > 0) & (F.col("impact") > F.get("bounds", F.col("tier") - 1))).count() == 0
    sizes = found.postings.groupBy("term", "tier").count().groupBy("tier").agg(F.max("count").alias("n")).collect()
    assert all(r.n <= (5, 30, 100, 10**9)[r.tier] for r in sizes)
    assert found.postings.count() == sum(len(set(terms(t))) for t in {r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()})
