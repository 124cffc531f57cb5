"""The corpus pipeline, stage by stage, against brute force."""

import random
from collections import Counter

import corpus_pipeline
from placewright.llm import op04_simhash as op4
from placewright.llm import op08_mixing as op8
from placewright.llm import op10_quality_rules as op10

from .test_decontamination import brute as brute_hits
from .test_simhash import brute_components, brute_fingerprint
from .test_simple_ops import brute_quality, brute_shard, oracle, same

SF = "/root/testdata/sf0.001"


def test_sql(spark):
    same(corpus_pipeline.run(spark, SF), oracle(corpus_pipeline.ORACLE_SQL, SF))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns

    docs = corpus_pipeline.quality(spark, docs, SF)
    kept = {r.doc_id: r.text for r in docs.collect()}
    verdict = {r.doc_id: r.kept for r in op10.op10_quality_rules(spark, SF).collect()}
    assert kept == {i: t for i, t in before.items() if verdict[i]}
    assert not any(brute_quality(t)[-1] for t in kept.values())

    docs = corpus_pipeline.near_dedup(spark, docs, SF)
    comp = brute_components({i: brute_fingerprint(t) for i, t in kept.items()})
    single = {r.doc_id: r.text for r in docs.collect()}
    assert single == {i: t for i, t in kept.items() if comp[i] == i}

    docs = corpus_pipeline.decontaminate(spark, docs, SF)
    clean = {r.doc_id: r.text for r in docs.collect()}
    assert clean == {i: t for i, t in single.items() if not brute_hits(t, items)[-1]}

    _, shares, _ = op8.shares_of(docs)
    aim = {r.source: (r.target, r.source_size) for r in shares.collect()}
    docs = corpus_pipeline.mixing(spark, docs, SF)
    assert docs.columns == columns
    rows = docs.collect()
    words = Counter()
    for r in rows:
        words[r.source] += len(r.text.split())
    for source, (target, size) in aim.items():
        assert abs(words[source] - target) <= size
    assert max(Counter(r.doc_id for r in rows).values()) <= 3

    out = corpus_pipeline.sharding(spark, docs, SF).collect()
    assert all(r.shard == brute_shard(r.doc_id, 16) for r in out)
    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.shard) for r in whole.collect()) == Counter((r.doc_id, r.shard) for r in out)


def test_odd_rows(spark):
    """Nulls in any column, long texts, repeated rows and clashing names go through all stages with the results that the docstring names."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))
    long, plain = prose(30_000), [prose(200) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", i) for i, t in enumerate(plain)] + [(0, plain[0], "en", "s0", 0)] * 4
    rows += [(100, None, "en", "s1", 1), (101, "", None, None, None), (None, plain[1], None, None, None), (102, long, None, None, 7), (103, plain[2], "en", "s1", None), (None, prose(90), "de", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for i, name in enumerate(["shard", "_doc", "kept", "size", "copies", "spans", "fp", "class", "n_words", "_id", "a`b"]):
        docs = docs.withColumn(name, F.lit(f"keep{i}"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "sharding":
            assert docs.columns == columns
        if name == "simhash near-dedup":
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len(set(texts))
    out = docs.collect()
    assert docs.columns == ["_shard" if c == "shard" else c for c in columns] + ["shard"]
    assert all(r["_shard"] == "keep0" and r["a`b"] == "keep10" and 0 <= r["shard"] < 16 for r in out)
    ids = Counter(r.doc_id for r in out)
    assert not {100, 101, 103} & set(ids) and max(ids.values()) <= 3
    assert {r.text for r in out} <= {*plain, long, rows[-1][1]}


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    assert op4.fingerprint(None) == 0
