"""Benchmark decontamination against SQL and brute force."""

import hashlib
import re

from pyspark.sql import functions as F

from placewright.llm import op01_decontamination as op1

from .test_simple_ops import ODD, TYPES, odd, oracle, same


def words(text):
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        width = min(13, len(v))
        grams = {tuple(v[i : i + width]) for i in range(len(v) - width + 1)} if v else set()
        for i in range(len(w)):
            if width and tuple(w[i : i + width]) in grams:
                hit |= set(range(i, i + width))
                found.add(str(item))
    listed = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_oracle(spark):
    same(op1.op1_decontamination(spark, "/root/testdata/sf0.01"), oracle(op1.ORACLE, "/root/testdata/sf0.01"))


ITEMS = [(1, "One two three FOUR five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "éé ÉE"), (3, ""), (4, None), (11, "alpha beta"), (12, "alpha beta"), (5, " ".join(f"w{i}" for i in range(40)))]
TEXTS = ["one, two three four five six seven eight nine ten eleven twelve thirteen fourteen", "x " * 300 + "alpha-beta", "alpha beta alpha beta", "éé Ée éé ée éé ÉE", None, "", "...", "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen", " ".join(f"W{i}" for i in range(60)), "beta alpha", "w0 " * 5000]


def test_brute_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (op1.BLOCK, 7):
        monkeypatch.setattr(op1, "BLOCK", block)
        rows = op1.report(docs, items, "doc_id").collect()
        assert len(rows) == len(TEXTS)
        for r in rows:
            assert tuple(r)[1:6] == brute(TEXTS[r.doc_id], ITEMS), TEXTS[r.doc_id]


def test_spans_are_cut(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in op1.without_spans(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert out[2] == "   " and out[1] == "x " * 300 + "-" and out[4] is None and out[9] == "beta alpha" and out[5] == ""
    assert out[7].split() == ["fifteen"]


def test_spans_keep_other_columns(spark, monkeypatch):
    from placewright.llm import common

    docs = spark.createDataFrame([*enumerate(TEXTS), (2, TEXTS[2])], "doc_id long, text string")
    for i, name in enumerate(["spans", "_words", "_spans", "_id", "_text_key", "_doc", "_k", "a`b", "n_hit"]):
        docs = docs.withColumn(name, F.lit(f"keep{i}"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = None
    for most in (common.BROADCAST_KEYS, 0):
        monkeypatch.setattr(common, "BROADCAST_KEYS", most)
        out = op1.without_spans(docs, items)
        assert out.columns == docs.columns
        rows = sorted(map(tuple, out.collect()), key=repr)
        assert len(rows) == len(TEXTS) + 1 and all(r[2:] == tuple(f"keep{i}" for i in range(9)) for r in rows)
        assert want in (None, rows)
        want = rows
        kept = op1.clean(docs, items)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 9, 10]
    assert op1.without_spans(docs.limit(0), items).count() == 0


def test_odd(spark):
    items = spark.createDataFrame([(None, "a b c a b c")], "item_id long, text string")
    clash = odd(spark).withColumn("n_words", F.lit("x")).withColumn("_id", F.lit(0)).withColumn("spans", F.lit(0))
    out = op1.clean(clash, items)
    assert sorted(out.columns) == sorted(clash.columns)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 2), (False, 3), (False, 5), (False, 6), (True, 0)]
    keyed = odd(spark).select("doc_id", "text")
    assert op1.report(keyed, items, "doc_id").count() == len(ODD)
    assert op1.report(keyed, items.limit(0), "doc_id").where("contaminated").count() == 0
    assert op1.report(keyed.limit(0), items, "doc_id").count() == 0
    assert op1.clean(spark.createDataFrame([], TYPES), items).count() == 0
