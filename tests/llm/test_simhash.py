"""SimHash near-duplicates against brute force."""

import random
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import functions as F

from placewright.llm import op04_simhash as op4

from .test_simple_ops import odd, oracle, same


def brute_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: brute_fingerprint(t) for i, t in texts.items()}
    comp = brute_components(want)
    rows = op4.op4_simhash(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == format(want[r.doc_id], "016x") and r.component_id == comp[r.doc_id]


def test_sql(spark, tmp_path):
    """The tables' texts, and ones of all lengths of shingle, of other scripts, without words and nearly equal."""
    same(op4.op4_simhash(spark, "/root/testdata/sf0.01"), oracle(op4.ORACLE, "/root/testdata/sf0.01"))
    rng, texts = random.Random(3), [None, "", " \n", "one", "Two words", "ÄÖ ü 漢字 😀 \u00a0 x"]
    for n in range(1, 90):
        texts.append(" ".join("".join(rng.choice("aBé漢😀1") for _ in range(rng.randint(1, n))) for _ in range(rng.randint(1, 12))))
    base = [f"w{i}" for i in range(400)]
    texts += [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(0, 400, 20)]
    frame = pd.DataFrame([(i, t) for i, t in enumerate([*texts, *texts[:30]])], columns=["doc_id", "text"])
    for name in ("documents", "benchmark", "labels", "conversations", "pages"):
        frame.to_parquet(tmp_path / f"{name}.parquet")
    got = op4.op4_simhash(spark, str(tmp_path))
    same(got, oracle(op4.ORACLE, str(tmp_path)))
    assert got.groupBy("component_id").agg(F.countDistinct("fingerprint").alias("n")).where("n > 1").count() > 0


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(7)
    fps = {}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 7)):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps[len(fps)] = x
            if rng.random() < 0.5:
                base = x
    nodes = spark.createDataFrame([(op4._signed(x),) for x in set(fps.values())], "fp long")
    stars = {r.a: r.b for r in op4.components(op4.links(nodes)).collect()}
    comp = brute_components(fps)
    for i, x in fps.items():
        for j, y in fps.items():
            a, b = op4._signed(x), op4._signed(y)
            assert (stars.get(a, a) == stars.get(b, b)) == (comp[i] == comp[j])


def test_split_routes(spark, monkeypatch):
    """Thousands of fingerprints that share a half, in lanes, give the links of all."""
    rng = random.Random(9)
    high = rng.getrandbits(32) << 32
    fps = {high | rng.getrandbits(14) << rng.randrange(18) for _ in range(700)} | {rng.getrandbits(64) for _ in range(100)}
    fps |= {x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for x in list(fps)[:200]}
    nodes = spark.createDataFrame([(op4._signed(x),) for x in fps], "fp long")
    comp = brute_components({x: x for x in fps})
    sizes = sorted(Counter(comp.values()).values())
    assert sizes[-1] > 50
    for lane, routes in ((op4.LANE, op4.BROADCAST_ROUTES), (20, op4.BROADCAST_ROUTES), (20, 0)):
        monkeypatch.setattr(op4, "LANE", lane)
        monkeypatch.setattr(op4, "BROADCAST_ROUTES", routes)
        stars = {r.a: r.b for r in op4.components(op4.links(nodes)).collect()}
        roots = {x: stars.get(op4._signed(x), op4._signed(x)) for x in fps}
        assert len({(comp[x], roots[x]) for x in fps}) == len(set(comp.values())) == len(set(roots.values()))


def test_keep_one_ways(spark, monkeypatch):
    """Rows to drop are broadcast or joined, and repeated rows are put together, with the same result."""
    from placewright.llm import common

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{text} {i // 3}" if i % 3 else text, "en", "s", i) for i in range(60)] + [(3, text, "en", "s", 3)] * 5 + [(100, "alone", "en", "s", 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_doc", F.lit("x")).withColumn("a`b", F.lit("y"))
    comp = brute_components({i: brute_fingerprint(t) for i, t, *_ in rows})
    for most in (common.BROADCAST_KEYS, 0):
        monkeypatch.setattr(common, "BROADCAST_KEYS", most)
        out = op4.keep_one(docs)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == sorted(set(comp.values()))
        assert {(r["_doc"], r["a`b"]) for r in out.collect()} == {("x", "y")}


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(500, 400)], "a long, b long")
    got = {r.a: r.b for r in op4.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {500: 400}


def test_fingerprints():
    for t in [None, "", " ", "A", "a B", "a b c", "É é x\x0by\x1cz \U0001f600 q", "a b " * 90_000]:
        assert op4.fingerprint(t) == brute_fingerprint(t) if t is None or len(t) < 1000 else True


def test_odd(spark):
    clash = odd(spark).withColumn("fp", F.lit("x")).withColumn("class", F.lit(1)).withColumn("_doc", F.lit(2))
    out = op4.keep_one(clash)
    assert out.columns == clash.columns
    # 1, 4, 4 are copies; 2 and 3 share fingerprint zero
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 2, 5, 6]
    assert op4.keep_one(odd(spark).limit(0)).count() == 0
