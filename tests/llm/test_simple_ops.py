"""Sharding, mixing and quality rules against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from placewright.llm import op06_sharding as op6
from placewright.llm import op08_mixing as op8
from placewright.llm import op10_quality_rules as op10

SF = "/root/testdata/sf0.001"
TYPES = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "a b c " * 40, "en", "s1", 3), (2, None, None, None, None), (3, "", "en", "s1", 0), (None, "x y", "en", "s2", 3), (4, "a b c " * 40, "en", "s1", 3), (4, "a b c " * 40, "en", "s1", 3), (5, "w " * 300_000, "de", "s3", 1), (6, "l1 a\nl1 a\n \n\nl1 a", "de", "s3", 1)]


def odd(spark):
    return spark.createDataFrame(ODD, TYPES)


def oracle(sql, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).df()


def same(df, want):
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda x: sorted(x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None), key=repr)
    assert rows(got) == rows(want)


def u(*parts):
    return (int(hashlib.md5("|".join("\x01" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def brute_shard(key, n):
    return max(range(n), key=lambda j: -1.0 / math.log(u("shard", j, key)))


def test_shards(spark):
    rows = op6.op6_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.shard, r.grown_shard) == (brute_shard(r.doc_id, 16), brute_shard(r.doc_id, 17))
        assert r.grown_shard in (r.shard, 16)
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()))
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_shard_slices_and_weights(spark, monkeypatch):
    monkeypatch.setattr(op6, "ROWS_A_TASK", 50)
    df = op6.assign(spark.range(2000).withColumnRenamed("id", "doc_id"), weights=[1.0, 3.0])
    out = op6.number(df, "shard", op6.uniform(F.col("doc_id"), salt="slot"), [F.col("doc_id")], "slot", 2000).collect()
    by = Counter(r.shard for r in out)
    assert 0.2 < by[0] / 2000 < 0.3
    for shard, n in by.items():
        mine = sorted((r for r in out if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(n))
        assert [u("slot", r.doc_id) for r in mine] == sorted(u("slot", r.doc_id) for r in mine)


def test_sharding_sql(spark):
    same(op6.op6_sharding(spark, "/root/testdata/sf0.01"), oracle(op6.ORACLE, "/root/testdata/sf0.01"))


def test_quality_sql(spark):
    same(op10.op10_quality_rules(spark, "/root/testdata/sf0.01"), oracle(op10.ORACLE, "/root/testdata/sf0.01"))


def test_slots_of_any_layout(spark, tmp_path):
    """Rows keep their slots when the table is written in another order and in other files; repeated rows have slots of their own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3, "text").sortWithinPartitions(F.desc("doc_id")).write.parquet(str(tmp_path / "documents.parquet"))
    slots = lambda sf: sorted((r.doc_id, r.shard, r.slot) for r in op6.op6_sharding(spark, sf).collect())
    assert slots(str(tmp_path)) == slots(SF)


@pytest.mark.parametrize("few", [0, 1000])
def test_slots_of_repeated_rows(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(op6, "BROADCAST_KEYS", few)
    rows = [(1, "same")] * 40 + [(None, None)] * 30 + [(None, "")] * 5 + [(i, "x") for i in range(2, 30)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    out = op6.op6_sharding(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows)
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_slots_of_one_id(spark, tmp_path):
    """Rows without an id have slots of their own."""
    spark.createDataFrame([(None, f"text {i % 40}", "en", "s", 1) for i in range(100)], TYPES).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op6.op6_sharding(spark, str(tmp_path)).collect()
    assert len({r.shard for r in rows}) == 1
    assert sorted(r.slot for r in rows) == list(range(100))


def test_shard_odd(spark, tmp_path):
    assert op6.assign(odd(spark)).count() == len(ODD)
    assert op6.assign(odd(spark).limit(0)).count() == 0
    out = op6.assign(odd(spark).withColumn("Shard", F.lit(7)).withColumn("_shard", F.lit(8)))
    assert out.columns == [*odd(spark).columns, "__Shard", "_shard", "shard"]
    assert {(r["__Shard"], r["_shard"]) for r in out.collect()} == {(7, 8)} and all(0 <= r["shard"] < 16 for r in out.collect())
    op6.write_shards(odd(spark), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)


def test_mix_oracle(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        same(op8.op8_mixing(spark, sf), oracle(op8.ORACLE, sf))


def test_mix_targets(spark):
    sizes = [("a", 100, 5), ("b", 100000, 2), ("c", 3000, 1), (None, 10, 5), ("z", 0, 2)]
    got = {r.source: r.target for r in op8.targets(spark.createDataFrame(sizes, "source string, source_size long, weight long")).collect()}
    full, total = {}, sum(s for _, s, _ in sizes)
    while True:
        rest = [(k, s, w) for k, s, w in sizes if k not in full]
        level = (total - sum(full.values())) / max(sum(w for *_, w in rest), 1e-9)
        over = [(k, s) for k, s, w in rest if level * w >= 3 * s]
        if not over:
            break
        full |= {k: 3 * s for k, s in over}
    want = full | {k: level * w for k, s, w in rest}
    assert got == pytest.approx(want)


def brute_plan(docs, weights):
    """For each document (id, words, source) its inclusion probability and stratum, whole copies by source and sample sizes by stratum, all anew."""
    sizes = Counter()
    for _, n, source in docs:
        sizes[source] += n
    full, total = {}, sum(sizes.values())
    while True:
        rest = [k for k in sizes if k not in full]
        level = (total - sum(full.values())) / sum(weights[k] for k in rest)
        over = [k for k in rest if level * weights[k] >= 3 * sizes[k]]
        if not over:
            break
        full |= {k: 3 * sizes[k] for k in over}
    aim = full | {k: level * weights[k] for k in rest}
    lean = lambda n: (min(n, 1000) + 1) / (min(n, 1000) + 51)
    chance, strata, size = {}, {}, {}
    whole = {k: int(aim[k] / sizes[k] + 1e-9) if sizes[k] else 0 for k in sizes}
    for source in sizes:
        mine = [(i, n) for i, n, s in docs if s == source and n]
        due = max(0.0, aim[source] - whole[source] * sizes[source])
        low, high = 0.0, 100.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(1, mid * lean(n)) for _, n in mine) < due else (low, mid)
        for i, n in mine:
            chance[i] = min(1, low * lean(n))
            strata[i] = (source, n.bit_length(), n >> max(0, n.bit_length() - 4))
        left = 0.0
        for st in sorted({strata[i] for i, _ in mine}, key=lambda x: x[1:], reverse=True):
            here = [(i, n) for i, n in mine if strata[i] == st]
            mean = sum(n for _, n in here) / len(here)
            left += sum(n * chance[i] for i, n in here)
            size[st] = min(len(here), max(0, math.floor(left / mean + 0.5)))
            left -= size[st] * mean
    return aim, whole, chance, strata, size


def brute_mix(docs, planned, draw):
    aim, whole, chance, strata, size = planned
    by = {}
    for i, n, _ in docs:
        if n:
            q = math.inf if chance[i] == 0 else draw(i) / (1 - draw(i)) * ((1 - chance[i]) / chance[i])
            by.setdefault(strata[i], []).append((q, i))
    taken = {i for st, rows in by.items() for _, i in sorted(rows)[: size[st]]}
    return {i: whole[s] + (i in taken) for i, _, s in docs}


def mixed_docs(rng, n):
    length = lambda: rng.choice([rng.randint(1, 60), rng.randint(1, 8), rng.randint(200, 3000)])
    return [(i, length(), rng.choice(["a", "a", "a", "b", "b", "c", None])) for i in range(n)]


def test_mix_against_brute_force(spark, monkeypatch):
    docs = [*mixed_docs(random.Random(3), 500), (500, 0, "a"), (501, 0, "empty")]
    df = spark.createDataFrame([(i, "w " * n, "en", s, 1) for i, n, s in docs], TYPES)
    planned = brute_plan(docs, {"a": 5, "b": 2, "c": 1, "empty": 5, None: 2})
    for salt, few in (("mix", 100_000), ("other", 0)):
        monkeypatch.setattr(op8, "SALT", salt)
        monkeypatch.setattr(op8, "BROADCAST_SOURCES", few)
        want = brute_mix(docs, planned, lambda i: u(salt, i, hashlib.md5(("w " * docs[i][1]).encode()).hexdigest()))  # noqa: B023
        got = Counter(r.doc_id for r in op8.mix(df).collect())
        assert got == Counter({i: c for i, c in want.items() if c})


def test_mix_probabilities_over_many_draws():
    """The share of draws that take a document is its inclusion probability, up to the rounding of sample sizes; words come near the target every time."""
    docs = mixed_docs(random.Random(5), 3000)
    planned = brute_plan(docs, {"a": 5, "b": 2, "c": 1, None: 5})
    aim, whole, chance, strata, size = planned
    rng, draws = random.Random(6), 150
    seen = Counter()
    for _ in range(draws):
        drawn = {i: rng.random() for i, *_ in docs}
        taken = brute_mix(docs, planned, drawn.__getitem__)
        words = Counter()
        for i, n, s in docs:
            words[s] += taken[i] * n
            seen[i] += taken[i] - whole[s]
        for s, target in aim.items():
            assert abs(words[s] - target) <= 0.01 * target + 20
    for st in size:
        mine = [i for i in strata if strata[i] == st]
        aimed = sum(chance[i] for i in mine)
        if len(mine) >= 20 and aimed > 2:
            assert abs(sum(seen[i] for i in mine) / draws - aimed) <= 1  # the rounding
            for i in mine:
                p = min(1.0, chance[i] * size[st] / aimed)
                assert abs(seen[i] / draws - p) <= 5 * math.sqrt(p * (1 - p) / draws) + 0.03
    shorter = [chance[i] for i, n, s in docs if s == "b" and n < 5]
    longer = [chance[i] for i, n, s in docs if s == "b" and n > 500]
    assert max(shorter) < min(longer)


@pytest.mark.parametrize("few", [500_000, 0])
def test_mix_repeated_rows(spark, monkeypatch, few):
    """Rows that are equal are sampled like others: some of them are taken, and the words come near the target, in any layout."""
    monkeypatch.setattr(op8, "BROADCAST_KEYS", few)
    text = " ".join(f"w{i}" for i in range(20))
    lone = [(10_000 + i, " ".join(["v"] * (15 + i % 11)), "en", "b", 1) for i in range(40)]
    for equal in (2, 1000):
        rows = [(1, text, "en", "a", 1)] * equal + [(i, text, "en", "a", 1) for i in range(2, 1002 - equal)] + lone
        df = spark.createDataFrame(rows, TYPES)
        size = Counter()
        for _, t, _, s, _ in rows:
            size[s] += len(t.split())
        a = 5 * sum(size.values()) / 7
        aim = {"b": min(sum(size.values()) - a, 3 * size["b"])}
        aim["a"] = sum(size.values()) - aim["b"]
        got = Counter()
        for r in op8.mix(df.repartition(7) if few else df).collect():
            got[r.source] += len(r.text.split())
        assert all(abs(got[s] - aim[s]) <= 25 for s in aim), (equal, got, aim)
    every = spark.createDataFrame([(None, text, "en", "a", 1)] * 50 + [(None, text, "en", None, 1)] * 50, TYPES)
    taken = Counter(r.source for r in op8.mix(every).collect())
    assert abs(taken["a"] - 100 * 5 / 7) <= 1 and abs(taken[None] - 100 * 2 / 7) <= 1


def test_mix_sql_of_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id % 5 = 0")).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(op8.op8_mixing(spark, str(tmp_path)), con.execute(op8.ORACLE).df())


def test_mix_odd(spark):
    assert op8.mix(odd(spark)).count() >= 1
    assert op8.mix(odd(spark).limit(0)).count() == 0
    clash = odd(spark)
    for i, name in enumerate(["size", "copies", "target", "_x", "_size", "_d", "_doc", "_copy", "u", "whole", "a`b", "c.d", "stratum"]):
        clash = clash.withColumn(name, F.lit(f"keep{i}"))
    out = op8.mix(clash)
    assert out.columns == clash.columns
    for r in out.collect():
        assert r["_size"] == "keep4" and r["_x"] == "keep3" and r["a`b"] == "keep10" and r["c.d"] == "keep11" and r["u"] == "keep8"
    again = Counter(r.doc_id for r in op8.mix(odd(spark).repartition(5)).collect())
    assert again == Counter(r.doc_id for r in op8.mix(odd(spark)).collect()) and max(again.values()) <= 6


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if count[w] > 1 for d in range(3)}
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), base


def test_quality_figures(spark, monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 90))) for _ in range(150)]
    texts += [None, "", "\n\n", " a\x0bb\x1cc d ", "x\n x\nx\nx", "# <b> $5 |", "é😀 ü 😀😀 é😀", "a " * 5000, "l a\nl a\n\nl a", "a b c a b c d e f", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for slot in (20, 3):
        monkeypatch.setattr(op10, "_SLOT", slot)
        for r in op10.figures(df, F.col("doc_id")).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id]), texts[r.doc_id]


def test_binomial(spark):
    cases = [(0, 10), (0, 500), (2, 300), (5, 1000), (9, 1000), (10, 1000), (3, 5), (0, 0), (40, 20000)]
    got = spark.createDataFrame(cases, "k long, n long").withColumn("p", op10.binomial_tail(F.col("k"), F.col("n"), 0.01)).collect()
    for r in got:
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.01) + (r.n - j) * math.log(0.99)) for j in range(r.k + 1)) if r.k < r.n * 0.01 else 1
        assert r.p == pytest.approx(want, rel=1e-6)


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op10.op10_quality_rules(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d.doc_id]
        assert tuple(r)[1:7] == brute_quality(d.text)
    want = brute_kept([(d.doc_id, d.text, d.lang) for d in docs], list(labels.items()))
    assert {i: r.kept for i, r in rows.items()} == want
    good = [rows[i] for i, q in labels.items() if q == 1 and not rows[i].base_failed]
    assert sum(not r.kept for r in good) <= 0.05 * len(good)


def brute_kept(docs, labels):
    """doc_id to verdict of (doc_id, text, lang): cutoffs by exact binomial tails in whole numbers."""
    from fractions import Fraction

    figures = {}
    for i, text, _ in docs:
        n, chars, symbols, dup, repeat, base = brute_quality(text)
        lines = (text or "").count("\n") + 1
        figures[i] = base, {"symbols_a_word": symbols / max(n, 1), "dup_lines": dup / lines, "repeats": repeat / max(n, 1), "capitals": len(re.findall("[A-Z]", text or "")) / max(chars, 1), "word_length": chars / max(n, 1)}
    good = {i for i, q in labels if q == 1}
    holdout = {}
    for i, _, lang in docs:
        if i in good and not figures[i][0]:
            holdout.setdefault(lang, []).append(figures[i][1])
    risk, level = Fraction(op10.RISK) / len(op10.LADDERS), Fraction(op10.LEVEL) / (len(holdout) * len(op10.LADDERS)) if holdout else 0
    limits = {}
    for lang, rows in holdout.items():
        for rule, ladder in op10.LADDERS.items():
            for cut in ladder:
                k, n = sum(r[rule] > cut for r in rows), len(rows)
                tail = sum(math.comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1)) if k < n * risk else 1
                if tail > level:
                    break
                limits[lang, rule] = cut
    return {i: not figures[i][0] and not any(v > limits.get((lang, rule), math.inf) for rule, v in figures[i][1].items()) for i, _, lang in docs}


def test_quality_verdicts_against_brute_force(spark, monkeypatch):
    """Cutoffs and verdicts, with tables of cutoffs broadcast and joined."""
    rng = random.Random(8)
    docs = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(rng.randint(45, 120))) + rng.choice(["", " $$ # % " * rng.randint(1, 30), "\nAB CD EF" * rng.randint(1, 9)]), rng.choice(["en", "en", "en", "de", None])) for i in range(700)]
    sf = "/root/testdata/sf0.01"
    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    known = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    made = [(i, int("$" not in t)) for i, t, _ in docs]
    for rows, labels, risk in ((real, known, 0.05), (docs, made, 0.5), (docs, made[:5], 0.5)):
        monkeypatch.setattr(op10, "RISK", risk)
        monkeypatch.setattr(op10.cutoffs, "__defaults__", (risk, op10.LEVEL))
        want = brute_kept(rows, labels)
        assert risk == 0.05 or len(labels) < 9 or 0 < sum(want.values()) < sum(not brute_quality(t)[-1] for _, t, _ in rows)
        table, quality = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
        for few in (op10.BROADCAST_STRATA, 0):
            monkeypatch.setattr(op10, "BROADCAST_STRATA", few)
            assert {r.doc_id for r in op10.passing(table, quality).collect()} == {i for i, kept in want.items() if kept}


def test_quality_odd(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    clash = odd(spark).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(0)).withColumn("_text", F.lit(0))
    out = op10.passing(clash, labels)
    assert out.columns == clash.columns
    assert {r.doc_id for r in out.collect()} == set()
    assert op10.passing(odd(spark).limit(0), labels.limit(0)).count() == 0
