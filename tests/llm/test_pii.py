"""Personal data against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from placewright.llm import op02_pii as op2

from .test_simple_ops import ODD, odd

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, rx) in enumerate(RAW.items()):
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d or "1"), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        assert [tuple(s) for s in r.base] == brute(texts[r.doc_id]), texts[r.doc_id]
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2.op2_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        joined = ",".join(f"{op2.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_random_texts(spark):
    rng = random.Random(11)
    bits = ["a", "b@", "c.d", "@x.y", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "300.1.1.1", "001.002.3.255", "+1 (988) 555-2485", "+", "-", ".", " ", "%", "12", "5 5", "é😀", "\n", "(", ")", "49927398716", "79927398713"]
    texts = dict(enumerate("".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(600)))
    texts |= {700: "9" * 20000, 701: "a" * 20000 + "@", 702: "1." * 9000, 703: "a@" + "b." * 9000 + "c", 704: "+1" + " " * 9000, 705: "1.1.1.1 " * 3000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    check(op2.report(df, "doc_id").collect(), texts)


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(4)
    texts = {i: f"Words before. Please reach me at user{i}@mail.example.com thanks and bye." for i in range(12)}
    texts |= {20 + i: f"Words before. Please reach me at XK{rng.randint(100000, 999999)}QZ thanks and bye." for i in range(3)}
    texts |= {40 + i: f"The room {rng.randint(100000, 999999)}ab was empty number {i}." for i in range(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in op2.report(df, "doc_id").collect()}
    check(list(rows.values()), texts)
    for i in range(3):
        (span,) = rows[20 + i].spans
        assert texts[20 + i][span.start : span.end].startswith("XK") and op2.KINDS[span.kind] == "id"
    assert all(not rows[40 + i].spans for i in range(12))


def brute_graph(texts, base):
    """The instances that score enough, and their spans, from whole texts: tokens, neighbouring words, graph and rounds anew."""
    space = " \t\n\x0b\x0c\r"
    marks = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
    words = lambda t: re.findall(r"[^\W_]+", t)
    rows = []
    for i, text in texts.items():
        spans = [(s, e, k) for s, k, e in base(text)]
        tokens = [(m.start(), m.end()) for m in re.finditer(rf"(?:(?<![^{space}=:])[^{space}=:0-9]*[0-9]|(?<![^{space}])@|(?<=[=:] )[^{space}])[^{space}]*", text)]
        for s, e in tokens:
            raw = text[s:e]
            left, right = len(raw) - len(raw.lstrip(marks)), len(raw.rstrip(marks))
            bare = raw[left:right] if right > left else ""
            between = re.search(r"[\W_]*$", text[:s])[0]
            marked = any(c in between for c in "=:") or raw[0] == "@"
            if (len(bare) >= 6 and sum(c.isdigit() for c in bare) >= 3 or marked and len(bare) >= 4) and not any(s + left < b and a < s + right for a, b, _ in spans):
                rows.append((i, s, e, s + left, s + right, bare.lower(), bool(re.fullmatch("(?=.*[a-f])(?=.*[0-9])[0-9a-f]{32,}", bare.lower()) or re.fullmatch("AKIA[0-9A-Z]{16}", bare))))
        rows += [(i, s, e, None, None, text[s:e].lower(), True) for s, e, _ in spans]
    edges, seeds = {}, set()
    for i, s, e, _, _, name, seed in rows:
        before, after = words(texts[i][:s]), words(texts[i][e:])
        mark = re.search(r"([=:])[^=:\w]*$", texts[i][:s])
        said = [f"L {before[-2]} {before[-1]}".lower()] if len(before) > 1 else []
        said += [f"M {before[-1]} {after[0]}".lower()] if before and after else []
        said += [f"K {before[-1]} {mark[1]}".lower()] if before and mark and not re.search(r"[^\W_]", texts[i][mark.start() : s]) else []
        for p in said:
            edges.setdefault(p, set()).add(name)
        if seed:
            seeds.add(name)
    scores = dict.fromkeys(seeds, 1.0)
    while True:
        conf = {}
        for p, names in edges.items():
            total = sum(scores[n] for n in names if scores.get(n, 0) >= 0.8)
            c = total / (total + 0.25 * (len(names) - total) + 1)
            if total >= 3 and c >= 0.6:
                conf[p] = c
        new = dict.fromkeys(seeds, 1.0)
        for n in set().union(*edges.values()) - seeds:
            mine = [p for p in edges if n in edges[p] and len(edges[p]) >= 3]
            miss = 1.0
            for p in mine:
                miss *= 1 - conf.get(p, 0)
            if miss < 1:
                new[n] = round((1 - miss) * (1 if re.search("[0-9]", n) else sum(p in conf for p in mine) / len(mine)), 4)
        if new == scores:
            break
        scores = new
    return {(i, a, b) for i, _, _, a, b, name, _ in rows if a is not None and scores.get(name, 0) >= 0.8}


def test_bootstrapping_against_brute_force(spark, monkeypatch):
    """Planted identifiers of several shapes beside seeds, found over chains of patterns; the recall is that of the method, and spans are those of the brute force."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("bcdfghjklm", k=5))
    fill = lambda n: " ".join(word() for _ in range(n))
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    texts, planted, clean = {}, [], set()
    for i in range(400):
        kind = 3 if i % 16 in (12, 13) else i % 8
        value, frame = {
            0: (f"user{i}@mail.example.com", "contact me at {} or write"),
            1: (f"QX{rng.randint(10**6, 10**7)}", "contact me at {} or write"),
            2: (f"QX{rng.randint(10**6, 10**7)}", "member number {} is ours"),
            3: (hexes(40), 'token = "{}"'),
            4: (f"s3cr{rng.randint(100, 999)}-{word()}", 'token = "{}"'),
            5: (f"@{word()}{word()}", "token = {}"),
            6: (f"lot{rng.randint(1000, 9999)}", "the crate {} arrived"),
            7: (str(rng.randint(1000, 9999)), "in the year {}"),
            8: ("AKIA" + "".join(rng.choices("ABCDEF0123456789", k=16)), "{} it is"),
        }[8 if i % 40 == 14 else kind]
        texts[i] = f"{fill(rng.randint(2, 30))} {frame.format(value)}\n{fill(rng.randint(0, 9))}"
        if kind in (1, 3, 4, 5):
            planted.append((i, texts[i].index(value), len(value)))
        if kind in (6, 7) and i % 40 != 14:
            clean.add(i)
    # Numbers of members stand in two contexts: the one with mail addresses names them, and they name the other one.
    for i in range(60):
        # "chat" is a word like others: it stands after a mark once in a while, and in many places.
        texts[2000 + i] = f"{fill(3)} {rng.choice(['token = chat', 'note: chat', 'as: chat', 'we: chat', 'say: chat'])} {fill(2)} plan: word {fill(2)}"
        texts[1000 + i] = f"{fill(4)} member number QX{7_000_000 + i} is ours {fill(3)} contact me at QX{7_000_000 + i} or write {fill(2)}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = op2.report(df, "doc_id").collect()
    monkeypatch.setattr(op2, "BROADCAST_SCORES", 0)
    assert sorted(map(repr, op2.report(df, "doc_id").collect())) == sorted(map(repr, rows))
    check(rows, texts)
    got = {(r.doc_id, s.start, s.end) for r in rows for s in r.spans if op2.KINDS[s.kind] == "id"}
    assert got == brute_graph(texts, brute)
    recall = sum(any(i == d and s < at + n and at < e for d, s, e in got) for i, at, n in planted) / len(planted)
    assert recall == 1.0
    by_chain = [i for i in range(400) if i % 8 == 2]
    assert all(any(d == i for d, *_ in got) for i in by_chain)
    assert not any(d in clean for d, *_ in got)


def test_words_beside_are_whole(spark):
    """A word of any length, and words within the match before, make patterns."""
    long = "x" * 500
    texts = {i: f"{long} of me{i}@mail.example.com y" for i in range(6)} | {10: f"{long} of ABC123456 z", 11: "a 111222 333444 555666 b"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in op2.report(df, "doc_id").collect()}
    assert [(op2.KINDS[s.kind], s.start) for s in rows[10].spans] == [("id", 504)]
    found = op2.placed(op2.matches(df, "doc_id"), "doc_id").where("doc_id = 11").orderBy("start").collect()
    assert [(r.two, r.one, r.next) for r in found] == [("", "a", "333444"), ("a", "111222", "555666"), ("111222", "333444", "b")]


def test_odd(spark):
    df = odd(spark).withColumn("found", F.lit(1)).withColumn("kind", F.lit(2))
    assert op2.report(df.select("doc_id", F.xxhash64("text").alias("k"), "text"), "doc_id", "k").count() == len(ODD)
    assert op2.report(df.select("doc_id", "text").limit(0), "doc_id").count() == 0
