"""License scans against brute force."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from placewright.llm import op03_licenses as op3

from .test_decontamination import words
from .test_simple_ops import ODD, odd, oracle, same


def brute_base(text):
    w = words(text)
    at = [(i, name) for p, name in op3.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in at}))


def test_query_base(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3.op3_licenses(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
        if re.search(r"GNU General Public License, version 3", texts[r.doc_id]):
            assert "gpl-3" in r.labels.split(",")
    assert any("gpl-3" in r.labels for r in rows)


def test_templates_and_near_misses(spark):
    rng = random.Random(2)
    texts = [f"lorem ipsum {i} dolor " * rng.randint(1, 20) for i in range(40)]
    texts += [f"head words {text} tail" for _, text, _ in op3.TEMPLATES]
    texts += ["gnu license general public", "released mit under the license", "UNDER the MIT-license under the mit license", "cc by nc cc by nc cc by nc", "apache license version 20", "mit license " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in op3.report(df, "doc_id").collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t)
        if i < 40:
            assert r.labels == "" and r.score == 0
    for j, (name, _, _) in enumerate(op3.TEMPLATES):
        assert name in rows[40 + j].labels.split(",")
    assert rows[40 + len(op3.TEMPLATES)].labels == "" and rows[41 + len(op3.TEMPLATES)].labels == ""


def test_text_full_of_phrases(spark):
    text = "under the mit license cc by nc all rights reserved no part may be reproduced " * 5000
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "all rights reserved")], "doc_id long, text string")
    rows = op3.report(df, "doc_id").collect()
    assert len(rows) == 4
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text if r.doc_id != 2 else "all rights reserved")
        assert ("proprietary" in r.labels) == (r.doc_id != 2)


def test_several_templates_in_one_file(spark):
    """Each template keeps its label however many others stand beside it."""
    plain = [f"lorem ipsum {i}" for i in range(30)]
    texts = [" filler words ".join(text for _, text, _ in op3.TEMPLATES[:n]) for n in range(2, len(op3.TEMPLATES) + 1, 3)]
    texts += [" filler words ".join(text for _, text, _ in op3.TEMPLATES[-n:]) for n in range(2, len(op3.TEMPLATES) + 1, 3)]
    rows = {r.doc_id: r for r in op3.report(spark.createDataFrame(list(enumerate(plain + texts)), "doc_id long, text string"), "doc_id").collect()}
    for i, text in enumerate(texts):
        assert {name for name, template, _ in op3.TEMPLATES if template in text} <= set(rows[len(plain) + i].labels.split(","))
    assert all(rows[i].labels == "" for i in range(len(plain)))


def brute_tags(text):
    """Labels of SPDX expressions, read token by token."""
    known = {i: name for name, ids in op3.SPDX.items() for i in ids}
    found = set()
    for line in (text or "").split("\n"):
        for tail in re.split(r"(?i)spdx-license-identifier[ \t]*:", line)[1:]:
            due = True
            for token in re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*|[^ \t]", tail):
                if token in "()":
                    continue
                operator = token.upper() in ("AND", "OR", "WITH")
                if operator == due or not re.match(r"[A-Za-z0-9]", token):
                    break
                if operator:
                    skip = token.upper() == "WITH"
                else:
                    name = re.sub(r"(-only|-or-later|[+.-]+)$", "", token.lower())
                    if due != "skip":
                        found.add(known.get(re.sub(r"[^a-z0-9]+", " ", name).strip()))
                due = ("skip" if skip else True) if operator else False
                skip = False
    return found - {None}


def brute_labels(texts, templates=None):
    """Labels and score of each text by trying every window of starts of every template."""
    templates = [(name, words(text), [words(p) for p in keys]) for name, text, keys in templates or op3.TEMPLATES]
    split = {i: words(t) for i, t in texts.items()}
    held = Counter(w for ws in split.values() for w in set(ws))
    idf = lambda w: round(max(0.0, math.log((len(split) + 1) / (held[w] + 0.5))), 6)
    out = {}
    for i, ws in split.items():
        found, best = set(), 0.0
        for name, tw, keys in templates:
            slack = math.ceil(len(tw) / 3)
            order = sorted({w for w in tw if w not in op3.COMMON}, key=lambda w: (-idf(w), w))
            rare = {w for n, w in enumerate(order) if n < op3.LEAST or held[w] <= op3.RARE * len(split)}
            weight = round(sum(idf(w) for w in tw if w in rare), 6)
            starts = {}
            for p, w in enumerate(tw):
                for at in [a for a, x in enumerate(ws) if x == w and w in rare]:
                    for b in ((at - p) // slack, (at - p) // slack - 1):
                        starts.setdefault(b, set()).add(p)
            for b, places in starts.items():
                share = round(min(1.0, round(sum(idf(tw[p]) for p in places), 6) / weight), 6) if weight else 0
                inside = lambda s: s // slack in (b, b + 1)  # noqa: B023, E731
                at = lambda key, ws: {a for a in range(len(ws)) if ws[a : a + len(key)] == key}
                if share >= op3.ENOUGH and all(any(inside(a - min(at(k, tw))) for a in at(k, ws)) for k in keys):
                    found.add(name)
                    best = max(best, share)
        base, tags = brute_base(texts[i]), brute_tags(texts[i])
        out[i] = ",".join(sorted(found | tags | set(filter(None, base[4].split(","))))), 1.0 if base[1] or tags else best
    return out


GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
CLAUSE = "Redistribution and use in source and binary forms, with or without modification, are permitted"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


def test_labels_against_brute_force(spark):
    rng = random.Random(12)
    bits = [text for _, text, _ in op3.TEMPLATES] + [GRANT, CLAUSE, GPL, "SPDX-License-Identifier: GPL-3.0-or-later", "under the MIT license", "gnu general public license", "version 2", "version 3", "license"]
    noise = lambda n: " ".join(rng.choice(["lorem", "ipsum", "software", "the", "license", "public", "of"]) for _ in range(n))
    texts = {i: f"plain words {i}" for i in range(60)}
    for i in range(100, 220):
        said = rng.choices(bits, k=rng.randint(1, 5))
        for k in range(len(said)):
            if rng.random() < 0.5:
                w = said[k].split()
                for _ in range(rng.randint(1, 6)):
                    at = rng.randrange(len(w) + 1)
                    w[at : at + rng.choice([0, 0, 1])] = rng.choice([[], [f"x{i}"], ["the", "software"]])
                said[k] = " ".join(w)
        texts[i] = " ".join(noise(rng.randint(0, 30)) + " " + x for x in said)
    texts |= {300: f"{GRANT}. {CLAUSE}.", 301: GPL, 302: GPL.replace("3", "2"), 303: "/* SPDX-License-Identifier: GPL-3.0-or-later */", 304: GPL.replace("General", "Lesser General"), 305: GPL.replace("modify it", "modify it, as you like it best, here"), 306: None, 307: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: (r.labels, r.score) for r in op3.report(df, "doc_id").collect()}
    assert rows == brute_labels(texts)
    assert [rows[i][0] for i in range(300, 308)] == ["bsd,mit", "gpl-3", "gpl-2", "gpl-3", "lgpl-3", "gpl-3", "", ""]


EXPRESSIONS = {
    "SPDX-License-Identifier: (MIT AND BSD-3-Clause)": "bsd,mit",
    "# SPDX-License-Identifier: Apache-2.0 OR MIT": "apache-2,mit",
    "// spdx-license-identifier:GPL-2.0-only WITH Linux-syscall-note */": "gpl-2",
    "SPDX-License-Identifier: ((MPL-2.0 OR LGPL-3.0+) AND CC0-1.0) and more": "cc0,lgpl-3,mpl-2",
    "SPDX-License-Identifier: ISC OR (GPL-3.0-or-later WITH Bison-exception-2.2 AND CC-BY-4.0)": "cc-by,gpl-3",
    "SPDX-License-Identifier: ISC\nMIT": "",
    "SPDX-License-Identifier:": "",
    "SPDX-License-Identifier: MIT SPDX-License-Identifier: Apache-2.0.": "apache-2,mit",
    "Mozilla Public License Version 2.0": "mpl-2",
}


def test_spdx_expressions(spark, tmp_path):
    texts = {i: f"plain words {i}" for i in range(60)} | {100 + i: t for i, t in enumerate(EXPRESSIONS)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: (r.labels, r.score) for r in op3.report(df, "doc_id").collect()}
    assert [rows[100 + i][0] for i in range(len(EXPRESSIONS))] == list(EXPRESSIONS.values())
    assert rows == brute_labels(texts)
    frame = pd.DataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], columns=["doc_id", "text", "lang", "source", "n_chars"])
    for name in ("documents", "benchmark", "labels", "conversations", "pages"):
        frame.to_parquet(tmp_path / f"{name}.parquet")
    same(op3.op3_licenses(spark, str(tmp_path)), oracle(op3.ORACLE, str(tmp_path)))


MIT_TEXT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."""


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no full texts here")
def test_full_texts(spark):
    """Whole licence texts are found by the markers, and as templates of their own."""
    full = {n: Path(f"/usr/share/common-licenses/{n}").read_text() for n in ("GPL-3", "Apache-2.0", "BSD", "MPL-2.0") if Path(f"/usr/share/common-licenses/{n}").exists()}
    full["MIT"] = MIT_TEXT
    texts = [*full.values(), *[f"plain words {i}" for i in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r.doc_id: set(r.labels.split(",")) for r in op3.report(df, "doc_id").collect()}
    known = {"GPL-3": "gpl-3", "Apache-2.0": "apache-2", "BSD": "bsd", "MPL-2.0": "mpl-2", "MIT": "mit"}
    assert all(known[n] in labels[i] for i, n in enumerate(full))
    table = spark.createDataFrame([(f"{n} in full", t, None) for n, t in full.items()], "label string, text string, phrases array<string>")
    labels = {r.doc_id: set(r.labels.split(",")) for r in op3.report(df, "doc_id", templates=table).collect()}
    assert all(f"{n} in full" in labels[i] for i, n in enumerate(full)) and all(labels[i] == {""} for i in range(len(full), len(texts)))


def test_templates_of_the_caller(spark):
    """A table of full texts, found in part and with words put in between; a phrase that isn't in its template is refused."""
    rng = random.Random(13)
    long = {name: [f"{name}{rng.randint(0, 300)}" if rng.random() < 0.7 else "software" for _ in range(900)] for name in ("alpha", "beta")}
    table = [(name, " ".join(ws), [" ".join(ws[400:404])]) for name, ws in long.items()] + [("short", "you may copy gamma", None)]
    texts = {i: f"software {i}" for i in range(30)}
    texts |= {40: " ".join(long["alpha"]), 41: " ".join(long["beta"][:450]), 42: " ".join(x for j, w in enumerate(long["alpha"]) for x in ([w, "put", "in"] if j % 9 == 0 and not 398 < j < 406 else [w])), 43: "you may copy gamma " + " ".join(long["beta"]), 44: " ".join(sorted(long["beta"]))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    templates = spark.createDataFrame(table, "label string, text string, phrases array<string>")
    rows = {r.doc_id: (r.labels, r.score) for r in op3.report(df, "doc_id", templates=templates).collect()}
    assert rows == brute_labels(texts, [(a, b, c or []) for a, b, c in table])
    assert [rows[i][0] for i in range(40, 45)] == ["alpha", "", "alpha", "beta,short", ""]
    with pytest.raises(ValueError):
        op3.index(spark.createDataFrame([("x", "one two", ["two one"])], templates.schema))


def test_sql(spark, tmp_path):
    """The tables' files, and files of several templates with words put in, left out and said twice."""
    same(op3.op3_licenses(spark, "/root/testdata/sf0.01"), oracle(op3.ORACLE, "/root/testdata/sf0.01"))
    rng, texts = random.Random(11), [None, "", "LICENSE", "under the MIT license under the mit-license"]
    for i in range(120):
        said = []
        for _, text, _ in rng.sample(op3.TEMPLATES, rng.randint(0, 4)):
            for w in text.split():
                said += [w] * rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 0, 2]) + [f"über{i}"] * (rng.random() < 0.1)
            said += [rng.choice(["Filler", "code", "the", "license"]) for _ in range(rng.randint(0, 6))]
        texts.append(" ".join(said))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*texts, *texts[50:60]])]
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    for name in ("documents", "benchmark", "labels", "conversations", "pages"):
        frame.to_parquet(tmp_path / f"{name}.parquet")
    got = op3.op3_licenses(spark, str(tmp_path))
    same(got, oracle(op3.ORACLE, str(tmp_path)))
    assert got.where("labels != base_labels").count() > 20


def test_odd(spark):
    df = odd(spark).withColumn("hits", F.lit(1)).withColumn("word", F.lit("x"))
    assert op3.report(df.select("doc_id", F.xxhash64("text").alias("k"), "text"), "doc_id", "k").count() == len(ODD)
    assert op3.report(df.select("doc_id", "text").limit(0), "doc_id").count() == 0
