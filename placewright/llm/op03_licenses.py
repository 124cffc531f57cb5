"""License scans by a positional rare-token index.

Licence templates are marking texts of any length, a table that the caller may supply. The index lists, for each of their rare
words, templates and positions; words are weighted by IDF over all files, and those in more than a tenth of the files aren't
looked up (but of each template the LEAST rarest are). A posting and a file position together name the place where the template
would start. Inserted words shift that place, so votes are gathered over windows of starts, as wide as a third of the template;
every start lies in two windows, so votes that lie a window's half apart meet in one. A template with enough of its weight in a
window is a candidate; it's reported if all its mandatory phrases stand where that window says.

Base phrases are found apart from that, at every place where their words stand consecutively. So are SPDX tags: the expression after
one is taken apart, and each licence in it gives its label (those after WITH are exceptions, not licences).

Defined results: null and empty texts have no words, no labels and score 0; rows are told apart by doc_id and text, repeated
rows get the same result each; an empty table gives an empty result; other columns aren't read. A phrase that occurs many times
is counted at every place. A template without words, or with a phrase that isn't in its text, is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import alnum_words, fence, settled, table

#: Fixed by the task: phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: What follows an SPDX tag; `only`, `or later` and a plus may follow that.
SPDX = {"mit": ["mit"], "apache-2": ["apache 2 0"], "gpl-3": ["gpl 3 0"], "gpl-2": ["gpl 2 0"], "lgpl-3": ["lgpl 3 0"], "agpl-3": ["agpl 3 0"], "bsd": ["bsd 2 clause", "bsd 3 clause"], "mpl-2": ["mpl 2 0"], "cc-by-nc": ["cc by nc 4 0"], "cc-by": ["cc by 4 0"], "cc-by-sa": ["cc by sa 4 0"], "cc0": ["cc0 1 0"]}


def _notice(licence: str, version: int) -> tuple[str, list[str]]:
    """The notice of a program under a GNU licence, and its mandatory phrases."""
    phrases = [f"gnu {licence} as published by the free software foundation", f"version {version} of the license"]
    return f"this program is free software you can redistribute it and or modify it under the terms of the {phrases[0]} either {phrases[1]} or at your option any later version", phrases


#: (label, marking text, its mandatory phrases).
TEMPLATES = [
    ("mit", "released under the terms of the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "free of charge"]),
    ("apache-2", "licensed under the apache license version 2", ["apache license version 2"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl-3", "gnu lesser general public license version 3", ["lesser general public license", "version 3"]),
    ("agpl-3", "gnu affero general public license version 3", ["affero general public license", "version 3"]),
    ("gpl-3", *_notice("general public license", 3)),
    ("gpl-2", *_notice("general public license", 2)),
    ("lgpl-3", *_notice("lesser general public license", 3)),
    ("agpl-3", *_notice("affero general public license", 3)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl-2", "mozilla public license version 2 0", ["mozilla public license", "2 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "creative commons attribution sharealike", ["creative commons attribution sharealike"]),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("proprietary", "all rights reserved no part may be reproduced", ["all rights reserved"]),
    *((name, f"spdx license identifier {x}", [f"spdx license identifier {x}"]) for name, xs in SPDX.items() for x in xs),
]
#: Words too common to look up.
COMMON = {"the", "of", "to", "is", "a", "any", "and", "in", "with", "or", "are", "this", "by", "no", "be", "may", "use", "all", "under", "without", "v", "0", "1", "2", "3", "4"}
#: Share of a template's weight that makes a candidate; share of files beyond which a word isn't rare, and words of a template that are looked up at least.
ENOUGH, RARE, LEAST = 0.75, 0.1, 8
#: Words of all templates together, at most: the index is broadcast, about 100 bytes a word.
MOST_WORDS = 500_000

_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
#: An SPDX tag and its expression, which ends with the line at the latest.
_TAG = rf"(?i)SPDX-License-Identifier[ \t]*:[ \t(]*({_ID}(?:[ \t)]+(?:AND|OR|WITH)[ \t(]+{_ID})*)"


@dataclass
class Index:
    """Templates as a table, and what is looked up in texts: words, and phrases by a word of theirs."""

    postings: DataFrame
    keys: DataFrame
    vocabulary: list[str]
    phrases: list[str]


def default_templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(name).alias("label"), F.lit(text).alias("text"), F.array(*map(F.lit, keys)).alias("phrases")) for name, text, keys in TEMPLATES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def index(templates: DataFrame) -> Index:
    """The index of a table of label, text and phrases (mandatory ones)."""
    rows = templates.select("label", alnum_words(F.col("text")).alias("words"), F.transform(F.coalesce("phrases", F.array().cast("array<string>")), lambda p: F.array_join(alnum_words(p), " ")).alias("phrases"))
    rows = settled(rows.distinct().withColumn("template", F.xxhash64("label", "words")).withColumn("slack", F.ceil(F.size("words") / 3).cast("int")), "templates")
    every = rows.agg(F.sum(F.size("words")).alias("n"), F.min(F.size("words")).alias("least")).first()
    if every.n and every.n > MOST_WORDS or every.least == 0:
        raise ValueError(f"templates must have words, {MOST_WORDS} together at most")
    said = F.posexplode("words").alias("place", "word")
    postings = rows.select("template", "label", "slack", F.size(F.array_distinct("phrases")).alias("n_keys"), said).where(~F.col("word").isin(sorted(COMMON)))
    text = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    keys = rows.select("template", "slack", text.alias("_text"), F.explode(F.array_distinct("phrases")).alias("phrase"))
    before = F.call_function("substring_index", F.col("_text"), F.concat(F.lit(" "), "phrase", F.lit(" ")), F.lit(1))
    offset = F.when(F.contains("_text", F.concat(F.lit(" "), "phrase", F.lit(" "))), F.size(F.array_remove(F.split(before, " "), "")))
    keys = settled(keys.select("template", "slack", "phrase", offset.alias("offset")), "phrases")
    if not keys.where("offset IS NULL OR phrase = ''").isEmpty():
        raise ValueError("a mandatory phrase isn't in its template")
    phrases = sorted({*BASE, *(r.phrase for r in keys.select("phrase").distinct().collect())})  # bounded by MOST_WORDS
    words = {r.word for r in postings.select("word").distinct().collect()}  # bounded by MOST_WORDS
    return Index(postings, keys, sorted(words | {_anchor(p.split())[1] for p in phrases}), phrases)


def _anchor(parts: list[str]) -> tuple[int, str]:
    """The place and word by which a phrase is looked up."""
    return next(((i, w) for i, w in enumerate(parts) if w not in COMMON), (0, parts[0]))


def tagged(text: Column) -> Column:
    """The labels of the licences in the SPDX expressions of a text."""
    names = F.create_map(*[F.lit(x) for name, ids in SPDX.items() for i in ids for x in (i, name)])
    plain = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TAG), F.lit(1)), lambda e: F.regexp_replace(F.lower(e), r"[ \t)]+with[ \t(]+[a-z0-9.+-]+", " "))
    ids = F.flatten(F.transform(plain, lambda e: F.split(e, r"[ \t()]+")))
    base = F.transform(ids, lambda i: F.trim(F.regexp_replace(F.regexp_replace(i, r"(-only|-or-later|[+.-]+)$", ""), r"[^a-z0-9]+", " ")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(base, lambda i: F.try_element_at(names, i)), lambda x: x.isNotNull())))


def scan(docs: DataFrame, known: Index, *keys: str) -> DataFrame:
    """keys, n_words, hits (word, at) of licence words, phrases (phrase, at) and tagged, the labels of SPDX tags, of a table of keys and text. One pass, no shuffle."""
    df = docs.select(*keys, alnum_words(F.col("text")).alias("_words"), tagged(F.col("text")).alias("tagged")).withColumn("n_words", F.size("_words"))
    words = F.col("_words")
    here = F.filter(F.transform(words, lambda w, i: F.when(w.isin(known.vocabulary), i)), lambda i: i.isNotNull())
    df = df.withColumn("_at", here)
    df = df.withColumn("hits", F.transform("_at", lambda i: F.struct(F.get(words, i).alias("word"), i.cast("int").alias("at")))).drop("_at")
    anchored: dict[str, list[Column]] = {}
    for p in known.phrases:
        parts = p.split()
        at, word = _anchor(parts)
        anchored.setdefault(word, []).append(F.struct(F.lit(p).alias("phrase"), F.lit(at).alias("off"), F.array(*map(F.lit, parts)).alias("parts")))
    by_word = F.create_map(*[x for word, found in anchored.items() for x in (F.lit(word), F.array(*found))])

    def found_at(h: Column) -> Column:
        here = F.filter(F.element_at(by_word, h["word"]), lambda p: (h["at"] >= p["off"]) & (F.slice(words, F.greatest(h["at"] - p["off"], F.lit(0)) + 1, F.size(p["parts"])) == p["parts"]))
        return F.transform(here, lambda p: F.struct(p["phrase"].alias("phrase"), (h["at"] - p["off"]).cast("int").alias("at")))

    df = df.withColumn("phrases", F.flatten(F.transform(F.filter("hits", lambda h: h["word"].isin(sorted(anchored))), found_at)))
    return fence(df.select(*keys, "n_words", "hits", "phrases", "tagged"), "n_words", "hits", "phrases", "tagged")


def weighted(found: DataFrame, known: Index) -> DataFrame:
    """(template, label, slack, n_keys, place, word, idf, weight): the postings of rare words."""
    total = found.count()
    held = found.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.round(F.ln(F.lit(float(total + 1)) / (F.coalesce("df", F.lit(0)) + 0.5)), 6)
    rows = known.postings.join(held, "word", "left").withColumn("idf", F.greatest(F.lit(0.0), idf))
    rarest = F.dense_rank().over(Window.partitionBy("template").orderBy(F.desc("idf"), "word"))
    rows = rows.withColumn("_nth", rarest).where((F.coalesce("df", F.lit(0)) <= RARE * total) | (F.col("_nth") <= LEAST)).drop("_nth", "df")
    return settled(rows.withColumn("weight", F.round(F.sum("idf").over(Window.partitionBy("template")), 6)), "index")


def label(found: DataFrame, known: Index, *keys: str) -> DataFrame:
    """keys, label, share and verified of the candidates in the rows of scan()."""
    some = found.where(F.size("hits") > 0).select(*keys, "hits", "phrases").distinct()
    #: The index is as large as the templates, whatever the files are.
    postings = F.broadcast(weighted(found, known))
    windows = lambda start: F.explode(F.array(F.floor(start / F.col("slack")), F.floor(start / F.col("slack")) - 1)).alias("window")
    votes = some.select(*keys, F.inline("hits")).join(postings, "word").select(*keys, "template", windows(F.col("at") - F.col("place")), "place", "idf", F.lit(None).cast("string").alias("phrase"))
    #: Mandatory phrases vote like words, so a window has all that its candidate needs.
    rules = F.broadcast(known.keys.withColumnRenamed("phrase", "_phrase"))
    met = some.select(*keys, F.inline("phrases")).join(rules, F.col("phrase") == F.col("_phrase")).select(*keys, "template", windows(F.col("at") - F.col("offset")), F.lit(None).cast("int").alias("place"), F.lit(None).cast("double").alias("idf"), "phrase")
    voted = votes.unionByName(met).groupBy(*keys, "template", "window").agg(F.collect_set(F.when(F.col("place").isNotNull(), F.struct("place", "idf"))).alias("_met"), F.collect_set("phrase").alias("_said"))
    of = F.broadcast(postings.where("weight > 0").select("template", "label", "n_keys", "weight").distinct())
    weight = F.aggregate(F.sort_array("_met"), F.lit(0.0), lambda a, m: a + m["idf"])
    shares = voted.join(of, "template").withColumn("share", F.round(F.least(F.lit(1.0), F.round(weight, 6) / F.col("weight")), 6))
    return shares.where(F.col("share") >= ENOUGH).select(*keys, "label", "share", (F.size("_said") == F.col("n_keys")).alias("verified"))


def report(docs: DataFrame, *keys: str, templates: DataFrame | None = None) -> DataFrame:
    """keys, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of a table of keys and text.

    templates: label, text and phrases (an array of the mandatory ones) of each; TEMPLATES if there are none.
    """
    known = index(default_templates(docs.sparkSession) if templates is None else templates)
    found = settled(scan(docs, known, *keys), "licences")
    best = label(found, known, *keys).where("verified").groupBy(*keys).agg(F.collect_set("label").alias("_labels"), F.max("share").alias("_share"))
    best = best.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_labels", "_share")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    names = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])
    rows = found.join(best, same, "left").withColumn("_base", F.filter("phrases", lambda x: x["phrase"].isin(list(BASE))))
    labels = F.array_sort(F.array_distinct(F.transform("_base", lambda x: F.element_at(names, x["phrase"]))))
    at = F.transform("_base", lambda x: x["at"].cast("long"))
    return rows.select(
        *keys,
        F.col("n_words").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, F.col("tagged"), F.coalesce("_labels", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when((F.size("_base") > 0) | (F.size("tagged") > 0), F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("_text_key"), "text")
    return report(docs, "doc_id", "_text_key").drop("_text_key")


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_WORDS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: Every word is joined with the postings and every phrase is looked up by its first word; nothing is looked up ahead.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS.format("text")} AS w FROM documents),
words AS (SELECT row, unnest(w) AS word, CAST(generate_subscripts(w, 1) AS BIGINT) - 1 AS pos FROM docs),
given(label, text, said) AS (VALUES {", ".join(f"('{name}', '{text}', {_LIST(keys)})" for name, text, keys in TEMPLATES)}),
templates AS (SELECT row_number() OVER () AS template, label, {_WORDS.format("text")} AS tw, list_distinct(said) AS said FROM given),
sizes AS (SELECT *, CAST(ceil(len(tw) / 3) AS BIGINT) AS slack FROM templates),
mandatory AS (SELECT template, slack, unnest(said) AS phrase, tw FROM sizes),
offsets AS (SELECT template, slack, phrase, len(string_split(string_split(' ' || array_to_string(tw, ' ') || ' ', ' ' || phrase || ' ')[1], ' ')) - 1 AS off FROM mandatory),
sought AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS parts FROM (SELECT phrase FROM offsets UNION ALL SELECT unnest({_LIST(BASE)}))),
places AS (SELECT d.row, phrase, pos FROM words d JOIN sought s ON d.word = s.parts[1] JOIN docs ON docs.row = d.row WHERE docs.w[pos + 1 : pos + len(parts)] = parts),
files AS (SELECT word, count(DISTINCT row) AS df FROM words GROUP BY word),
listed AS (SELECT template, label, slack, len(said) AS n_keys, unnest(tw) AS word, CAST(generate_subscripts(tw, 1) AS BIGINT) - 1 AS place FROM sizes),
rated AS (SELECT l.*, coalesce(df, 0) AS df, greatest(0::DOUBLE, round(ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (coalesce(df, 0) + 0.5::DOUBLE)), 6)) AS idf
  FROM listed l LEFT JOIN files f ON l.word = f.word WHERE l.word NOT IN ({", ".join(f"'{w}'" for w in sorted(COMMON))})),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY template ORDER BY idf DESC, word) AS nth FROM rated),
postings AS (SELECT *, round(sum(idf) OVER (PARTITION BY template), 6) AS weight FROM ranked WHERE df <= {RARE!r}::DOUBLE * (SELECT count(*) FROM docs) OR nth <= {LEAST}),
votes AS (SELECT row, template, slack, pos - place AS start, place, NULL AS phrase FROM words w JOIN postings p ON w.word = p.word
  UNION ALL SELECT row, template, slack, pos - off, NULL, h.phrase FROM places h JOIN offsets o ON h.phrase = o.phrase),
spread AS (SELECT row, template, place, phrase, unnest([CAST(floor(start / slack) AS BIGINT), CAST(floor(start / slack) AS BIGINT) - 1]) AS win FROM votes),
met AS (SELECT row, template, win, sum(idf) AS got FROM (SELECT DISTINCT row, s.template, win, s.place, idf FROM spread s JOIN postings p ON s.template = p.template AND s.place = p.place) GROUP BY row, template, win),
spoken AS (SELECT row, template, win, count(DISTINCT phrase) AS said FROM spread WHERE phrase IS NOT NULL GROUP BY row, template, win),
whole AS (SELECT DISTINCT template, label, n_keys, weight FROM postings WHERE weight > 0),
shares AS (SELECT m.row, label, round(least(1::DOUBLE, round(got, 6) / weight), 6) AS share
  FROM met m JOIN whole h ON m.template = h.template LEFT JOIN spoken s ON m.row = s.row AND m.template = s.template AND m.win = s.win WHERE coalesce(said, 0) = n_keys),
named AS (SELECT row, label, max(share) AS share FROM shares WHERE share >= {ENOUGH!r}::DOUBLE GROUP BY row, label),
based AS (SELECT row, pos, CASE phrase {" ".join(f"WHEN '{p}' THEN '{name}'" for p, name in BASE.items())} END AS label FROM places WHERE phrase IN ({", ".join(f"'{p}'" for p in BASE)})),
bases AS (SELECT row, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM based GROUP BY row),
ids(id, label) AS (VALUES {", ".join(f"('{i}', '{name}')" for name, ids in SPDX.items() for i in ids)}),
expressions AS (SELECT row, unnest(regexp_extract_all(text, '{_TAG}', 1)) AS said FROM (SELECT row_number() OVER () AS row, text FROM documents)),
parts AS (SELECT row, unnest(string_split_regex(regexp_replace(lower(said), '[ \t)]+with[ \t(]+[a-z0-9.+-]+', ' ', 'g'), '[ \t()]+')) AS part FROM expressions),
tags AS (SELECT DISTINCT row, label FROM parts JOIN ids ON id = trim(regexp_replace(regexp_replace(part, '(-only|-or-later|[+.-]+)$', ''), '[^a-z0-9]+', ' ', 'g'))),
every AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM based UNION ALL SELECT row, label FROM named UNION ALL FROM tags) GROUP BY row),
best AS (SELECT row, max(share) AS share FROM named GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 OR row IN (SELECT row FROM tags) THEN 1::DOUBLE ELSE coalesce(share, 0::DOUBLE) END AS score
FROM docs LEFT JOIN bases USING (row) LEFT JOIN every USING (row) LEFT JOIN best USING (row)
"""
