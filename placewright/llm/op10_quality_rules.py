"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose figure is beyond a cutoff. Cutoffs are chosen by stratum (language) on labelled
documents: going from the laxest to the strictest cutoff of a fixed ladder, a cutoff is accepted while the exact binomial
test refutes that it rejects more than RISK of the good documents. One ladder stops at its first failure (fixed-sequence
testing, so steps of a ladder need no correction); the level is divided by the number of ladders (Bonferroni). So with
probability 1 - LEVEL no accepted cutoff rejects more than RISK of its stratum's good documents. The RISK is
divided by the number of rules, so it holds for all rules of a stratum together.

Defined results: null text has no words and fails the base rule; a null language is a stratum of its own; a stratum
without labels gets no cutoffs; null labels are ignored and of repeated ones the best counts; repeated rows are judged
alike; clashing columns of the input are kept, as figures are computed apart from them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fence, plain_words, settled, table, unpacked, without

RISK = 0.05
LEVEL = 0.05
#: Tables of cutoffs up to so many strata are broadcast; larger ones are joined by shuffle.
BROADCAST_STRATA = 50_000
#: Positions up to this fit beside a hash in one number; longer texts sort pairs instead.
_SLOT = 20

#: Computed in one pass over the text.
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Figures of a document and the ladder of cutoffs of each, from lax to strict: reject if the figure is above.
LADDERS = {
    "symbols_a_word": [4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "dup_lines": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "repeats": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "capitals": [0.95, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "word_length": [40.0, 25.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0],
}


def _figures(docs: DataFrame, text: str) -> DataFrame:
    """docs with the base figures, one step at a time so that none is computed twice."""
    content = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_words", plain_words(F.col(text))).withColumn("_lines", lines)
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(content, F.lit(r"[#*$%&|<>]")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = df.withColumn("n_capitals", F.regexp_count(content, F.lit("[A-Z]")))
    df = df.withColumn("n_lines", (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("long"))

    w, n = F.col("_words"), F.col("n_words").cast("int")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    #: Hashes of windows with their positions in the low bits are sorted; positions beside an equal hash are candidates. Their windows
    #: are then compared in full, so no hash decides. In texts too long for the low bits every position is a candidate.
    key = lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _SLOT)
    short = n <= (1 << _SLOT)
    df = df.withColumn("_keys", F.when(short, F.sort_array(F.transform(starts, lambda i: key(i).bitwiseOR(i.cast("long"))))))
    keys = F.col("_keys")
    same = lambda a, b: F.shiftright(a, _SLOT) == F.shiftright(b, _SLOT)
    near = F.filter(keys, lambda k, i: F.coalesce(same(k, F.get(keys, i + 1)), F.lit(False)) | ((i > 0) & F.coalesce(same(k, F.get(keys, F.greatest(i - 1, F.lit(0)))), F.lit(False))))
    df = df.withColumn("_near", F.coalesce(F.transform(near, lambda k: k.bitwiseAND(F.lit((1 << _SLOT) - 1)).cast("int")), starts)).drop("_keys")
    window = lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))
    df = df.withColumn("_near", F.sort_array(F.transform("_near", window))).drop("_words")
    near = F.col("_near")
    equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    twice = F.filter(near, lambda x, i: equal(x, F.get(near, i + 1)) | ((i > 0) & equal(x, F.get(near, F.greatest(i - 1, F.lit(0))))))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_near")
    at = F.col("_at")
    spans = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_at")
    return fence(df, *FIGURES, "n_lines", "n_capitals")


def figures(docs: DataFrame, *keep: Column, text: str = "text") -> DataFrame:
    """The columns of keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and the figures of the rules."""
    named = docs.select(*keep, F.col(text).alias("_text"))
    df = _figures(named, "_text").drop("_text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    some = F.greatest(F.col("n_words"), F.lit(1))
    df = df.withColumn("base_failed", failed).withColumn("symbols_a_word", F.col("n_symbols") / some).withColumn("dup_lines", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))
    return df.withColumn("repeats", F.col("n_repeat_words") / some).withColumn("word_length", F.col("word_chars") / some).withColumn("capitals", F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))).drop("n_lines", "n_capitals")


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(X <= k) for X binomial (n, risk), exactly: the p-value against a rate of risk or more. 1 where k >= n * risk.

    Terms are summed as logarithms, each from the one before, so n may be any count.
    """
    step = math.log(risk / (1 - risk))
    start = F.struct((n * math.log1p(-risk)).cast("double").alias("term"), (n * math.log1p(-risk)).cast("double").alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.ln((n - j + 1) / j) + F.lit(step)
        top = F.greatest(term, acc["sum"])
        return F.struct(term.alias("term"), (top + F.ln(F.exp(term - top) + F.exp(acc["sum"] - top))).alias("sum"))

    upto = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * risk, F.lit(1.0)).otherwise(F.exp(F.aggregate(upto, start, add, lambda a: a["sum"])))


def cutoffs(labelled: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, one cutoff a rule or null) from good documents: a column stratum and the figures of LADDERS.

    A document that fails the base rule isn't a false rejection of these rules and isn't counted.
    """
    counts = [F.sum((F.col(rule) > cut).cast("long")).alias(f"{rule}:{i}") for rule, ladder in LADDERS.items() for i, cut in enumerate(ladder)]
    by = settled(labelled.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts), "strata")
    strata = by.count()
    rungs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(cut).alias("cut"), F.col(f"`{rule}:{i}`").alias("k")) for rule, ladder in LADDERS.items() for i, cut in enumerate(ladder)])
    rows = by.select("stratum", "n", F.inline(rungs))
    share = risk / len(LADDERS)
    rows = rows.withColumn("passed", binomial_tail(F.col("k"), F.col("n"), share) <= level / max(1, strata * len(LADDERS)))
    so_far = Window.partitionBy("stratum", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("open", F.min(F.col("passed").cast("int")).over(so_far) == 1)
    return rows.groupBy("stratum").agg(*[F.min(F.when(F.col("open") & (F.col("rule") == rule), F.col("cut"))).alias(f"max_{rule}") for rule in LADDERS])


def judged(rows: DataFrame, labels: DataFrame, stratum: str, doc_id: str) -> DataFrame:
    """rows of figures() with kept. labels: doc_id, quality."""
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_good"))
    good = good.where(F.col("_good") == 1).select(F.col("doc_id").alias("_labelled"))
    holdout = rows.where(~F.col("base_failed")).join(good, F.col(doc_id) == F.col("_labelled"), "left_semi")
    limits = settled(cutoffs(holdout.withColumn("stratum", F.col(stratum))), "cutoffs").withColumnRenamed("stratum", "_stratum")
    few = limits.count() <= BROADCAST_STRATA
    beyond = [F.coalesce(F.col(rule) > F.col(f"max_{rule}"), F.lit(False)) for rule in LADDERS]
    any_beyond = beyond[0]
    for b in beyond[1:]:
        any_beyond = any_beyond | b
    joined = rows.join(F.broadcast(limits) if few else limits, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~any_beyond).drop("_stratum")


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep; the texts aren't shuffled.

    The figures, which cost far more than writing, are computed once and written beside the documents; labelled ones of them set the cutoffs.
    """
    every = docs.select(F.struct(*without(docs)).alias("_doc"), F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "text")
    rows = settled(figures(every, F.col("_doc"), F.col("_id"), F.col("_lang")), "judged")
    return unpacked(judged(rows, labels, "_lang", "_id").where("kept"), docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = settled(figures(docs, F.col("doc_id"), F.col("lang")), "figures")
    out = judged(rows, table(spark, sf_dir, "labels"), "lang", "doc_id")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_RUNGS = ", ".join(f"('{rule}', {i}, {cut!r}::DOUBLE)" for rule, ladder in LADDERS.items() for i, cut in enumerate(ladder))
_SHARE = f"{RISK / len(LADDERS)!r}::DOUBLE"
#: Repeated words by unnested windows, and the tail from binomial coefficients by lgamma, other ways than above.
ORACLE = f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (SELECT row, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) >= 3),
marked AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) AS times FROM windows),
repeated AS (SELECT row, CAST(count(DISTINCT place) AS BIGINT) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS place FROM marked WHERE times > 1) GROUP BY row),
counted AS (SELECT s.row, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals, len(string_split(t, chr(10))) AS n_lines
  FROM split s LEFT JOIN repeated r ON s.row = r.row),
figures AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbols_a_word, n_dup_lines / n_lines AS dup_lines,
    n_repeat_words / greatest(n_words, 1) AS repeats, n_capitals / greatest(word_chars, 1) AS capitals, word_chars / greatest(n_words, 1) AS word_length FROM counted),
long AS (SELECT row, lang, doc_id, base_failed, unnest([{", ".join(f"'{rule}'" for rule in LADDERS)}]) AS rule, unnest([{", ".join(LADDERS)}]) AS v FROM figures),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
ladder(rule, i, cut) AS (VALUES {_RUNGS}),
tallied AS (SELECT lang, l.rule, i, cut, count(*) AS n, CAST(count(*) FILTER (WHERE v > cut) AS BIGINT) AS k
  FROM long l JOIN ladder d ON l.rule = d.rule WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good WHERE doc_id IS NOT NULL) GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k >= n * {_SHARE} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_SHARE}) + (n - j) * ln(1 - {_SHARE})))) END AS tail,
    (SELECT count(*) FROM (SELECT DISTINCT lang FROM tallied)) AS strata FROM tallied),
opened AS (SELECT *, bool_and(tail <= {LEVEL!r}::DOUBLE / (strata * {len(LADDERS)})) OVER (PARTITION BY lang, rule ORDER BY i) AS open FROM tails),
limits AS (SELECT lang, rule, min(cut) AS cut FROM opened WHERE open GROUP BY lang, rule),
beyond AS (SELECT DISTINCT row FROM long l JOIN limits m ON l.lang IS NOT DISTINCT FROM m.lang AND l.rule = m.rule AND l.v > m.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND row NOT IN (SELECT row FROM beyond) AS kept FROM figures
"""
