"""Ranked lexical search over a tiered index.

`index` counts the terms of every text and writes their postings, each with its impact (what the term adds to a score, but for the
term's weight), into tiers: a term's postings of highest impact are in tier 0, those that follow in tier 1, and so on. For each
term and tier the index holds the residual bound: the highest impact of the term's postings in lower tiers.

`search` reads the first tier of each term of each item and sums what the postings add. The k-th best sum of an item is a
threshold that its k best documents reach. Where the residual bounds of the item's terms together stay below it, no document that
wasn't met can be among them: that is the proof. Then documents whose sum and residual bounds reach the threshold are completed
from the lower tiers, and the best are exact. Items without proof fall through: their terms with the highest bounds are read one
tier deeper, as many as should bring the bounds below the threshold, and the proof is tried again. In the last tier all bounds
are 0, so every item is proven at last.

Texts that are equal are indexed once, as a class, with the number of its copies in all counts; at the end the members of
classes among the best are put in, by ascending doc_id. So a text that a third of the documents share costs one.

Defined results: null and empty texts have no terms and are never found; an item without terms, or whose terms no document has,
gives no rows; each row of items is ranked by itself, also where ids repeat or are null; rows of documents that are equal are found
each; equal scores go by doc_id, null last; other columns aren't read; no documents or no items give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import alnum_words, discard, passing_folder, settled, table, written

#: Documents an item gets.
BEST = 20
#: Postings of a term in its tiers down to each but the last, which holds the others. A run of impacts that are alike goes to the next
#: tier whole where it would not fit.
TIERS = (1 << 10, 1 << 13, 1 << 16)
#: Impacts are counted in steps of this size; there are 1000 of them.
STEP = 1000
#: Tables up to so many rows of a few numbers are broadcast after a count; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


@dataclass
class Index:
    #: term, row, impact, tier: a row for each term of each class.
    postings: DataFrame
    #: name, term, df, bounds: the residual bound below each tier.
    terms: DataFrame
    #: row, class, doc_id of every document; row is that of the class's representative where the two are equal.
    members: DataFrame
    #: Documents with terms, and terms in all.
    n_docs: int
    n_terms: int


def small(df: DataFrame) -> DataFrame:
    """A written table, hinted for broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def counted(words: str) -> Column:
    """(name, tf) of each distinct word of a sorted array."""
    w = F.col(words)
    return F.transform("_starts", lambda s, i: F.struct(F.get(w, s).alias("name"), (F.coalesce(F.get("_starts", i + 1), F.size(w)) - s).alias("tf")))


def term_lists(docs: DataFrame) -> DataFrame:
    """row, doc_id, class (a hash of the text), n (words) and terms (name, tf) of each row of docs, counted within the row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("class"), F.sort_array(alnum_words(F.col("text"))).alias("_words"))
    w = F.col("_words")
    every = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_starts", F.filter(every, lambda i: (i == 0) | (F.get(w, i) != F.get(w, F.greatest(i - 1, F.lit(0))))))
    return rows.select("row", "doc_id", "class", F.size(w).cast("long").alias("n"), counted("_words").alias("terms"))


def queries(items: DataFrame) -> DataFrame:
    """item (a row key), item_id, name and n_times of the terms of each item."""
    rows = items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id())
    #: Numbered before the terms are told apart.
    rows = rows.withColumn("_words", alnum_words(F.col("text"))).select("item", "item_id", F.explode("_words").alias("name"))
    return rows.groupBy("item", "item_id", "name").agg(F.count(F.lit(1)).alias("n_times"))


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def impact(tf: Column, n: Column, n_docs: int, n_terms: int) -> Column:
    """What a term that occurs tf times in a document of n terms adds, but for its weight."""
    m = F.lit(75) + div(F.lit(25).cast("long") * n * F.lit(n_docs).cast("long"), F.lit(n_terms).cast("long"))
    return div(F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(12).cast("long") * m)


def weight(df: Column, n_docs: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (F.lit(2).cast("double") * df + 1))).cast("long")


def representatives(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lists with the copies of each class, its other rows left out; and members: row (that of the class's representative), doc_id and own, the row itself.

    Only classes of several rows are looked up, by a broadcast after a count; the others are joined with nothing.
    """
    classes = settled(lists.groupBy("class").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "classes")
    many = settled(lists.select("row", "class").join(small(classes), "class").select(F.col("row").alias("_row"), "first", "copies"), "copies")
    joined = lists.join(small(many), F.col("row") == F.col("_row"), "left")
    members = joined.select(F.coalesce("first", "row").alias("row"), "doc_id", F.col("row").alias("own"))
    alone = F.col("first").isNull() | (F.col("first") == F.col("row"))
    return joined.where(alone).select("row", "n", "terms", F.coalesce("copies", F.lit(1)).alias("copies")), members


def index(docs: DataFrame, vocabulary: DataFrame | None = None) -> Index:
    """The index of docs; with a vocabulary (name), of its terms alone."""
    lists = settled(term_lists(docs), "terms")
    totals = lists.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals.docs, totals.terms or 1
    texts, members = representatives(lists)
    rows = texts.select("row", "n", "copies", F.explode("terms").alias("t")).select("row", "n", "copies", "t.name", "t.tf")
    if vocabulary is not None:
        rows = rows.join(small(settled(vocabulary.select("name").distinct(), "vocabulary")), "name")
    found = settled(rows.select("name", "row", "copies", impact(F.col("tf"), F.col("n"), n_docs, n_terms).alias("impact")), "postings")

    steps = found.groupBy("name", div(F.col("impact"), F.lit(STEP)).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("df"), F.max("impact").alias("most"))
    #: At most 1000 rows a term.
    until = Window.partitionBy("name").orderBy(F.desc("step"))
    so_far = F.sum("n").over(until.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tier = F.lit(len(TIERS))
    for t in reversed(range(len(TIERS))):
        tier = F.when(so_far <= TIERS[t], t).otherwise(tier)
    dealt = steps.withColumn("tier", tier)
    bounds = F.array(*[F.coalesce(F.max(F.when(F.col("tier") > t, F.col("most"))), F.lit(0).cast("long")) for t in range(len(TIERS) + 1)])
    starts = F.array(*[F.min(F.when(F.col("tier") <= t, F.col("step"))) for t in range(len(TIERS))])
    terms = settled(dealt.groupBy("name").agg(F.sum("df").alias("df"), bounds.alias("bounds"), starts.alias("starts")).withColumn("term", F.monotonically_increasing_id()), "lexicon")

    cuts = small(terms.select(F.col("name").alias("_name"), "term", "starts"))
    step = div(F.col("impact"), F.lit(STEP))
    tier = F.lit(len(TIERS))
    for t in reversed(range(len(TIERS))):
        tier = F.when(step >= F.get("starts", F.lit(t)), t).otherwise(tier)
    tiered = found.join(cuts, F.col("name") == F.col("_name")).select("term", "row", "impact", tier.alias("tier"))
    return Index(_by_tier(tiered), terms.drop("starts"), settled(members, "members"), n_docs, n_terms)


def _by_tier(postings: DataFrame) -> DataFrame:
    """The postings written in a folder a tier, so that lower tiers aren't read before they are needed."""
    path = passing_folder(postings.sparkSession, "tiers")
    postings.write.partitionBy("tier").parquet(path)
    return postings.sparkSession.read.schema(postings.schema).parquet(path)


def _best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each item, numbered as place. Spark keeps k rows a task and item before it shuffles."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("place") <= k)


def _sums(postings: DataFrame, depths: DataFrame) -> DataFrame:
    """item, row, low (what the postings read so far add) and got (the residual bounds of their terms) of each document met."""
    deepest = depths.agg(F.max("depth")).first()[0] or 0
    read = postings.where(F.col("tier") <= deepest)
    met = read.join(small(depths.select(F.col("term").alias("_term"), "item", "weight", "depth", "bound")), (F.col("term") == F.col("_term")) & (F.col("tier") <= F.col("depth")))
    return met.groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("low"), F.sum(F.col("weight") * F.col("bound")).alias("got"))


def _deeper(depths: DataFrame, thresholds: DataFrame) -> DataFrame:
    """depths with the terms of highest bound one tier deeper: as many as bring the bounds below the threshold, else all."""
    falls = F.col("weight") * (F.col("bound") - F.get("bounds", F.col("depth") + 1))
    #: An item's terms.
    before = Window.partitionBy("item").orderBy(F.desc(F.col("weight") * F.col("bound")), "term").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("reach") - F.coalesce(F.sum(falls).over(before), F.lit(0))
    rows = depths.join(thresholds.select("item", "reach", "threshold"), "item").withColumn("_more", (F.col("bound") > 0) & (left >= F.col("threshold")))
    rows = rows.withColumn("depth", F.col("depth") + F.col("_more").cast("int"))
    return rows.select("item", "term", "weight", "bounds", "depth").withColumn("bound", F.get("bounds", F.col("depth")))


def _complete(near: DataFrame, postings: DataFrame, depths: DataFrame) -> DataFrame:
    """item, row and score of the documents of near (item, row, low): what lower tiers hold of them is added."""
    lacking = depths.where("bound > 0").select(F.col("item").alias("_item"), F.col("term").alias("_term"), "weight", "depth")
    wanted = near.join(small(lacking), F.col("item") == F.col("_item")).select("item", F.col("row").alias("_row"), "_term", "weight", "depth")
    rows = settled(near.select(F.col("row").alias("_known")).distinct(), "candidates")
    lower = postings.where(F.col("tier") > 0).join(small(rows), F.col("row") == F.col("_known"), "left_semi")
    more = lower.join(wanted, (F.col("term") == F.col("_term")) & (F.col("row") == F.col("_row")) & (F.col("tier") > F.col("depth")))
    more = more.select("item", "row", (F.col("weight") * F.col("impact")).alias("low"))
    return near.select("item", "row", "low").unionByName(more).groupBy("item", "row").agg(F.sum("low").alias("score"))


def ranked_rows(found: Index, asked: DataFrame, k: int = BEST) -> DataFrame:
    """item, row, score of at least the k best classes of each item: all that reach its threshold. asked: item, name, n_times."""
    weights = found.terms.select("name", "term", "bounds", weight(F.col("df"), found.n_docs).alias("_w")).where("_w > 0")
    depths = asked.join(weights, "name").select("item", "term", (F.col("n_times") * F.col("_w")).alias("weight"), "bounds", F.lit(0).alias("depth"), F.get("bounds", F.lit(0)).alias("bound"))
    done: list[DataFrame] = []
    while True:
        depths = settled(depths, "depths")
        if depths.isEmpty():
            break
        sums, path = written(_sums(found.postings, depths), "sums")
        reach = depths.groupBy("item").agg(F.sum(F.col("weight") * F.col("bound")).alias("reach"))
        kth = _best(sums, k, F.desc("low")).where(F.col("place") == k).select("item", F.col("low").alias("threshold"))
        #: Fewer than k documents were met: all count, and any that wasn't met could be among the best.
        state = settled(reach.join(kth, "item", "left").select("item", "reach", F.coalesce("threshold", F.lit(1).cast("long")).alias("threshold")), "thresholds")
        proven = state.where("reach < threshold")
        near = sums.join(small(proven.select(F.col("item").alias("_item"), "reach", "threshold")), F.col("item") == F.col("_item"))
        near = settled(near.where(F.col("low") + F.col("reach") - F.col("got") >= F.col("threshold")).select("item", "row", "low"), "near")
        done.append(settled(_complete(near, found.postings, depths.join(proven, "item", "left_semi")), "scores"))
        depths = _deeper(depths.join(proven, "item", "left_anti"), state)
        discard(sums.sparkSession, path)
    out = asked.sparkSession.createDataFrame([], "item long, row long, score long")
    for rows in done:
        out = out.unionByName(rows)
    return out


def search(found: Index, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each row of items (item_id, text)."""
    return _search(found, settled(queries(items), "queries"), k)


def _search(found: Index, asked: DataFrame, k: int) -> DataFrame:
    scored = ranked_rows(found, asked.select("item", "name", "n_times"), k)
    #: Of the classes of an item k are enough, by score and smallest doc_id, and of the members of a class the k smallest.
    first = found.members.groupBy("row").agg(F.min("doc_id").alias("first"))
    best = _best(scored.join(first, "row"), k, F.desc("score"), F.col("first").asc_nulls_last(), "row").select("item", "row", "score")
    best = settled(best, "best")
    known = found.members.join(small(best.select("row").distinct()), "row")
    few = known.withColumn("_nth", F.row_number().over(Window.partitionBy("row").orderBy(F.col("doc_id").asc_nulls_last(), "own"))).where(F.col("_nth") <= k)
    rows = _best(best.join(few, "row"), k, F.desc("score"), F.col("doc_id").asc_nulls_last(), "own")
    names = asked.select("item", "item_id").distinct()
    return rows.join(names, "item").select("item_id", F.col("place").alias("rank"), "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = settled(queries(table(spark, sf_dir, "benchmark")), "queries")
    return _search(index(table(spark, sf_dir, "documents"), asked), asked, BEST)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')"

#: Every document against every item.
ORACLE = f"""
WITH words AS (SELECT rowid AS row, doc_id, unnest({_WORDS}) AS term FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
lengths AS (SELECT row, doc_id, count(*) AS n FROM words GROUP BY ALL),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
occurs AS (SELECT row, term, count(*) AS tf FROM words GROUP BY ALL),
spread AS (SELECT term, count(*) AS df FROM occurs GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM spread, total),
items AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT rowid AS i, item_id, unnest({_WORDS}) AS term FROM (SELECT *, row_number() OVER () AS rowid FROM benchmark)) GROUP BY ALL),
scores AS (SELECT i, item_id, row, l.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN occurs USING (term) JOIN lengths l USING (row), total GROUP BY i, item_id, row, l.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INT) AS rank, doc_id, score FROM ranked WHERE place <= 20
"""
