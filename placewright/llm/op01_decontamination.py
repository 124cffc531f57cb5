"""Benchmark decontamination by a broadcast hash set of n-grams.

Benchmark items become windows of 13 words (shorter items: one window). Every window of a document is hashed and looked
up; where the hash is known, the words themselves are compared. Hits mark document words; documents of which enough is
marked are contaminated. `clean` drops those documents, `without_spans` cuts the marked words out.

Windows up to BLOCK are broadcast at once; of a larger benchmark one block after the other is, each against all documents.

Defined results: null text has no words, is never contaminated and stays; items without words have no windows; a null
item_id is written as an empty string; rows are told apart by doc_id and text, repeated rows get the same report each;
empty tables give empty reports, an empty benchmark contaminates nothing; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, settled, table, with_rows, without_rows

WIDTH = 13
#: Windows broadcast at once: 13 words each, well under 100 MB together.
BLOCK = 300_000
#: Contaminated: 1 word in so many is marked.
SHARE = 20
_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def windows(benchmark: DataFrame) -> DataFrame:
    """(item, gram, width) of each item's windows; gram is the array of words."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), alnum_words(F.col("text")).alias("words"))
    words = words.where(F.size("words") > 0).withColumn("width", F.least(F.size("words"), F.lit(WIDTH)))
    starts = words.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width"))))
    return starts.select("item", F.slice("words", F.col("at") + 1, F.col("width")).alias("gram"), "width").distinct()


def hashes(keys: Column, n: Column, widths: list[int]) -> Column:
    """Hashes of all windows of an array of word hashes, first those of the first width."""
    none = F.array().cast("array<bigint>")

    def of(w: int) -> Column:
        return F.when(n >= w, F.transform(F.sequence(F.lit(0), n - w), lambda i: F.xxhash64(*[F.get(keys, i + k) for k in range(w)]))).otherwise(none)

    each = [of(w) for w in widths]
    return F.concat(F.array(F.lit(0).cast("bigint")), *each)


def hits(docs: DataFrame, grams: DataFrame, widths: list[int], *keys: str) -> DataFrame:
    """For each occurrence of a gram keys, n_words, at, width and gram; and for each row of docs one with width 0.

    docs: keys and text. Before the hashes stands a zero, which a row of the broadcast table always meets, so documents
    without hits are reported in the same pass. The table is looked up by the hash alone and words are compared only then.
    """
    listed = docs.withColumn("_words", alnum_words(F.col("text"))).drop("text").withColumn("n_words", F.size("_words"))
    listed = listed.withColumn("_keys", F.transform("_words", lambda w: F.xxhash64(w)))
    # The outer form, as the optimizer would put a filter on the array below the steps that make it and so make it anew for each element.
    listed = listed.withColumn("_hashes", hashes(F.col("_keys"), F.col("n_words"), widths))
    rows = listed.select(*keys, "n_words", "_words", F.posexplode_outer("_hashes").alias("_i", "_h"))
    known = _keyed_grams(grams, widths)
    #: Where the windows of a width start in the list.
    offset, start = F.when(F.col("width") == 0, F.lit(0)), F.lit(1)
    for w in widths:
        offset, start = offset.when(F.col("width") == w, start), start + F.greatest(F.lit(0), F.col("n_words") - w + 1)
    at = F.col("_i") - offset
    inside = (at >= 0) & (at + F.col("width") <= F.col("n_words"))
    words = F.slice("_words", F.greatest(at, F.lit(0)) + 1, F.col("width"))
    #: coalesce keeps the comparison of words from becoming a key of the join.
    same = F.coalesce(F.when(F.col("width") == 0, F.col("_i") == 0).otherwise((F.col("_i") > 0) & inside & (words == F.col("gram"))), F.lit(False))
    joined = rows.join(F.broadcast(known), (F.col("_h") == F.col("_key")) & same)
    return joined.select(*keys, "n_words", at.alias("at"), "width", F.array_join("gram", " ").alias("gram"))


def _keyed_grams(grams: DataFrame, widths: list[int]) -> DataFrame:
    """_key, gram and width; and one row of width 0 with the key 0."""
    key = F.lit(0).cast("bigint")
    for w in widths:
        key = F.when(F.col("width") == w, F.xxhash64(*[F.xxhash64(F.get("gram", k)) for k in range(w)])).otherwise(key)
    empty = grams.sparkSession.sql("SELECT 0L AS _key, CAST(array() AS ARRAY<STRING>) AS gram, 0 AS width")
    return grams.select(key.alias("_key"), "gram", "width").unionByName(empty)


def covered(spans: Column) -> Column:
    """Words within a sorted array of (at, width)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["at"] + s["width"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], F.least(s["at"], end))).cast("long").alias("n"))

    return F.aggregate(spans, start, add, lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame, *keys: str) -> DataFrame:
    """For each row of docs (keys and text) its keys, n_words, n_hit, n_items, items_sha256, contaminated and spans, the hit (at, width).

    Hits are put together by document, which is no more than the document itself.
    """
    owned = settled(windows(benchmark), "windows")
    widths = sorted(r.width for r in owned.select("width").distinct().collect())  # WIDTH values at most
    grams = owned.select("gram", "width").distinct()
    blocks = max(1, -(-grams.count() // BLOCK))
    part = F.pmod(F.xxhash64(F.col("gram"), F.lit(1)), F.lit(blocks))
    found = [hits(docs, grams.where(part == b) if blocks > 1 else grams, widths, *keys) for b in range(blocks)]
    # Each block reports each row of docs once.
    rows = reduce(DataFrame.unionByName, found).groupBy(*keys, "n_words").agg(
        F.sort_array(F.collect_set(F.when(F.col("width") > 0, F.struct("at", "width")))).alias("spans"),
        F.collect_set(F.when(F.col("width") > 0, F.col("gram"))).alias("_grams"),
        (F.sum((F.col("width") == 0).cast("long")) / blocks).cast("int").alias("_copies"),
    )
    rows = rows.withColumn("n_hit", covered(F.col("spans")))
    owners = owned.select("item", F.array_join("gram", " ").alias("_gram"))
    each = rows.withColumn("_g", F.explode_outer("_grams")).drop("_grams").join(owners, F.col("_g") == F.col("_gram"), "left")
    each = each.groupBy(*keys, "n_words", "n_hit", "spans", "_copies").agg(F.sort_array(F.collect_set("item")).alias("items"))
    each = each.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    bad = (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))
    return each.select(*keys, F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), bad.alias("contaminated"), "spans")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_key"), "text")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows."""
    return without_rows(docs, report(_keyed(docs), benchmark, "_id", "_text_key").where("contaminated"))


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the marked words cut out of their texts."""
    found = report(_keyed(docs), benchmark, "_id", "_text_key").where("n_hit > 0").dropDuplicates(["_id", "_text_key"])
    joined = with_rows(docs, found.withColumnRenamed("spans", "_spans"), "left", "_spans")
    text = F.col("_doc").getField("text")
    marked = F.flatten(F.transform("_spans", lambda s: F.sequence(s["at"], s["at"] + s["width"] - 1)))
    gaps, words = F.split(text, _RAW, -1), F.regexp_extract_all(text, F.lit(f"({_RAW})"))
    joined = joined.withColumn("_marked", F.map_from_entries(F.transform(F.array_distinct(marked), lambda i: F.struct(i, F.lit(True))))).withColumn("_gaps", gaps).withColumn("_words", words)
    kept = F.transform("_gaps", lambda g, i: F.concat(g, F.when(F.col("_marked")[i].isNotNull(), "").otherwise(F.coalesce(F.get("_words", i), F.lit("")))))
    cut = F.when(F.col("_spans").isNull(), text).otherwise(F.array_join(kept, ""))
    return joined.select(*[(cut if c == "text" else F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("_text_key"), "text")
    return report(docs, table(spark, sf_dir, "benchmark"), "doc_id", "_text_key").drop("_text_key", "spans")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 13) AS width, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, width, array_to_string(w[p:p + width - 1], ' ') AS gram FROM bs),
widths AS (SELECT DISTINCT width FROM g),
dp AS (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM d, widths WHERE len(w) >= width),
dg AS (SELECT doc_id, p, width, array_to_string(w[p:p + width - 1], ' ') AS gram FROM dp),
h AS (SELECT dg.doc_id, dg.p, dg.width, g.item FROM dg JOIN g ON dg.gram = g.gram AND dg.width = g.width),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + width)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n_items, 0) AS BIGINT) AS n_items,
  coalesce(hi.items, sha256('')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AND 20 * coalesce(hw.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
