"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. A document is first taken as many whole times as its source's target holds the
source; what then remains of the target is a sample of the source without replacement.

For it each document gets an inclusion probability: `lean` (short documents have less, so the remainder isn't filled with
fragments) times a factor of its source, 1 at most, the factor being such that the words expected make up the remainder.
Documents of a source are put into strata of like length (an eighth of an octave). The strata's sample sizes are fixed: from
the longest to the shortest, each takes the number of documents nearest to the words expected of it and what rounding left
over from longer ones. In its stratum a document gets the rank q = (U / (1 - U)) / (p / (1 - p)), U uniform by its key and p
its inclusion probability, and the documents with the smallest q are taken: Pareto order sampling. So the number of documents
is fixed, and the words come near the target, as documents of a stratum differ in length by an eighth at most.

No stratum is sorted as a whole: documents are counted over 1024 slices of the rank, the slice with the last document taken is
sliced again, and only the rows of that slice of a slice are ordered. So a source may hold any share of the rows.

Defined results: null text has 0 words; a null source is a source of its own, the last one; documents without words
are taken in whole copies only; repeated rows (same key, source and text) are numbered, and each but the first draws by its number too,
so the sample takes some of them and words stay near the target; which of them is any; columns of the input may have any name; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, in_order, settled, table, uniform, unpacked, without, word_count

CYCLE = (5, 2, 1)
MOST = 3
SLICES = 1024
SALT = "mix"
#: Lengths from which on documents are alike in their inclusion.
LONG = 1000
#: Tables of sources or strata up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, weight) with the target of each source: in proportion to weight, at most MOST sizes.

    The excess of full sources goes to the others by weight. In the order of size over weight the full ones come first, so
    sums over those before give the level at which the rest stands.
    """
    every = sources.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).first()
    total, weights = every.total or 0, every.weights or 0
    ratio = F.col("source_size") / F.col("weight")
    known = in_order(sources, ratio, F.col("source").asc_nulls_last(), _full=F.col("source_size"), _heavy=F.col("weight"))
    known = known.withColumn("_level", (F.lit(total) - MOST * F.col("_full")) / (F.lit(weights) - F.col("_heavy")))
    #: The first source that isn't full fixes the level of all.
    open_ = known.where(F.col("_level") * F.col("weight") < MOST * F.col("source_size"))
    level = open_.agg(F.min_by("_level", "_nth").alias("level")).first().level
    full = (MOST * F.col("source_size")).cast("double")
    target = full if level is None else F.least(full, F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", "weight", target.alias("target"))


def cycle_weights(sources: DataFrame) -> DataFrame:
    """Adds the weights of CYCLE to (source, source_size), by the order of the names; null comes last."""
    numbered = in_order(sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(c) for c in CYCLE]), (F.col("_nth") % len(CYCLE) + 1).cast("int")).cast("long")
    return numbered.withColumn("weight", weight).drop("_nth")


def lean(size: Column) -> Column:
    """How much a document of a length is favoured."""
    some = F.least(size, F.lit(LONG))
    return (some + 1.0) / (some + 51.0)


def chance(size: Column, scale: Column) -> Column:
    """The inclusion probability."""
    return F.least(F.lit(1.0), scale * lean(size))


def rank(u: Column, p: Column) -> Column:
    """q / (1 + q) for the Pareto rank q: the same order, but within (0, 1)."""
    return u * (1.0 - p) / (u * (1.0 - p) + p * (1.0 - u))


def stratum(size: Column) -> Column:
    """The number of binary digits of a length, and the first four of them."""
    bits = F.length(F.bin(size))
    return bits * 16 + F.call_function("shiftright", size, F.greatest(F.lit(0), bits - 4)).cast("int")


def attach(rows: DataFrame, shares: DataFrame, on: Column, few: bool, how: str = "inner") -> DataFrame:
    """A join with a table of one row a source or stratum."""
    return rows.join(F.broadcast(shares) if few else shares, on, how)


def scales(known: DataFrame, sizes: DataFrame) -> DataFrame:
    """(_source, scale): the factor with which the words expected of the source's sample are its `rest`.

    sizes: source, size, n. Probabilities reach 1 for the longest documents first, so sums from there tell how far they do;
    a source has LONG classes of length at most.
    """
    classes = sizes.groupBy("source", F.least("size", F.lit(LONG)).alias("_k")).agg(F.sum(F.col("size") * F.col("n")).alias("_words"))
    falling = Window.partitionBy("source").orderBy(F.desc("_k"))
    certain = F.coalesce(F.sum("_words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    favoured = F.sum(F.col("_words") * lean(F.col("_k"))).over(Window.partitionBy("source").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col("source").eqNullSafe(F.col("_source"))
    rests = known.select(F.col("source").alias("_source"), "rest")
    tried = classes.withColumn("_certain", certain).withColumn("_favoured", favoured).join(rests, same).withColumn("_scale", (F.col("rest") - F.col("_certain")) / F.col("_favoured"))
    fits = tried.where(F.col("_scale") * lean(F.col("_k")) <= 1)
    return fits.groupBy("_source").agg(F.greatest(F.lit(0.0), F.round(F.max_by("_scale", "_k"), 12)).alias("scale"))


def sample_sizes(strata: DataFrame) -> DataFrame:
    """(source, stratum, m) of (source, stratum, n, words, expected): documents to take, what rounding leaves going to the next shorter stratum."""
    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<struct<stratum:int,m:bigint>>").alias("found"))

    def add(acc: Column, s: Column) -> Column:
        due = s["expected"] + acc["left"]
        mean = s["words"] / s["n"]
        m = F.least(s["n"], F.greatest(F.lit(0).cast("long"), F.floor(due / mean + 0.5)))
        return F.struct((due - m * mean).alias("left"), F.concat(acc["found"], F.array(F.struct(s["stratum"].alias("stratum"), m.alias("m")))).alias("found"))

    #: A few hundred strata a source at most: eight an octave.
    lists = strata.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("stratum", "n", "words", "expected")), asc=False).alias("_strata"))
    return lists.select("source", F.inline(F.aggregate("_strata", start, add, lambda a: a["found"])))


def plan(slim: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """For each source and stratum the whole copies, the factor of the probabilities and the rank up to which the sample takes rows (-1: none). slim: source, size, u."""
    ratio = F.col("target") / F.col("source_size")
    #: Rounding of the level can leave a ratio a hair below a whole number.
    known = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(ratio + 1e-9)).otherwise(0).cast("int"))
    known = known.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    same = F.col("source").eqNullSafe(F.col("_source"))

    sizes = settled(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    factors = settled(scales(known, sizes.where(F.col("size") > 0)), "factors")
    weighed = attach(sizes.where(F.col("size") > 0), factors, same, few).withColumn("stratum", stratum(F.col("size")))
    expected = F.round(F.sum(F.col("n") * F.col("size") * chance(F.col("size"), F.col("scale"))), 6)
    strata = weighed.groupBy("source", "stratum").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words"), expected.alias("expected"))
    wanted = settled(sample_sizes(strata), "samples")
    few = few and wanted.count() <= BROADCAST_SOURCES

    rows = attach(slim.where(F.col("size") > 0), factors, same, few).select("source", stratum(F.col("size")).alias("stratum"), rank(F.col("u"), chance(F.col("size"), F.col("scale"))).alias("x"))
    here = same & (F.col("stratum") == F.col("_stratum"))
    slices = rows.groupBy("source", "stratum", F.floor(F.col("x") * SLICES).alias("_at")).agg(F.count(F.lit(1)).alias("_rows"))
    due = wanted.where(F.col("m") > 0).select(F.col("source").alias("_source"), F.col("stratum").alias("_stratum"), "m", F.lit(0).cast("long").alias("_before"))
    cut = _cut(attach(slices, due, here, few))
    inside = attach(rows, cut, here & (F.floor(F.col("x") * SLICES) == F.col("_slice")), few)
    cut = _cut(inside.groupBy("source", "stratum", "m", "_before", F.floor(F.col("x") * SLICES**2).alias("_at")).agg(F.count(F.lit(1)).alias("_rows")))
    inside = attach(rows, cut, here & (F.floor(F.col("x") * SLICES**2) == F.col("_slice")), few)
    inside = inside.groupBy("source", "stratum", "m", "_before", F.col("x").alias("_at")).agg(F.count(F.lit(1)).alias("_rows"))
    last = _cut(inside).select("_source", "_stratum", F.col("_slice").alias("below"))

    shares = sizes.select("source", F.when(F.col("size") > 0, stratum(F.col("size"))).otherwise(0).alias("stratum")).distinct()
    named = known.select(F.col("source").alias("_source"), "source_size", "target", "whole")
    shares = attach(shares, named, same, few).drop("_source")
    shares = attach(shares, factors, same, few, "left").drop("_source")
    shares = attach(shares, last, here, few, "left")
    return shares.select("source", "stratum", "source_size", "target", "whole", F.coalesce("scale", F.lit(0.0)).alias("scale"), F.coalesce("below", F.lit(-1.0)).alias("below"))


def _cut(counts: DataFrame) -> DataFrame:
    """Of the values of _at in each stratum, the last that begins before m rows are taken."""
    run = Window.partitionBy("source", "stratum").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_until", F.col("_before") + F.coalesce(F.sum("_rows").over(run), F.lit(0)))
    last = counts.where(F.col("_until") < F.col("m")).groupBy("source", "stratum", "m").agg(F.max(F.struct("_at", "_until")).alias("_m"))
    return last.select(F.col("source").alias("_source"), F.col("stratum").alias("_stratum"), "m", F.col("_m._at").alias("_slice"), F.col("_m._until").alias("_before"))


def told_apart(docs: DataFrame) -> DataFrame:
    """_doc, a struct of all columns, and _again: the number of each row among those of the same doc_id, source and text, null for rows without equals.

    Only repeated rows are written and numbered, in ranges of a global order that ends with their place: a row repeated any number
    of times is spread over many tasks.
    """
    text = F.xxhash64("text").alias("_t")
    many = docs.groupBy("doc_id", "source", text).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    many = settled(many.select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("_t").alias("_h"), F.lit(True).alias("_many")), "repeated")
    n = many.count()
    rows = docs.select(F.struct(*without(docs)).alias("_doc"), "doc_id", "source", text)
    if n == 0:
        return rows.select("_doc", F.lit(None).cast("long").alias("_again"))
    same = F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_t") == F.col("_h"))
    joined = rows.join(F.broadcast(many) if n <= BROADCAST_KEYS else many, same, "left")
    again = settled(joined.where("_many").select("_doc", "doc_id", "source", "_t").withColumn("_place", F.monotonically_increasing_id()), "again")
    keys = ["doc_id", "source", "_t"]
    order = in_order(again.select(*keys, "_place"), *[F.col(k) for k in keys], F.col("_place"))
    order = settled(order, "numbers")
    first = order.groupBy(*keys).agg(F.min("_nth").alias("_first")).select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("_t").alias("_h"), "_first")
    order = attach(order, first, same, n <= BROADCAST_KEYS).select(F.col("_place").alias("_p"), (F.col("_nth") - F.col("_first")).alias("_again"))
    numbered = again.join(order, F.col("_place") == F.col("_p")).select("_doc", "_again")
    return joined.where(F.col("_many").isNull()).select("_doc", F.lit(None).cast("long").alias("_again")).unionByName(numbered)


def draw(rows: DataFrame, *keep: Column) -> DataFrame:
    """keep, source, size (words) and u, the draw of each row of told_apart()."""
    of = F.col("_doc").getField
    key = [of("doc_id"), F.md5(of("text").cast("binary"))]
    u = F.when(F.col("_again") > 0, uniform(*key, F.col("_again"), salt=SALT)).otherwise(uniform(*key, salt=SALT))
    return rows.select(*keep, of("source").alias("source"), word_count(of("text")).alias("size"), u.alias("u"))


def copies(rows: DataFrame, shares: DataFrame, few: bool) -> DataFrame:
    """rows of draw() with the plan of their source and copies, the number of times that each is taken."""
    named = shares.withColumnRenamed("source", "_source").withColumnRenamed("stratum", "_stratum")
    of = F.when(F.col("size") > 0, stratum(F.col("size"))).otherwise(0)
    joined = attach(rows, named, F.col("source").eqNullSafe(F.col("_source")) & (of == F.col("_stratum")), few)
    sampled = (F.col("size") > 0) & (rank(F.col("u"), chance(F.col("size"), F.col("scale"))) <= F.col("below"))
    return joined.withColumn("copies", F.col("whole") + F.coalesce(sampled, F.lit(False)).cast("int")).drop("_source", "_stratum")


def shares_of(docs: DataFrame, weigh=cycle_weights) -> tuple[DataFrame, DataFrame, bool]:
    """_shares() of documents."""
    return _shares(told_apart(docs), weigh)


def _shares(rows: DataFrame, weigh) -> tuple[DataFrame, DataFrame, bool]:
    """The sizes of rows of told_apart(), the plan by source and stratum, and whether it is small; weigh adds a weight to each source."""
    slim = settled(draw(rows, F.col("_doc").getField("doc_id").alias("doc_id")), "sizes")
    sources = settled(targets(settled(weigh(slim.groupBy("source").agg(F.sum("size").alias("source_size"))), "weights")), "targets")
    shares = settled(plan(slim, sources, sources.count() <= BROADCAST_SOURCES), "mix")
    return slim, shares, shares.count() <= BROADCAST_SOURCES


def mix(docs: DataFrame, weigh=cycle_weights) -> DataFrame:
    """docs, each row as often as the mix takes it. The texts aren't shuffled unless the sources are many."""
    rows = told_apart(docs)
    _, shares, few = _shares(rows, weigh)
    taken = copies(draw(rows, F.col("_doc")), shares, few).where(F.col("copies") > 0)
    return unpacked(taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")), docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    slim, shares, few = shares_of(docs)
    out = copies(slim, shares, few)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


ORACLE = """
WITH RECURSIVE numbered AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS again FROM documents),
sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), chr(1)) || '|' || coalesce(md5(text), chr(1)) || CASE WHEN again > 0 THEN '|' || again ELSE '' END), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM numbered),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
levels AS (SELECT *,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM weighed WINDOW b AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fixed AS (SELECT *, min_by(level, source_size::DOUBLE / weight) FILTER (WHERE level * weight < 3 * source_size) OVER () AS open_level,
    min(source_size::DOUBLE / weight) FILTER (WHERE level * weight < 3 * source_size) OVER () AS open_from FROM levels),
aimed AS (SELECT source, source_size, CASE WHEN source_size::DOUBLE / weight >= open_from THEN open_level * weight ELSE (3 * source_size)::DOUBLE END AS target FROM fixed),
planned AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9::DOUBLE) AS BIGINT) ELSE 0 END AS whole FROM aimed),
rests AS (SELECT *, greatest(0::DOUBLE, target - whole * source_size) AS rest FROM planned),
classes AS (SELECT source, least(size, 1000) AS k, sum(size)::DOUBLE AS words, (least(size, 1000) + 1::DOUBLE) / (least(size, 1000) + 51::DOUBLE) AS lean FROM sized WHERE size > 0 GROUP BY ALL),
tried AS (SELECT source, k, lean, coalesce(sum(words) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS certain,
    sum(words * lean) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS favoured FROM classes),
factors AS (SELECT r.source, greatest(0::DOUBLE, round(max_by((r.rest - certain) / favoured, k) FILTER (WHERE (r.rest - certain) / favoured * lean <= 1), 12)) AS scale
  FROM rests r JOIN tried t ON r.source IS NOT DISTINCT FROM t.source GROUP BY r.source),
drawn AS (SELECT s.*, least(1::DOUBLE, scale * ((least(size, 1000) + 1::DOUBLE) / (least(size, 1000) + 51::DOUBLE))) AS p,
    length(bin(size)) * 16 + (size >> greatest(0, length(bin(size)) - 4)) AS stratum
  FROM sized s JOIN factors f ON s.source IS NOT DISTINCT FROM f.source WHERE size > 0),
strata AS (SELECT source, stratum, count(*) AS n, sum(size)::DOUBLE AS words, round(sum(size * p), 6) AS expected,
    row_number() OVER (PARTITION BY source ORDER BY stratum DESC) AS j FROM drawn GROUP BY source, stratum),
fold AS (
  SELECT source, stratum, j, least(n, greatest(0, floor(expected / (words / n) + 0.5::DOUBLE))) AS m, expected - least(n, greatest(0, floor(expected / (words / n) + 0.5::DOUBLE))) * (words / n) AS rest FROM strata WHERE j = 1
  UNION ALL
  SELECT s.source, s.stratum, s.j, least(s.n, greatest(0, floor((s.expected + f.rest) / (s.words / s.n) + 0.5::DOUBLE))),
    s.expected + f.rest - least(s.n, greatest(0, floor((s.expected + f.rest) / (s.words / s.n) + 0.5::DOUBLE))) * (s.words / s.n)
  FROM fold f JOIN strata s ON s.source IS NOT DISTINCT FROM f.source AND s.j = f.j + 1),
ranked AS (SELECT doc_id, source, size, stratum, rank() OVER (PARTITION BY source, stratum ORDER BY u * (1::DOUBLE - p) / (u * (1::DOUBLE - p) + p * (1::DOUBLE - u))) AS place FROM drawn),
sampled AS (SELECT r.doc_id, r.source, r.size, CAST(r.place <= f.m AS BIGINT) AS more FROM ranked r JOIN fold f ON r.source IS NOT DISTINCT FROM f.source AND r.stratum = f.stratum
  UNION ALL SELECT doc_id, source, size, 0 FROM sized WHERE size = 0)
SELECT s.doc_id, s.size, p.source_size, p.target, CAST(s.size * (p.whole + s.more) AS BIGINT) AS taken FROM sampled s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
"""
