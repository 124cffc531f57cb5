"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Texts become 64-bit fingerprints of their 3-word shingles; two link if at most RADIUS = 3 bits differ. Every fingerprint
emits variants of itself, fingerprints that share a variant collide, and the colliding ones are verified and linked:

- all emit their 64 variants with one bit flipped; two that share one differ in 2 bits. Linking each to the smallest
  with that variant links all of them;
- fingerprints with an odd number of set bits also emit themselves and variants with two bits flipped. They meet the
  one-bit variants of even ones, which differ from them in 1 or 3 bits (these have the other parity). Of 3 differing bits
  two always lie in the same half, so only pairs within a half are flipped: 992 instead of 2016.

Variants with two flipped bits are dealt by their other half, which is as it was: the fingerprint travels once a half and its
variants are made where they are met, so little is shuffled and it doesn't depend on how well variants compress.

A variant belongs to 64 + 993 fingerprints at most, so no group on a variant is large, whatever the texts are. Edges go
to one representative a variant: their number grows with the emitted variants, never with the square of a group.
Components come from alternating large and small stars, whose rounds are written to the shared folder.

Defined results: null and empty texts have fingerprint zero and are linked like any other; exact copies share a
fingerprint and are handled once; a null doc_id never names a component unless all of its ids are null; an empty table
gives an empty result. `keep_one` keeps the row with the smallest (doc_id, text hash) of each component with all its
columns; of repeated rows it keeps one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, settled, small_batches, table, unpacked, with_rows, without_rows, written

RADIUS = 3
SEED = 42
SHINGLE = 3
#: Shingles whose bits are counted at once.
_CHUNK = 65_536
#: Fingerprints that share a half, beyond which its route is split, the lanes of a route at most, and fingerprints a task (about 1,100 rows each).
LANE, MOST_LANES, FINGERPRINTS_A_TASK = 4_096, 4_096, 4_000
#: Tables of split routes up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROUTES = 100_000


def fingerprint(text: str | None) -> int:
    """A bit is set if it is set in over half the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(s), SEED) for s in zip(words, words[1:], words[2:], strict=False)), np.uint64, len(words) - 2)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK].astype(">u8").view(np.uint8)
        counts += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """keys and fp, the fingerprint as a signed long, of a table of keys and text."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(found.view(np.int64))], names=[*names, "fp"])

    schema = docs.select(*names).schema.add("fp", "long")
    return docs.select(*names, "text").mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


ONE = [_signed(1 << i) for i in range(64)]
#: The bits of each half; for each half nothing, one bit and two bits of it flipped.
HALF = [_signed(0xFFFFFFFF), _signed(0xFFFFFFFF << 32)]
ONES = [[_signed(1 << i) for i in range(h, h + 32)] for h in (0, 32)]
TWOS = [[_signed(1 << i | 1 << j) for i in range(h, h + 32) for j in range(i + 1, h + 32)] for h in (0, 32)]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _met(nodes: DataFrame) -> DataFrame:
    """(fp, rep): an odd fingerprint with the smallest even one at each variant that both emit.

    A route is a half that may be flipped and the value of the other half. Even fingerprints go to the routes of themselves
    and of their variants in the other half, 33 for each half; odd ones to their own two. On a route an even one makes its
    variants with one bit of the half flipped (or, if a bit of the other half is, just that variant), an odd one those with
    two bits of the half flipped, and itself. A route of many fingerprints is split: its fingerprints go to several lanes,
    and on each lane only the variants that are dealt there by their hash are made.
    """
    spark = nodes.sparkSession
    rest = F.when(F.col("half") == 0, F.lit(HALF[1]).cast("bigint")).otherwise(F.lit(HALF[0]).cast("bigint"))
    halves = F.explode(F.array(F.lit(0), F.lit(1))).alias("half")
    own = nodes.select("fp", halves).withColumn("route", F.col("fp").bitwiseAND(rest))
    hot = own.groupBy("half", "route").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LANE)
    hot = settled(hot.select(F.col("half").alias("_h"), F.col("route").alias("_r"), F.least(F.lit(MOST_LANES), F.ceil(F.col("n") / LANE)).cast("int").alias("lanes")), "hot")
    n_hot = hot.count()

    #: Where each variant is made; lanes only if there are any, as a constant among the keys would part them from the partitioning.
    by = ["half", "route", *(["lane"] if n_hot else [])]

    def laned(df: DataFrame) -> DataFrame:
        if not n_hot:
            return df
        named = df.join(F.broadcast(hot) if n_hot <= BROADCAST_ROUTES else hot, (F.col("half") == F.col("_h")) & (F.col("route") == F.col("_r")), "left")
        return named.drop("_h", "_r").withColumn("lanes", F.coalesce("lanes", F.lit(1))).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))

    even = F.bit_count("fp") % 2 == 0
    other = F.when(F.col("half") == 0, _longs([0, *ONES[1]])).otherwise(_longs([0, *ONES[0]]))
    evens = nodes.where(even).select("fp", halves).select("fp", "half", F.explode(other).alias("flip"))
    evens = laned(evens.withColumn("route", F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(rest)))
    odds = laned(own.where(~even))
    #: An odd fingerprint makes 497 variants on a route, an even one 32 or one.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() // FINGERPRINTS_A_TASK)
    of_half = lambda masks: F.when(F.col("half") == 0, _longs(masks[0])).otherwise(_longs(masks[1]))
    mine = (F.col("lanes") == 1) | (F.pmod(F.xxhash64("variant"), F.col("lanes")) == F.col("lane")) if n_hot else F.lit(True)
    carried = [*by, *(["lanes"] if n_hot else []), "fp"]
    flips = F.when(F.col("flip") == 0, of_half(ONES)).otherwise(_longs([0]))
    evens = evens.repartition(tasks, *by).select(*carried, F.explode(flips).alias("_mask"), "flip")
    evens = evens.withColumn("variant", F.col("fp").bitwiseXOR(F.col("flip")).bitwiseXOR(F.col("_mask"))).where(mine)
    reps = evens.groupBy(*by, "variant").agg(F.min("fp").alias("rep")).select(*[F.col(c).alias(f"_{c}") for c in [*by, "variant"]], "rep")
    odds = odds.repartition(tasks, *by).select(*carried, F.explode(of_half([[0, *TWOS[0]], [0, *TWOS[1]]])).alias("_mask"))
    odds = odds.withColumn("variant", F.col("fp").bitwiseXOR(F.col("_mask"))).where(mine)
    #: Sorted, so it spills; the variant goes first, as it tells rows apart soonest.
    on = F.col("variant") == F.col("_variant")
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return odds.join(reps.hint("merge"), on).select("fp", "rep")


def _in_place(met: DataFrame) -> DataFrame:
    """met, written while joins may use a partitioning by some of their keys: the variants of a route are together already."""
    conf, name = met.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return settled(met, "met")
    finally:
        conf.set(name, before)


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, that connect all fingerprints of the column fp within RADIUS bits of one another."""
    single = nodes.select("fp", F.explode(_longs(ONE)).alias("_mask")).select("fp", F.col("fp").bitwiseXOR(F.col("_mask")).alias("variant"))
    shared = single.groupBy("variant").agg(F.min("fp").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("variant", "rep")
    pairs = single.join(settled(shared, "shared"), "variant").select("fp", "rep").unionByName(_in_place(_met(nodes)))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("rep"))).between(1, RADIUS)
    return pairs.where(near).select(F.greatest("fp", "rep").alias("a"), F.least("fp", "rep").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each vertex of edges, a > b, with the smallest one of its component, itself left out.

    Large star: each vertex hands its larger neighbours its smallest one; small star: likewise its smaller ones. After a
    number of rounds that grows with the logarithm of the size only stars are left. Both are a minimum by vertex, which is
    combined before the shuffle, and a join, whose hot keys adaptive execution splits.
    """
    spark = edges.sparkSession
    edges, path = written(edges, "edges")
    mark = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            return edges
        mark = tuple(state)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, step = written(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        joined = large.join(low, F.col("a") == F.col("u"))
        small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        old, (edges, path) = path, written(small, "small")
        discard(spark, old)
        discard(spark, step)


def classes(docs: DataFrame, *keys: str, least: Column) -> DataFrame:
    """keys, fp and class: for each row of docs (keys and text) the smallest `least` of its component. least is a column of keys, or a struct of them."""
    with small_batches(docs.sparkSession):
        rows = settled(fingerprints(docs, *keys), "fingerprints")
    nodes = settled(rows.groupBy("fp").agg(F.min(least).alias("low")), "nodes")
    stars = components(links(nodes))
    members = nodes.join(stars, F.col("fp") == F.col("a"), "left").select("fp", "low", F.coalesce("b", "fp").alias("root"))
    lows = members.groupBy("root").agg(F.min("low").alias("class")).withColumnRenamed("root", "_root")
    named = members.join(lows, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "class")
    return rows.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component."""
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_key"), "text")
    #: Nulls come last: a document with an id goes before.
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_text_key").alias("key"))
    found = settled(classes(keyed, "_id", "_text_key", least=order), "classes")
    first = (F.col("_text_key") == F.col("class.key")) & F.col("_id").eqNullSafe(F.col("class.id"))
    kept = without_rows(docs, found.where(~first))
    repeated = found.where(first).groupBy("_id", "_text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    #: Only the repeated rows are grouped, so no other text is shuffled.
    again = with_rows(docs, repeated, "left_semi").withColumn("_i", F.col("_doc").getField("doc_id")).withColumn("_k", F.xxhash64(F.col("_doc").getField("text")))
    once = again.groupBy("_i", "_k").agg(F.first("_doc").alias("_doc"))
    return without_rows(kept, repeated).unionByName(unpacked(once, docs.columns))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", least=F.col("doc_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("class").alias("component_id"))


#: XXH64's five primes, fixed by its definition.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_MASK = f"{(1 << 64) - 1}::UHUGEINT"


def _mod(x: str) -> str:
    return f"(({x}) & {_MASK})"


def _rotated(x: str, n: int) -> str:
    """x must be a name: it is used twice."""
    return f"((({x} << {n}) & {_MASK}) | ({x} >> {64 - n}))"


def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _round(acc: str, lane: str) -> str:
    return _let("r", _mod(f"{acc} + {_mod(f'{lane} * {_P2}::UHUGEINT')}"), _mod(f"{_rotated('r', 31)} * {_P1}::UHUGEINT"))


def _lanes(first: str, last: str, step: int, width: int) -> str:
    """Little-endian numbers of width bytes from the offsets first, first + step and so on below last."""
    value = " + ".join(f"(b[o + {i + 1}]::UHUGEINT << {8 * i})" for i in range(width))
    return f"list_transform(range({first}, {last}, {step}), lambda o: {value})"


def _folded(start: str, lanes: str, step: str) -> str:
    """step, of h and x, over the lanes, from start."""
    return f"list_reduce(list_concat([{start}], {lanes}), lambda h, x: {step})"


def _merged(h: str, v: str) -> str:
    return _mod(f"{_mod(f'xor({h}, {_round('0::UHUGEINT', v)}) * {_P1}::UHUGEINT')} + {_P4}::UHUGEINT")


_STARTS = [(SEED + _P1 + _P2) % (1 << 64), (SEED + _P2) % (1 << 64), SEED, (SEED - _P1) % (1 << 64)]
_STRIPES = ", ".join(f"{_folded(f'{v}::UHUGEINT', _lanes(str(8 * i), '32 * (n // 32)', 32, 8), _round('h', 'x'))} AS v{i}" for i, v in enumerate(_STARTS))
_CONVERGED = _mod(" + ".join(_rotated(f"v{i}", r) for i, r in enumerate((1, 7, 12, 18))))
_EIGHT = _let("g", f"xor(h, {_round('0::UHUGEINT', 'x')})", _mod(f"{_mod(f'{_rotated("g", 27)} * {_P1}::UHUGEINT')} + {_P4}::UHUGEINT"))
_FOUR = _let("g", f"xor(h, {_mod(f'x * {_P1}::UHUGEINT')})", _mod(f"{_mod(f'{_rotated("g", 23)} * {_P2}::UHUGEINT')} + {_P3}::UHUGEINT"))
_BYTE = _let("g", f"xor(h, {_mod(f'x * {_P5}::UHUGEINT')})", _mod(f"{_rotated('g', 11)} * {_P1}::UHUGEINT"))
#: XXH64 from its definition, bits counted one by one, and all pairs of fingerprints compared.
ORACLE = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (SELECT row, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) END) AS s FROM docs),
counted AS (SELECT row, s, count(*) AS times FROM shingled GROUP BY row, s),
texts AS MATERIALIZED (SELECT s, flatten(list_transform(list_transform(string_split(s, ''), lambda c: unicode(c)::BIGINT), lambda c: CASE WHEN c < 128 THEN [c] WHEN c < 2048 THEN [192 + (c >> 6), 128 + (c & 63)]
    WHEN c < 65536 THEN [224 + (c >> 12), 128 + ((c >> 6) & 63), 128 + (c & 63)] ELSE [240 + (c >> 18), 128 + ((c >> 12) & 63), 128 + ((c >> 6) & 63), 128 + (c & 63)] END)) AS b
  FROM (SELECT DISTINCT s FROM counted)),
sized AS (SELECT *, len(b) AS n FROM texts),
striped AS MATERIALIZED (SELECT *, {_STRIPES} FROM sized),
begun AS MATERIALIZED (SELECT s, b, n, CASE WHEN n < 32 THEN {(SEED + _P5) % (1 << 64)}::UHUGEINT ELSE {_merged(_merged(_merged(_merged("c", "v0"), "v1"), "v2"), "v3")} END AS h0
  FROM (SELECT *, {_CONVERGED} AS c FROM striped)),
eights AS MATERIALIZED (SELECT s, b, n, {_folded(_mod("h0 + n::UHUGEINT"), _lanes("32 * (n // 32)", "n - 7", 8, 8), _EIGHT)} AS h1 FROM begun),
fours AS MATERIALIZED (SELECT s, b, n, {_folded("h1", _lanes("8 * (n // 8)", "n - 3", 4, 4), _FOUR)} AS h2 FROM eights),
ones AS MATERIALIZED (SELECT s, {_folded("h2", _lanes("4 * (n // 4)", "n", 1, 1), _BYTE)} AS h3 FROM fours),
mixed AS (SELECT s, {_mod(f"xor(h3, h3 >> 33) * {_P2}::UHUGEINT")} AS h4 FROM ones),
mixed_again AS (SELECT s, {_mod(f"xor(h4, h4 >> 29) * {_P3}::UHUGEINT")} AS h5 FROM mixed),
hashes AS MATERIALIZED (SELECT s, xor(h5, h5 >> 32)::UBIGINT AS h FROM mixed_again),
sums AS (SELECT row, sum(times) AS n, {", ".join(f"sum(times) FILTER (WHERE (h >> {i}) & 1 = 1) AS n{i}" for i in range(64))} FROM counted JOIN hashes USING (s) GROUP BY row),
prints AS MATERIALIZED (SELECT doc_id, CAST(coalesce({" + ".join(f"CASE WHEN 2 * n{i} > n THEN {1 << i}::UHUGEINT ELSE 0 END" for i in range(64))}, 0) AS UBIGINT) AS fp FROM docs LEFT JOIN sums USING (row)),
nodes AS MATERIALIZED (SELECT fp, min(doc_id) AS low FROM prints GROUP BY fp),
linked AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON bit_count(xor(a.fp, b.fp)::BIT) <= {RADIUS}),
reached(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a),
lows AS (SELECT a AS fp, min(low) AS component_id FROM reached JOIN nodes ON b = fp GROUP BY a)
SELECT doc_id, printf('%016x', fp) AS fingerprint, component_id FROM prints JOIN lows USING (fp)
"""
