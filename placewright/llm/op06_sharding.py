"""Sharding by rendezvous hashing.

Each record key draws a number for every shard; the shard with the best weighted draw takes the record. A new shard
can only win records for itself, so all others stay where they are.

Slots are drawn by key and text alone, so they don't depend on how the table is laid out in files. Only rows that are equal
in both draw by their place too: they would share a draw, and any number of them would meet in one task.

Defined results: a null key is a key of its own; null text has no bytes and counts as empty in the checksum; repeated
rows go to the same shard and get slots of their own in any order; empty tables give empty tables; a column of the
input that is called like the new one stays beside it, with underscores before its name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, fresh, settled, table, uniform, without

SALT = "shard"
ROWS_A_TASK = 50_000


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the largest -weight / ln(u). Its share of the keys is its share of the weights."""
    if not weights or min(weights) <= 0:
        raise ValueError("shard weights must be positive")
    shards = F.array(*[F.struct(F.lit(j).alias("shard"), F.lit(-float(w)).alias("w")) for j, w in enumerate(weights)])
    draw = lambda s: F.struct((s["w"] / F.ln(uniform(s["shard"], key, salt=SALT))).alias("score"), s["shard"].alias("shard"))
    return F.array_max(F.transform(shards, draw))["shard"]


def assign(docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 16, column: str = "shard") -> DataFrame:
    """docs with the shard of each row. No shuffle."""
    kept = [c.alias(fresh(docs, name)) if name.lower() == column.lower() else c for name, c in zip(docs.columns, without(docs), strict=True)]
    return docs.select(*kept, winner(F.col(f"`{key.replace('`', '``')}`"), weights).alias(column))


def number(df: DataFrame, group: str, order: Column, ties: Sequence[Column], column: str, total: int) -> DataFrame:
    """df with gapless numbers from 0 within each group, in the order of a draw from (0, 1) and then ties.

    The draw cuts each group into slices of about ROWS_A_TASK rows; slices are counted, the counts summed up, and
    rows numbered within their slice. So a group of any size is spread over many tasks, if the draws are.
    """
    slices = max(1, total // ROWS_A_TASK)
    cut = df.withColumn("_draw", order).withColumn("_slice", F.floor(F.col("_draw") * slices).cast("int"))
    counts = cut.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_slice").orderBy("_draw", *ties)
    numbered = cut.withColumn("_row", F.row_number().over(within))
    joined = numbered.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s")))
    return joined.withColumn(column, (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_draw", "_slice", "_g", "_s", "_start", "_row")


def told_apart(rows: DataFrame, place: str, *keys: str) -> DataFrame:
    """rows with the place of those only that share their keys with others; null for the rest."""
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = settled(repeated.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_again")), "repeated")
    n = repeated.count()
    if n == 0:
        return rows.withColumn(place, F.lit(None).cast("long"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(F.broadcast(repeated) if n <= BROADCAST_KEYS else repeated, same, "left")
    return joined.withColumn(place, F.when(F.col("_again"), F.col(place))).drop("_again", *[f"_k{i}" for i in range(len(keys))])


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 16) -> None:
    """Writes docs as one folder a shard."""
    assign(docs, key, weights).write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    #: The place is written, so it stays.
    slim = told_apart(settled(assign(slim).withColumn("_place", F.monotonically_increasing_id()), "shards"), "_place", "doc_id", "text_crc32")
    numbered = number(slim, "shard", uniform(F.col("doc_id"), F.col("text_crc32"), F.col("_place"), salt="slot"), [F.col("doc_id"), F.col("_place")], "slot", slim.count())
    grown = winner(F.col("doc_id"), (1.0,) * 17)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


#: A checksum's table from its polynomial, and texts as UTF-8 bytes from their code points. It holds where no two rows are equal in id and text.
ORACLE = """
WITH steps AS (SELECT list(list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS step FROM range(256) r(i)),
points AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN coalesce(text, '') = '' THEN [] ELSE list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT) END AS u FROM documents),
coded AS (SELECT doc_id, t, flatten(list_transform(u, lambda c: CASE WHEN c < 128 THEN [c] WHEN c < 2048 THEN [192 + (c >> 6), 128 + (c & 63)]
    WHEN c < 65536 THEN [224 + (c >> 12), 128 + ((c >> 6) & 63), 128 + (c & 63)]
    ELSE [240 + (c >> 18), 128 + ((c >> 12) & 63), 128 + ((c >> 6) & 63), 128 + (c & 63)] END)) AS b FROM points),
summed AS (SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, step[xor(c & 255, x) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM coded, steps),
named AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), chr(1)) AS key, row_number() OVER () AS row FROM summed),
draws AS (SELECT row, j, substr(md5('shard|' || j || '|' || key), 1, 13) AS u FROM named, range(17) r(j)),
won AS (SELECT row, arg_max(j, u) FILTER (WHERE j < 16) AS shard, arg_max(j, u) AS grown_shard FROM draws GROUP BY row)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY substr(md5('slot|' || key || '|' || text_crc32 || '|' || chr(1)), 1, 13), doc_id) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM named JOIN won USING (row)
"""
