"""What the operators of this subpackage share: word splitting, stable random numbers, written intermediates."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; `lower` would fold other scripts too."""
    return F.translate(text, _UPPER, _UPPER.lower())


def alnum_words(text: Column) -> Column:
    """Words of digits, lower-cased ASCII letters and everything beyond ASCII; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), "")


def plain_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space, without making the words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def uniform(*key: Column, salt: str) -> Column:
    """A number in (0, 1) that depends on the key and the salt alone. Any engine with md5 gives the same one."""
    parts = [F.coalesce(k.cast("string"), F.lit("\x01")) for k in key]
    digest = F.md5(F.concat_ws("|", F.lit(salt), *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df but those named, as columns that survive odd names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in names]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_order(df: DataFrame, *order: Column, **sums: Column) -> DataFrame:
    """df with _nth, the number of rows before each in a global order, and for each of sums its total over the rows before.

    Rows are sorted by ranges, and each range starts with the totals of those before it: no task holds all rows.
    """
    ranges = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    totals = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_n{i}") for i, c in enumerate(sums.values())])
    #: A row for each range, of which there are spark.sql.shuffle.partitions at most.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_n{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in ("", *range(len(sums)))])
    within = Window.partitionBy("_range").orderBy(*order)
    behind = within.rowsBetween(Window.unboundedPreceding, -1)
    named = [(F.col(f"_s{i}") + F.coalesce(F.sum(c).over(behind), F.lit(0))).alias(name) for i, (name, c) in enumerate(sums.items())]
    joined = ranges.join(F.broadcast(starts), F.col("_range") == F.col("_r"))
    return joined.select(*without(df), (F.col("_s") + F.row_number().over(within) - 1).alias("_nth"), *named)


def fence(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns computed here: filters from above aren't moved below this point, which would compute the columns again, within loops over arrays even for each element."""
    return df.select(*without(df, *names), F.inline_outer(F.array(F.struct(*[F.col(n) for n in names]))))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256):
    """Within it, rows go to Python in small batches: those of whole texts would hold a large part of a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Keys of rows to drop are broadcast up to so many, about 40 bytes each; more are joined by shuffle.
BROADCAST_KEYS = 500_000


def with_rows(docs: DataFrame, keys: DataFrame, how: str, *more: str) -> DataFrame:
    """docs joined (left_anti, left_semi, left) with keys (_id, _text_key, more) by doc_id and text hash, as a struct _doc of all columns and more.

    Texts are shuffled only if the keys are many.
    """
    keys = settled(keys.select("_id", "_text_key", *more), "keys")
    few = keys.count() <= BROADCAST_KEYS
    keys = keys.select(F.col("_id").alias("_k"), F.col("_text_key").alias("_h"), *more)
    rows = docs.select(F.struct(*without(docs)).alias("_doc"), F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_t"))
    joined = rows.join(F.broadcast(keys) if few else keys, F.col("_i").eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_h")), how)
    return joined.select("_doc", *more)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the struct _doc."""
    return rows.select(*[F.col("_doc").getField(c).alias(c) for c in columns])


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text hash are in gone (_id, _text_key)."""
    return unpacked(with_rows(docs, gone.distinct(), "left_anti"), docs.columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a local master without that setting, a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="placewright-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir() or folder
    return folder


_written: list[tuple[SparkSession, str]] = []


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is removed when the session's program ends."""
    path = f"{shared_folder(spark)}/placewright/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read again: the lineage ends there and lost executors cost nothing. Gives the path too."""
    path = passing_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def settled(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]
