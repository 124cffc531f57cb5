"""Jobs around the tables: datasets, ranks, topics, single places, and small lookups of the service."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import simplify, text
from ..operators import analytics, gazetteer, layers


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a table: candidates, accuracy log rows."""
    df.write.mode("append").parquet(path)


def replace_ranks(linked: DataFrame, path: str) -> None:
    """Country ranks of the orders in linked, in place of their old ones; other orders' partitions stay."""
    ranks = analytics.country_ranks(linked)
    ranks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("order_id").parquet(path)


def normalized(places: DataFrame) -> DataFrame:
    """places with name_normalized from name_ascii, or the name where there is none."""
    source = F.coalesce("name_ascii", "name") if "name_ascii" in places.columns else F.col("name")
    return places.withColumn("name_normalized", text.fold(source))


def reset_topics(df: DataFrame) -> DataFrame:
    return df.withColumn("topic_id", F.lit(None).cast("int"))


def add_alias(aliases: DataFrame, places: DataFrame, place_name: str, alias: str) -> DataFrame:
    """aliases (alias, place_id) with one more name of the places so called."""
    more = places.where(F.col("name") == place_name).select(F.lit(alias).alias("alias"), F.col("id").alias("place_id"))
    return gazetteer.get_or_create(aliases, more, "alias", "place_id")


def trimmed_countries(places: DataFrame) -> DataFrame:
    """Names of countries (level 0) without blanks at the ends."""
    return places.withColumn("name", F.when(F.col("admin_level") == 0, F.trim("name")).otherwise(F.col("name")))


def simplified(shapes: DataFrame, tolerance: float = 0.02, column: str = "mpoly") -> DataFrame:
    """shapes with rings simplified so that none come to cross; a ring that would collapse keeps a third corner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            out = []
            for mpoly in batch.column(at).to_pylist():
                rings = [[(p["x"], p["y"]) for p in ring] for poly in mpoly or [] for ring in poly]
                done = iter(simplify.simplified(rings, tolerance))
                out.append(mpoly and [[[{"x": x, "y": y} for x, y in next(done)] for _ in poly] for poly in mpoly])
            columns = [pa.array(out, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return shapes.mapInArrow(run, shapes.schema)


def load_dataset(layer: DataFrame, name: str, places: DataFrame, countries: DataFrame | None = None) -> dict[str, DataFrame]:
    """A layer's rows matched with places: links of the matched, the new places, their aliases, and parent links.

    The country comes from a sample of features if the polygons of countries agree on one.
    """
    code = None
    if countries is not None and {"lon", "lat"} <= set(layer.columns):
        sample = gazetteer.inside(layer.select("lon", "lat").limit(20), countries.select(F.col("id").alias("pid"), "country_code", "west", "east", "south", "north"))
        found = analytics.one_country(sample.select("country_code")).first()
        code = found.country_code if found else None
    rows = layers.load_layer(layer, name, code).withColumn("input_id", F.xxhash64("name", F.coalesce("pcode", F.lit(""))))
    matched = gazetteer.match_places(rows, places) if {"lon", "lat"} <= set(rows.columns) else places.sparkSession.createDataFrame([], "input_id long, place_id long, match_rank int")
    new = rows.join(matched.select("input_id"), "input_id", "left_anti")
    named = rows.join(matched, "input_id", "left").withColumn("place_id", F.coalesce("place_id", "input_id"))
    alias = named.select("place_id", F.explode("aliases").alias("alias")).where(F.length("alias") > 2).distinct()
    coded = named.select(F.col("place_id").alias("id"), "pcode", "parent_pcode")
    return {"links": matched, "new": new, "aliases": alias, "parents": gazetteer.parents(coded)}


def conflate_one(places: DataFrame, name: str, lat: float, lon: float, population: int | None = None, country_code: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(places after one place went in, the id it has): the best same-name place within 10 km or a new one."""
    row = places.sparkSession.createDataFrame([(1, name, lat, lon, country_code, population)], "input_id long, name string, lat double, lon double, country_code string, population long")
    found = gazetteer.best(gazetteer.candidates_nearby(row, places, exact=False, few=True), "input_id").select("place_id")
    last = places.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next"))
    return gazetteer.conflate(row, places, few=True), last.join(found, F.lit(True), "left").select(F.coalesce("place_id", "next").alias("id"))


def in_osm(osm: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (name, and country or null) with found: whether the OSM names hold the name, in the country if one is given."""
    anywhere = osm.select(F.col("name").alias("_n")).distinct().withColumn("_any", F.lit(True))
    there = osm.select(F.col("name").alias("_m"), F.col("country").alias("_c")).distinct().withColumn("_there", F.lit(True))
    out = wanted.join(anywhere, F.col("name") == F.col("_n"), "left").join(there, (F.col("name") == F.col("_m")) & (F.col("country") == F.col("_c")), "left")
    return out.select(*wanted.columns, F.coalesce(F.when(F.col("country").isNull(), F.col("_any")).otherwise(F.col("_there")), F.lit(False)).alias("found"))


def order_of_url(orders: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, order_id) of referring urls; null where an order is to be made."""
    return urls.join(orders.groupBy("url").agg(F.min("id").alias("order_id")), "url", "left").select("url", "order_id")


def expired(created: Column, days: int = 7) -> Column:
    """Whether an activation is older than so many days."""
    return F.datediff(F.current_date(), created) > days


def map_exists(spark: SparkSession, path: str, map_format: str) -> bool:
    """Whether a map was written and committed."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{map_format}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty table of the schema so named, as a start."""
    return spark.createDataFrame([], getattr(schema, name))
