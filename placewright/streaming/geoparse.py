"""Incremental geoparsing, an addition to the batch engine: a stream of texts, names extracted, places joined from a static gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def mentions(stream: DataFrame, places: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, place_id) of each arriving text (key, text). Stateless: a static join of names by their normalized form."""
    names = stream.select(key, F.explode(F.array_distinct(text.pattern_names(F.col("text")))).alias("name")).withColumn("name_normalized", text.normalize(F.col("name")))
    return names.join(places.select(F.col("id").alias("place_id"), "name_normalized"), "name_normalized").select(key, "name", "place_id")


def counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts by window of a stream with a bound on lateness."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
