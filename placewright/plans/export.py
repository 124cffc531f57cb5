"""Training data: links of pages as features, with every place of the same name as a candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def training(titles: DataFrame, places: DataFrame) -> DataFrame:
    """(page_id, position, title, place_id, correct): a mention's place and all others with its normalized name.

    Of several places with a title the last by name and id counts.
    """
    p = places.where(F.col("enwiki_title").isNotNull()).groupBy("enwiki_title").agg(F.max_by(F.struct("id", "name_normalized"), F.struct("name", "id")).alias("_p"))
    hits = titles.join(p, F.col("title") == F.col("enwiki_title")).select("page_id", "position", "title", F.col("_p.id").alias("_correct"), F.col("_p.name_normalized").alias("_nn"))
    same = places.select(F.col("id").alias("place_id"), F.col("name_normalized"))
    return hits.join(same, F.col("_nn") == F.col("name_normalized")).select("page_id", "position", "title", "place_id", (F.col("place_id") == F.col("_correct")).alias("correct"))


def numbered(rows: DataFrame) -> DataFrame:
    """training() with feature numbers by page: features of a page are numbered by position, so no global order is needed."""
    feature = F.dense_rank().over(Window.partitionBy("page_id").orderBy("position"))
    return rows.withColumn("feature_no", feature).withColumn("featureplace_no", F.row_number().over(Window.partitionBy("page_id").orderBy("position", "place_id")))


def decisions(orders: DataFrame, feature: DataFrame, featureplace: DataFrame, places: DataFrame) -> DataFrame:
    """Every candidate of every feature with its order and the fields of its place; popularity is as it was at the time."""
    f = feature.select(F.col("id").alias("feature_id"), "order_id", "verified")
    fp = featureplace.select(F.col("id").alias("featureplace_id"), "feature_id", "place_id", "confidence", "correct")
    p = places.select(F.col("id").alias("place_id"), *[F.col(c).alias("popularity_at_decision_time" if c == "popularity" else c) for c in places.columns if c != "id"])
    return orders.select(F.col("id").alias("order_id")).join(f, "order_id").join(fp, "feature_id").join(p, "place_id")
