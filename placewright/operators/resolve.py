"""From names to places: candidates by name, alias and edit distance, their scores, and the choice among them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Name lists up to so many rows are broadcast.
BROADCAST_NAMES = 50_000


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it's known to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else df


def country_ranking(names: DataFrame, places: DataFrame) -> DataFrame:
    """(country_code, n, ccrank): countries of the places so named, most frequent first, equal ones by code."""
    found = places.join(_small(names.select("name").distinct()), "name", "left_semi").where(F.col("country_code").isNotNull())
    counts = found.groupBy("country_code").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ccrank", F.row_number().over(Window.orderBy(F.desc("n"), "country_code")))


def _geoentity(df: DataFrame, target: Column, distance: Column, alias: Column) -> DataFrame:
    return df.select(F.col("id").alias("place_id"), "admin_level", "country_code", target.alias("target"), distance.cast("int").alias("edit_distance"), F.col("name").alias("place_name"), alias.cast("string").alias("alias"), "population", "lon", "lat", "feature_code", F.col("charcount").alias("notability"), "importance")


def by_name(names: DataFrame, places: DataFrame, wikipedia: DataFrame) -> DataFrame:
    found = places.where(F.col("lon").isNotNull()).join(_small(names.select("name").distinct()), "name", "left_semi")
    return _geoentity(_noted(found, wikipedia), F.col("name"), F.lit(0), F.lit(None))


def _noted(found: DataFrame, wikipedia: DataFrame) -> DataFrame:
    return found.join(wikipedia.select(F.col("place_id").alias("_w"), "charcount"), F.col("id") == F.col("_w"), "left").drop("_w")


def by_alias(names: DataFrame, places: DataFrame, aliases: DataFrame, wikipedia: DataFrame) -> DataFrame:
    """aliases: alias, place_id. The alias is filtered before it meets its places."""
    wanted = aliases.join(_small(names.select(F.col("name").alias("alias")).distinct()), "alias", "left_semi").select("alias", F.col("place_id").alias("_p"))
    found = places.where(F.col("lon").isNotNull()).join(wanted, F.col("id") == F.col("_p")).drop("_p")
    return _geoentity(_noted(found, wikipedia), F.col("alias"), F.lit(0), F.col("alias"))


def _piece(name: Column, start: Column, length: Column) -> Column:
    return F.substr(name, start + 1, length)


def pieces(target: Column, most: int) -> Column:
    """The pieces of a target, most + 1 of about equal length: an array of (first, len, k, piece). Whatever is within `most` edits holds one of them."""
    n = F.length(target)
    starts = [F.floor(n * k / (most + 1)).cast("int") for k in range(most + 2)]
    return F.array(*[F.struct(F.substring(target, 1, 1).alias("first"), n.alias("len"), F.lit(k).alias("k"), _piece(target, starts[k], starts[k + 1] - starts[k]).alias("piece")) for k in range(most + 1)])


def possible_pieces(name: Column, most: int) -> Column:
    """The same for a name to be found: its parts where the k-th piece of a target can stand.

    A target's length differs by `most` at most. Of the edits, at most k can stand before the first piece that is whole and at most
    most - k behind it, so it's shifted by k at most from the left, and from the right by most - k: 19 parts for two edits.
    """
    m = F.length(name)
    out = []
    for longer in range(-most, most + 1):
        n = m - longer
        starts = [F.floor(n * k / (most + 1)).cast("int") for k in range(most + 2)]
        for k in range(most + 1):
            size = starts[k + 1] - starts[k]
            for shift in range(max(-k, longer - (most - k)), min(k, longer + (most - k)) + 1):
                at = starts[k] + shift
                part = F.struct(F.substring(name, 1, 1).alias("first"), n.alias("len"), F.lit(k).alias("k"), _piece(name, at, size).alias("piece"))
                out.append(F.when((n > 0) & (at >= 0) & (at + size <= m), part))
    return F.array_distinct(F.array_compact(F.array(*out)))


def by_distance(names: DataFrame, places: DataFrame, wikipedia: DataFrame, countries: DataFrame | None = None, most: int = 2) -> DataFrame:
    """Places within `most` edits of a name, each with its nearest (then smallest) target; exact names are left out.

    Pairs are made only where the first letter and the country (if given) agree and where a name holds a piece of the target at
    its place, which every pair within so many edits does; each distinct name is met once.
    """
    wanted = names.select(F.col("name").alias("target")).where(F.col("target") != "").distinct()
    keys = wanted.select("target", F.inline(pieces(F.col("target"), most)))
    p = places.where(F.col("lon").isNotNull()).join(_small(names.select("name").distinct()), "name", "left_anti")
    if countries is not None:
        p = p.join(_small(countries.select("country_code").distinct()), "country_code", "left_semi")
    held = p.select("name").distinct().select("name", F.inline(possible_pieces(F.col("name"), most)))
    pairs = held.join(_small(keys), ["first", "len", "k", "piece"]).withColumn("_d", F.levenshtein("name", "target", most)).where("_d >= 0")
    best = pairs.groupBy("name").agg(F.min(F.struct("_d", "target")).alias("_t"))
    found = p.join(best, "name").withColumn("target", F.col("_t.target")).withColumn("_d", F.col("_t._d")).drop("_t")
    return _geoentity(_noted(found, wikipedia), F.col("target"), F.col("_d"), F.lit(None))


def resolve(names: DataFrame, places: DataFrame, aliases: DataFrame, wikipedia: DataFrame, thorough: bool = False, countries: DataFrame | None = None) -> DataFrame:
    """Candidates by name, by alias and, if thorough, by edit distance in the most frequent country. A place found twice appears twice.

    countries: names of countries; only places in them count in the first two branches.
    """
    ranks = country_ranking(names, places)
    here = places
    if countries is not None:
        codes = places.where("admin_level = 0").join(countries.select("name"), "name", "left_semi").select("country_code").distinct()
        here = places.join(codes, "country_code", "left_semi")
    out = by_name(names, here, wikipedia).unionByName(by_alias(names, here, aliases, wikipedia))
    if thorough:
        out = out.unionByName(by_distance(names, places, wikipedia, ranks.where("ccrank = 1")))
    return out.join(ranks.select(F.col("country_code").alias("_c"), "ccrank"), F.col("country_code") == F.col("_c"), "left").drop("_c")


def candidates(target: str, order_id: int, ranks: DataFrame, places: DataFrame, aliases: DataFrame, wikipedia: DataFrame, thorough: bool = False) -> DataFrame:
    """Candidates of one name for an order: ccrank is the order's rank of the country (order_id, country_code, rank)."""
    names = places.sparkSession.createDataFrame([(target,)], "name string")
    mine = ranks.where(F.col("order_id") == order_id)
    out = by_name(names, places, wikipedia).unionByName(by_alias(names, places, aliases, wikipedia))
    if thorough:
        out = out.unionByName(by_distance(names, places, wikipedia, mine.where("rank = 0").select("country_code")))
    return out.join(mine.select(F.col("country_code").alias("_c"), F.col("rank").alias("ccrank")), F.col("country_code") == F.col("_c"), "left").drop("_c")


def typed(rows: DataFrame) -> DataFrame:
    """Candidates as features of a model: defaults for nulls, flags, upper-case codes. Only a missing rank becomes 999, not rank 0."""
    return rows.select(
        "place_id",
        F.col("admin_level").cast("string").alias("admin_level"),
        F.upper("country_code").alias("country_code"),
        F.coalesce("ccrank", F.lit(999)).alias("ccrank"),
        "target",
        F.coalesce("edit_distance", F.lit(0)).alias("edit_distance"),
        "place_name",
        "alias",
        F.coalesce("population", F.lit(0)).cast("long").alias("population"),
        F.coalesce("notability", F.lit(0)).cast("long").alias("notability"),
        F.coalesce("importance", F.lit(0.0)).alias("importance"),
        (F.coalesce("importance", F.lit(0.0)) > 0.5).alias("is_important"),
        F.upper("feature_code").alias("feature_code"),
    )


def default_score(df: DataFrame) -> Column:
    """A transparent score in (0, 1): population and importance up, administrative depth and country rank down."""
    has = lambda c: c in df.columns
    part = F.lit(0.0)
    if has("population"):
        part = part + 0.4 * F.ln(F.coalesce("population", F.lit(0)).cast("double") + 1) / F.ln(F.lit(1e9))
    if has("importance"):
        part = part + 0.3 * F.coalesce("importance", F.lit(0.0)) / (F.coalesce("importance", F.lit(0.0)) + 1000.0)
    if has("admin_level"):
        part = part + 0.2 / (F.coalesce("admin_level", F.lit(6)) + 1.0)
    if has("ccrank"):
        part = part + 0.1 / (F.coalesce("ccrank", F.lit(999)).cast("double") + 1)
    return F.round(F.least(F.lit(0.9999), part), 4)


def trained_score(training: DataFrame, features: list[str], label: str = "correct"):
    """A logistic model of training rows; gives a function that adds `score` to candidates."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_z")]).fit(training.fillna(0.0, features).withColumn("_y", F.col(label).cast("double")))
    return lambda df: model.transform(df.fillna(0.0, features)).withColumn("score", F.round(vector_to_array("_p")[1], 4)).drop("_x", "_r", "_p", "_z")


def mark_correct(scored: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """correct: the score is the largest of its group; equal ones are all correct. The maximum is combined before the shuffle."""
    top = scored.groupBy(*by).agg(F.max(score).alias("_top")).select(*[F.col(b).alias(f"_{b}") for b in by], "_top")
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return scored.join(top, same).withColumn("correct", F.col(score).eqNullSafe(F.col("_top"))).drop("_top", *[f"_{b}" for b in by])


def resolve_locations(locations: DataFrame, places: DataFrame, score: Callable[[DataFrame], Column] = default_score, sum_counts: bool = False) -> tuple[DataFrame, DataFrame]:
    """feature and featureplace tables of locations (order_id, name, position, and maybe count, context).

    Names are cleaned and normalized; of locations with the same normalized name the last by position and name stays (or their counts are
    summed), candidates share the normalized name, and the best-scored ones are correct.
    """
    cols = locations.columns
    loc = locations.withColumn("name", F.trim("name")).where(text.hygienic(F.col("name"))).withColumn("name_normalized", text.normalize(F.col("name")))
    loc = loc.withColumn("count", F.coalesce("count", F.lit(1)) if "count" in cols else F.lit(1)).withColumn("context", F.col("context") if "context" in cols else F.lit(None).cast("string"))
    loc = loc.groupBy("order_id", "name_normalized").agg(F.max_by(F.struct("name", "count", "context"), F.struct("position", "name")).alias("_l"), F.sum("count").alias("_sum"))
    loc = loc.select("order_id", "name_normalized", "_l.name", (F.col("_sum") if sum_counts else F.col("_l.count")).cast("int").alias("cnt"), F.col("_l.context").alias("text"))
    #: A feature's id is a hash of what it is, so it needs no order and reruns agree.
    loc = loc.withColumn("feature_id", F.xxhash64("order_id", "name_normalized"))
    cand = loc.join(places.select(*[F.col(c) for c in places.columns if c not in ("name",)]), "name_normalized").withColumnRenamed("id", "place_id")
    cand = mark_correct(cand.withColumn("confidence", score(cand)), "feature_id", score="confidence")
    shape = F.when(F.col("mpoly").isNotNull(), "Shape").otherwise("Point") if "mpoly" in cand.columns else F.lit("Point")
    featureplace = cand.select("feature_id", "order_id", "place_id", F.col("confidence").cast("decimal(5,4)").alias("confidence"), "correct", F.lit(-1).alias("sort_order"))
    feature = cand.groupBy("feature_id").agg(F.max(F.when(F.col("correct"), shape)).alias("geometry_used"), F.first("order_id").alias("order_id"), F.first("name").alias("name"), F.first("cnt").alias("cnt"), F.first("text").alias("text")).withColumn("verified", F.lit(False))
    return feature, featureplace


def possible_additions(target: str, order_id: int, ranks: DataFrame, places: DataFrame, aliases: DataFrame, wikipedia: DataFrame, score: Callable[[DataFrame], Column] = default_score) -> DataFrame:
    """Candidate places of a name, most probable first."""
    found = typed(candidates(target, order_id, ranks, places, aliases, wikipedia, thorough=True)).withColumn("admin_level", F.col("admin_level").cast("int"))
    return found.withColumn("score", score(found)).orderBy(F.desc("score"), "place_id")
