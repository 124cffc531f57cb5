"""The gazetteer: conflation, aliases, countries of places, matching of datasets, hierarchy.

Updates are new versions of tables. Where rows could be updated in turn, a batch is resolved against the table as it was;
inputs that match nothing and lie near each other, directly or by way of others, are put together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesic, spatial
from ..session import kept
from .clusters import clusters
from .cover import BROADCAST_CELLS, cover, inside, met

#: Metres within which a place is the same point for a dataset's row.
SAME_POINT = 5
#: Cubes in which such points meet are so many times as wide: nearly all points lie in one of them alone, whereas of cubes of 10 m each touches eight.
SPACIOUS = 20
#: Pairs that a task puts in order, before those too far are left out, and how many such tasks there may be.
PAIRS, MOST_TASKS = 16_000_000, 20_000
#: What is farther on the sphere by this factor is farther along the spheroid, from which the sphere differs by 0.6 % at most.
DOUBT = 1.02


def population_is_close(a: Column, b: Column) -> Column:
    """Within 5 %; false unless both are there and b is above 0."""
    close = F.abs(a - b).cast("decimal(20,0)") / F.nullif(F.greatest(a, b).cast("decimal(20,0)"), F.lit(0)) < 0.05
    return F.coalesce(F.when(a.isNotNull() & (b > 0), close), F.lit(False))


def candidates_nearby(inputs: DataFrame, places: DataFrame, radius: float = 10_000, bands=spatial.BANDS, variant: str = "conflate", exact: bool = True, few: bool = False) -> DataFrame:
    """Same-name places within the radius of each input (input_id, name, lat, lon, population), scored.

    The join is by name and cube of space, so a name that many places bear makes pairs only where they are near; distance is computed for those.
    exact: metres are along the spheroid; else only where the radius and the bands can't be told without. few: the inputs are a handful of rows, which are broadcast.
    Places are never broadcast: a table that is small as a file isn't small in memory.
    """
    p = places.select(spatial.cube(F.col("lat"), F.col("lon"), radius).alias("_cube"), F.col("id").alias("place_id"), F.col("name").alias("_name"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("population").alias("_population"), F.col("admin_level").alias("_level"))
    near = inputs.withColumn("_near", F.explode(spatial.cubes_near(F.col("lat"), F.col("lon"), radius)))
    between = lambda metres: metres(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    near, p = (F.broadcast(near), p) if few else (near, p.hint("merge"))
    pairs = near.join(p, (F.col("name") == F.col("_name")) & (F.col("_near") == F.col("_cube"))).drop("_near", "_cube")
    pairs = pairs.where(between(spatial.sphere) <= radius * 1.01)
    limits = (radius, *(limit for limit, _ in bands))
    if max(limits) * 1.02 >= geodesic.NEAR:
        metres = between(geodesic.distance)
    else:
        metres = between(geodesic.short) if exact else between(lambda *ends: geodesic.telling(*ends, limits))
    #: Exploded, so that the filter doesn't move below and compute the distance twice.
    pairs = pairs.withColumn("metres", F.explode(F.array(metres))).where(F.col("metres") <= radius)
    score = spatial.band_score(F.col("metres"), bands)
    if variant == "conflate":
        score = score + F.col("population").isNotNull().cast("int") * 10 + population_is_close(F.col("population"), F.col("_population")).cast("int") * 1000
    else:
        score = score + F.col("_population").isNotNull().cast("int") * 10 + F.col("_level").isNotNull().cast("int") * 10
    return pairs.withColumn("score", score)


def ranked_nearby(inputs: DataFrame, places: DataFrame, radius: float, bands=spatial.BANDS) -> DataFrame:
    """(input_id, place_id, score, place): the same-name places within the radius (less than geodesic.NEAR) of each input in the order of the score of names of OSM, then of the id, numbered from 1.

    Places are sent to the cubes near them, and an input lies in one cube. So all pairs of an input are made in the task that puts them in
    order, and none is shuffled: what is sent grows with the places and not with the pairs. Cubes of many pairs are dealt over tasks by
    the input, with their places beside each; there are so many tasks that one sorts some PAIRS. Where ids of inputs repeat, pairs are shuffled by them.
    """
    point = lambda end, names: [a.alias(n) for a, n in zip(geodesic.axes(*end), names, strict=True)]
    ends = [F.col(c) for c in ("lat", "lon", "_lat", "_lon")]
    extra = F.col("population").isNotNull().cast("int") * 10 + F.col("admin_level").isNotNull().cast("int") * 10
    there = lambda df: df.where(F.col("name").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    mine = there(inputs).select("input_id", "name", "lat", "lon", spatial.cube(F.col("lat"), F.col("lon"), radius).alias("_cube"))
    theirs = there(places).select(F.col("id").alias("place_id"), "name", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), extra.cast("int").alias("_extra"), F.explode(spatial.cubes_near(F.col("lat"), F.col("lon"), radius)).alias("_cube"))
    sizes = mine.groupBy("name", "_cube").agg(F.count(F.lit(1)).alias("_a")).join(theirs.groupBy("name", "_cube").agg(F.count(F.lit(1)).alias("_b")), ["name", "_cube"])
    #: As doubles, since products of counts may be beyond a long. Halves of a task's pairs are dealt evenly enough.
    sizes = sizes.select("name", "_cube", F.ceil(F.col("_a").cast("double") * F.col("_b") / (PAIRS / 2)).cast("int").alias("_parts"), (F.col("_a").cast("double") * F.col("_b")).alias("_pairs"))
    sizes = kept(sizes, "pairs")
    known = sizes.agg(F.coalesce(F.sum("_pairs"), F.lit(0.0)).alias("pairs"), F.count_if(F.col("_parts") > 1).alias("hot")).first()
    tasks = max(int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, math.ceil(known.pairs / PAIRS)))
    hot = sizes.where("_parts > 1").select("name", "_cube", "_parts")
    hot = F.broadcast(hot) if known.hot <= BROADCAST_CELLS else hot.hint("merge")
    parted = lambda df: df.join(hot, ["name", "_cube"], "left") if known.hot else df.withColumn("_parts", F.lit(1))
    parts = F.coalesce("_parts", F.lit(1))
    mine, theirs = parted(mine), parted(theirs)
    at = F.xxhash64("name", "_cube", "_part").alias("_at")
    mine = mine.withColumn("_part", F.pmod(F.xxhash64("input_id"), parts).cast("int")).select(at, "_part", "input_id", "name", "_cube", *point(ends[:2], ("_x", "_y", "_z")), "lat", "lon")
    theirs = theirs.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).select(at.alias("_there"), F.col("_part").alias("_of"), "place_id", F.col("name").alias("_name"), F.col("_cube").alias("_near"), *point(ends[2:], ("_u", "_v", "_w")), "_lat", "_lon", "_extra")
    met = mine.repartition(tasks, "_at").join(theirs.repartition(tasks, "_there").hint("merge"), F.col("_at") == F.col("_there"))
    square = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in (("_y", "_v"), ("_z", "_w"))), (F.col("_x") - F.col("_u")) * (F.col("_x") - F.col("_u")))
    #: Different keys may have one hash. Said as a range, as equalities would become keys of the join, by which its pairs aren't dealt.
    same = F.col("name").between(F.col("_name"), F.col("_name")) & F.col("_cube").between(F.col("_near"), F.col("_near")) & F.col("_part").between(F.col("_of"), F.col("_of"))
    met = met.where((square <= geodesic.chords(radius)[1]) & same).withColumn("_square", square)
    limits = sorted({radius, *(limit for limit, _ in bands)})
    doubt = F.lit(False)
    for limit in limits:
        low, high = geodesic.chords(limit)
        doubt = doubt | F.col("_square").between(low, high)
    #: The exact distance is computed for those in doubt alone: a condition keeps Spark's own functions from being called.
    exact = F.when(doubt, geodesic.near(*ends))
    within = lambda limit: F.coalesce(F.col("_exact") <= limit, F.col("_square") < geodesic.chords(limit)[0])
    met = met.select("_at", "input_id", "place_id", "_extra", "_square", F.explode(F.array(exact)).alias("_exact")).where(within(radius))
    score = sum((within(limit).cast("int") * weight for limit, weight in bands), F.col("_extra"))
    scored = met.select("_at", "input_id", "place_id", score.cast("int").alias("score"))
    repeats = inputs.groupBy("input_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    order = Window.partitionBy("input_id", *([] if repeats else ["_at"])).orderBy(F.desc("score"), "place_id")
    return scored.withColumn("place", F.row_number().over(order).cast("long")).select("input_id", "place_id", "score", "place")


def best(scored: DataFrame, *by: str, score: str = "score", tie: str = "place_id") -> DataFrame:
    """The row with the largest score of each group, the smallest tie among equals. An aggregate, so hot groups are combined before the shuffle."""
    rest = [c for c in scored.columns if c not in by]
    top = scored.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie))).alias("_b"))
    return top.select(*by, *[F.col(f"_b.{c}").alias(c) for c in rest])


def conflate(inputs: DataFrame, places: DataFrame, radius: float = 10_000, bands=spatial.BANDS, few: bool = False) -> DataFrame:
    """places after the inputs went in: the best same-name place nearby gets its null population and country filled, others are new places.

    Of inputs that match nothing, those of a name that steps within the radius lead to from each other become one place: the first one's, its null population
    and country filled from the others.
    """
    found = best(candidates_nearby(inputs, places, radius, bands, exact=False, few=few), "input_id").select("input_id", "place_id", F.col("population").alias("_pop"), F.col("country_code").alias("_cc"))
    fill = found.groupBy("place_id").agg(F.min_by("_pop", F.when(F.col("_pop").isNotNull(), F.col("input_id"))).alias("_pop"), F.min_by("_cc", F.when(F.col("_cc").isNotNull(), F.col("input_id"))).alias("_cc"))
    updated = places.join(fill, F.col("id") == F.col("place_id"), "left").withColumn("population", F.coalesce("population", "_pop")).withColumn("country_code", F.coalesce("country_code", "_cc")).drop("place_id", "_pop", "_cc")
    new = inputs.join(found.select("input_id"), "input_id", "left_anti")
    new = new.join(clusters(new, radius).withColumnRenamed("input_id", "_of"), F.col("input_id") == F.col("_of"))
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("input_id"))).alias(f"_{c}")
    new = new.groupBy("cluster").agg(F.min_by(F.struct("name", "lat", "lon"), "input_id").alias("_n"), F.min("input_id").alias("_i"), known("country_code"), known("population"))
    last = places.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    #: Ids of new places follow the largest one by the number of the input.
    new = new.crossJoin(F.broadcast(last)).select((F.col("_last") + F.col("_i")).cast("long").alias("id"), "_n.name", "_n.lat", "_n.lon", F.col("_country_code").alias("country_code"), F.col("_population").alias("population"))
    return updated.unionByName(new, allowMissingColumns=True)


def load_osm_importance(names: DataFrame, places: DataFrame, wikipedia: DataFrame) -> DataFrame:
    """wikipedia with the importance of OSM names: place found by the OSM score, else an id for it and its like nearby (the first one's input id, negative)."""
    found = best(candidates_nearby(names, places, variant="osm", exact=False), "input_id").select("input_id", "place_id")
    lost = names.join(found, "input_id", "left_anti")
    owned = names.join(found, "input_id", "left").join(clusters(lost), "input_id", "left").groupBy(F.coalesce("place_id", -F.col("cluster")).alias("place_id")).agg(F.max_by("importance", "input_id").alias("_new"))
    return wikipedia.join(owned, "place_id", "full").select("place_id", "charcount", F.coalesce("_new", "importance").alias("importance"))


def load_aliases(rows: DataFrame, alias: DataFrame, alias_place: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """alias and alias_place with alternate names (line, geonameid, alternate_name, language): the first language wins, links are kept once."""
    first = rows.groupBy("alternate_name").agg(F.min_by("language", "line").alias("language"), F.min("line").alias("line"))
    new = first.join(alias.select(F.col("alias").alias("alternate_name")), "alternate_name", "left_anti")
    last = alias.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    new = new.crossJoin(F.broadcast(last)).select((F.col("_last") + F.col("line")).cast("long").alias("id"), F.col("alternate_name").alias("alias"), "language")
    aliases = alias.unionByName(new)
    known = rows.join(aliases.select(F.col("id").alias("alias_id"), "alias"), F.col("alternate_name") == F.col("alias"))
    known = known.join(places.select(F.col("geonames_id"), F.col("id").alias("place_id")), F.col("geonameid") == F.col("geonames_id")).select("alias_id", "place_id").distinct()
    return aliases, alias_place.unionByName(known.join(alias_place, ["alias_id", "place_id"], "left_anti"))


def fill_countries(places: DataFrame, countries: DataFrame) -> DataFrame:
    """places with null country codes filled from the country that holds them (the smallest polygon id of several)."""
    missing = places.where(F.col("country_code").isNull()).select("id", "lon", "lat")
    shapes = countries.select(F.col("id").alias("pid"), F.col("country_code").alias("_cc"), *[c for c in ("west", "east", "south", "north", "mpoly") if c in countries.columns])
    found = inside(missing, shapes).groupBy("id").agg(F.min_by("_cc", "pid").alias("_cc"))
    return places.join(found, "id", "left").withColumn("country_code", F.coalesce("country_code", "_cc")).drop("_cc")


def match_places(inputs: DataFrame, places: DataFrame) -> DataFrame:
    """(input_id, place_id, match_rank) of a dataset's rows: same name and country, then the same point, inside the polygon, or within 5 m.

    Within a rank the admin level counts (3 where the input has none), then distance, then id. Points meet by cubes of space, and in the
    cover of the polygons, so a name that a country bears many times makes pairs only where they count. Of places that differ by their
    id alone the smallest one stands for all, as no other can be taken; so a point that many of them share makes one pair with an input.
    """
    p = places.select(F.col("id").alias("place_id"), F.col("name").alias("_name"), F.col("country_code").alias("_cc"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("admin_level").alias("_level"))
    p = p.groupBy("_name", "_cc", "_lat", "_lon", "_level").agg(F.min("place_id").alias("place_id"))
    mine = inputs.select("input_id", "name", "country_code", "lat", "lon", "admin_level", *(["mpoly"] if "mpoly" in inputs.columns else []))
    plain = mine.drop("mpoly")
    ends = [F.col(c) for c in ("lat", "lon", "_lat", "_lon")]
    named = (F.col("name") == F.col("_name")) & (F.col("country_code") == F.col("_cc"))
    same = (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon"))
    spots = p.withColumn("_cube", spatial.cube(F.col("_lat"), F.col("_lon"), SAME_POINT, SPACIOUS))
    near = plain.withColumn("_near", F.explode(spatial.cubes_near(F.col("lat"), F.col("lon"), SAME_POINT, SPACIOUS))).join(spots.hint("merge"), named & (F.col("_near") == F.col("_cube")))
    near = near.drop("_near", "_cube").where(same | (geodesic.sphere(*ends) <= SAME_POINT * 1.01))
    #: Exploded, as above. Within five metres, not at five.
    near = near.withColumn("metres", F.explode(F.array(geodesic.short(*ends)))).where(same | (F.col("metres") < SAME_POINT))
    pairs = near.withColumn("match_rank", F.when(same, 1).otherwise(3))
    if "mpoly" in mine.columns:
        #: What lies on the edge of a polygon's box isn't within the polygon, though a ray from there may cross its border once.
        shapes = mine.where(F.col("mpoly").isNotNull()).withColumn("_box", spatial.box(F.col("mpoly"))).select("*", "_box.*").drop("_box")
        held = _nearest_held(p, kept(cover(shapes), "cover")).withColumn("match_rank", F.lit(2))
        held = held.withColumn("metres", F.when(geodesic.sphere(*ends) < 0.98 * geodesic.NEAR, geodesic.short(*ends)).otherwise(geodesic.sphere(*ends)))
        pairs = pairs.unionByName(held.select(pairs.columns))
    level = (F.coalesce("admin_level", F.lit(3)) == F.col("_level")).cast("int")
    order = F.struct("match_rank", -F.coalesce(level, F.lit(0)), F.coalesce("metres", F.lit(float("inf"))), "place_id")
    return pairs.groupBy("input_id").agg(F.min_by(F.struct("place_id", "match_rank"), order).alias("_m")).select("input_id", "_m.place_id", "_m.match_rank")


def _nearest_held(p: DataFrame, cells: DataFrame) -> DataFrame:
    """Places within the polygons of inputs of their name and country that may be the best ones: of the level that is taken, and, on the sphere, within what may be nearest.

    Places are met twice, so that neither all that a polygon holds are shuffled nor distances along the spheroid are computed for them.
    """
    on = {"_name": "name", "_cc": "country_code"}
    level = F.coalesce(F.coalesce("admin_level", F.lit(3)) == F.col("_level"), F.lit(False))
    metres = F.coalesce(geodesic.sphere(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")), F.lit(float("inf")))
    #: Doubles and no structs, as those are sorted before they are combined.
    held = met(p, cells, "_lon", "_lat", on).select("input_id", level.alias("_same"), metres.alias("_metres"))
    least = held.groupBy("input_id").agg(F.min(F.when(F.col("_same"), F.col("_metres"))).alias("_alike"), F.min("_metres").alias("_any"))
    least = least.select(F.col("input_id").alias("_of"), F.col("_alike").isNotNull().alias("_leveled"), (F.coalesce("_alike", "_any") * DOUBT + 1e-3).alias("_most"))
    bound = kept(cells.join(least, F.col("input_id").eqNullSafe(F.col("_of"))).drop("_of"), "bound")
    return met(p, bound, "_lon", "_lat", on, where=(level == F.col("_leveled")) & (metres <= F.col("_most")))


def match_countries(names: DataFrame, places: DataFrame) -> DataFrame:
    """(input_id, place_id): by country code, else the only place with that prefix and level 0, else the only one with that prefix. Where a step finds several, none is taken."""
    p = places.select(F.col("id").alias("place_id"), F.col("name").alias("_name"), F.col("country_code").alias("_cc"), F.col("admin_level").alias("_level"))
    by_code = names.join(p.where("_level = 0"), F.col("country_code") == F.col("_cc")).groupBy("input_id").agg(F.min("place_id").alias("code_id"), F.count(F.lit(1)).alias("nc"))
    #: Prefixes meet by their first four characters (short ones by the first) before they are compared in full.
    starts = F.col("_name").startswith(F.col("name"))
    near = names.where(F.length("name") >= 4).join(p, (F.substring("name", 1, 4) == F.substring("_name", 1, 4)) & starts)
    near = near.unionByName(names.where(F.length("name") < 4).join(p, (F.substring("name", 1, 1) == F.substring("_name", 1, 1)) & starts))
    only = near.groupBy("input_id").agg(F.count_if(F.col("_level") == 0).alias("n0"), F.min(F.when(F.col("_level") == 0, F.col("place_id"))).alias("id0"), F.count(F.lit(1)).alias("n"), F.min("place_id").alias("id"))
    joined = names.select("input_id").join(by_code, "input_id", "left").join(only, "input_id", "left")
    return joined.select("input_id", 
        F.when(F.col("nc") == 1, F.col("code_id")).when(F.coalesce("nc", F.lit(0)) > 1, None).when(F.col("n0") == 1, F.col("id0")).when(F.coalesce("n0", F.lit(0)) > 1, None).when(F.col("n") == 1, F.col("id")).alias("place_id"),
    )


def parents(places: DataFrame) -> DataFrame:
    """(parent_id, child_id): the first place whose pcode is the child's parent_pcode."""
    p = places.where(F.col("pcode").isNotNull()).groupBy(F.col("pcode").alias("_pcode")).agg(F.min("id").alias("parent_id"))
    return places.join(p, F.col("parent_pcode") == F.col("_pcode")).select("parent_id", F.col("id").alias("child_id"))


def get_or_create(existing: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """existing and what of wanted isn't there by its key; of equal new ones one."""
    return existing.unionByName(wanted.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def update_by_key(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """df with the non-null values of changes."""
    named = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    out = df.join(named, F.col(key) == F.col("_key"), "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in df.columns])


def changed_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, field) for each field whose value differs, nulls included."""
    cols = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    flags = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in cols]))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}")).select(F.col(f"o.{key}").alias(key), F.explode(flags).alias("field"))
