"""Distances, containment, conflation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spatial as S
from ..operators import clusters, cover
from ..operators import gazetteer as G
from .registry import query

#: The fixture's points are sparse, so its bands are wider.
WIDE = ((1, 10000), (10, 1000), (100_000, 100), (500_000, 10), (1_000_000, 1))


def _vincenty() -> str:
    """SQL of the metres along the spheroid between {a} and {b}, which have lat and lon; null beyond 1,900 km, where the iteration is not used."""
    f = "(1 / 298.257223563::DOUBLE)"
    minor = f"(6378137.0::DOUBLE * (1 - {f}))"
    haversine = "2 * 6371008.8::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    reduced = lambda end: f"atan((1 - {f}) * tan(radians({end}.lat)))"
    ends = f"struct_pack(u := {reduced('{a}')}, v := {reduced('{b}')}, l := radians(mod(({{b}}.lon - {{a}}.lon + 540)::DOUBLE, 360::DOUBLE) - 180))"
    #: Of a difference of longitudes t on the auxiliary sphere: the arc's cosine and sine, the azimuth's sine and squared cosine, the cosine of twice the middle.
    cosine = "(sin(p.u) * sin(p.v) + cos(p.u) * cos(p.v) * cos(t))"
    sine = "sqrt(pow(cos(p.v) * sin(t), 2) + pow(cos(p.u) * sin(p.v) - sin(p.u) * cos(p.v) * cos(t), 2))"
    azimuth = f"(CASE WHEN {sine} = 0 THEN 0 ELSE cos(p.u) * cos(p.v) * sin(t) / {sine} END)"
    let = lambda names, then: f"list_transform([struct_pack({names})], lambda q: {then})[1]"
    arc = f"cs := {cosine}, ss := {sine}, sa := {azimuth}"
    square = "(1 - q.sa * q.sa)"
    middle = f"(CASE WHEN {square} < 1e-14 THEN 0 ELSE q.cs - 2 * sin(p.u) * sin(p.v) / {square} END)"
    c = f"({f} / 16 * {square} * (4 + {f} * (4 - 3 * {square})))"
    following = let(arc, f"p.l + (1 - {c}) * {f} * q.sa * (atan2(q.ss, q.cs) + {c} * q.ss * ({middle} + {c} * q.cs * (2 * pow({middle}, 2) - 1)))")
    turn = f"list_reduce([0::DOUBLE, 0, 0, 0, 0, 0, 0], lambda t, i: {following}, p.l)"
    u = f"({square} * (pow(6378137.0::DOUBLE, 2) - pow({minor}, 2)) / pow({minor}, 2))"
    big, small = f"(1 + {u} / 16384 * (4096 + {u} * (-768 + {u} * (320 - 175 * {u}))))", f"({u} / 1024 * (256 + {u} * (-128 + {u} * (74 - 47 * {u}))))"
    less = f"{small} * q.ss * ({middle} + {small} / 4 * (q.cs * (2 * pow({middle}, 2) - 1) - {small} / 6 * {middle} * (4 * q.ss * q.ss - 3) * (4 * pow({middle}, 2) - 3)))"
    length = let(arc, f"{minor} * {big} * (atan2(q.ss, q.cs) - {less})")
    metres = f"list_transform([{ends}], lambda p: list_transform([{turn}], lambda t: {length})[1])[1]"
    return f"(CASE WHEN {haversine} < 1900000 THEN {metres} END)"


METRES = _vincenty()
SCORE = "CAST({m} <= 1 AS INT) * 10000 + CAST({m} <= 10 AS INT) * 1000 + CAST({m} <= 100000 AS INT) * 100 + CAST({m} <= 500000 AS INT) * 10 + CAST({m} <= 1000000 AS INT)"


@query("g02_distance", "v_place", sql=f"SELECT a.id AS a, b.id AS b, CAST(round({METRES.format(a='a', b='b')} * 100) AS BIGINT) AS centimetres FROM v_place a JOIN v_place b ON a.name = b.name AND a.id < b.id WHERE {METRES.format(a='a', b='b')} <= 1000000")
def near(place):
    """Metres along the spheroid between places of a name that are within 1,000 km of each other."""
    pairs = G.candidates_nearby(place.select(F.col("id").alias("input_id"), "name", "lat", "lon", "population"), place, 1_000_000).where("input_id < place_id")
    return pairs.select(F.col("input_id").alias("a"), F.col("place_id").alias("b"), F.round(F.col("metres") * 100).cast("long").alias("centimetres"))


@query("g03_point_in_box", "v_place", "v_country", sql="SELECT p.id, c.id AS pid FROM v_place p JOIN v_country c ON lon > west AND lon < east AND lat > south AND lat < north")
def point_in_box(place, country):
    """G03, J09."""
    return G.inside(place.select("id", "lon", "lat"), country.withColumnRenamed("id", "pid")).select("id", "pid")


@query("g03_point_in_polygon", "v_place", "v_country", sql="SELECT p.id, c.id AS pid FROM v_place p JOIN v_country c ON lon > west AND lon < east AND lat > south AND lat < north")
def point_in_polygon(place, country):
    """The same boxes as rings of vertices, by ray casting."""
    shaped = country.withColumnRenamed("id", "pid").withColumn("mpoly", S.box_polygon(F.col("west"), F.col("east"), F.col("south"), F.col("north")))
    return G.inside(place.select("id", "lon", "lat"), shaped).select("id", "pid")


@query("g03_point_on_grid", "v_place", "v_country", sql="SELECT p.id, c.id AS pid FROM v_place p JOIN v_country c ON lon > west AND lon < east AND lat > south AND lat < north")
def point_on_grid(place, country):
    """The form for many polygons: points and covers meet by cell, by a shuffle."""
    return cover.inside(place.select("id", "lon", "lat"), country.withColumnRenamed("id", "pid"), broadcast=0).select("id", "pid")


def _ragged(corners: list[tuple[float, float]], cuts: int, depth: float) -> list[tuple[float, float]]:
    """A closed ring through corners with its edges cut into pieces, every other end moved aside."""
    out = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        for i in range(cuts):
            off = depth if i % 2 else 0.0
            out.append((round(ax + (bx - ax) * i / cuts - (by - ay) * off, 6), round(ay + (by - ay) * i / cuts + (bx - ax) * off, 6)))
    return [*out, out[0]]


#: Within a box of one by one: land with a lake in it, an island in the lake, and an islet outside.
LAND = [
    [_ragged([(0.08, 0.1), (0.3, 0.04), (0.5, 0.22), (0.7, 0.05), (0.88, 0.15), (0.82, 0.5), (0.9, 0.88), (0.6, 0.8), (0.4, 0.94), (0.12, 0.85), (0.2, 0.5)], 9, 0.06), _ragged([(0.4, 0.4), (0.45, 0.62), (0.6, 0.66), (0.64, 0.36)], 6, 0.05)],
    [_ragged([(0.48, 0.48), (0.56, 0.47), (0.52, 0.56)], 4, 0.04)],
    [[(0.01, 0.01), (0.04, 0.01), (0.04, 0.05), (0.01, 0.05), (0.01, 0.01)]],
]
_SIDES = ", ".join(f"({ax}, {ay}, {bx}, {by})" for polygon in LAND for ring in polygon for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False))
#: Every edge of every land against every point.
LAND_SQL = f"""sides(px, py, qx, qy) AS (SELECT CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE), CAST(d AS DOUBLE) FROM (VALUES {_SIDES}) t(a, b, c, d)),
 shores AS (SELECT id AS pid, country_code AS cc, west + px * (east - west) AS px, south + py * (north - south) AS py, west + qx * (east - west) AS qx, south + qy * (north - south) AS qy FROM v_country, sides),
 held AS (SELECT p.id, pid, cc FROM v_place p JOIN shores ON (py > lat) <> (qy > lat) AND lon < (qx - px) / (qy - py) * (lat - py) + px GROUP BY p.id, pid, cc HAVING count(*) % 2 = 1)"""


def lands(country):
    """Countries as land of many edges, with a lake and islands."""
    point = lambda x, y: F.struct((F.col("west") + F.lit(x) * (F.col("east") - F.col("west"))).alias("x"), (F.col("south") + F.lit(y) * (F.col("north") - F.col("south"))).alias("y"))
    shape = F.array(*[F.array(*[F.array(*[point(x, y) for x, y in ring]) for ring in polygon]) for polygon in LAND])
    return country.select(F.col("id").alias("pid"), F.col("country_code").alias("cc"), shape.alias("mpoly"))


@query("g03_rings", "v_place", "v_country", sql=f"WITH {LAND_SQL} SELECT id, pid FROM held")
def rings(place, country):
    """Points in shapes of many edges, with holes and islands in them, by the adaptive cover."""
    return cover.inside(place.select("id", "lon", "lat"), lands(country)).select("id", "pid")


@query("g03_rings_by_cell", "v_place", "v_country", sql=f"WITH {LAND_SQL} SELECT id, pid FROM held")
def rings_by_cell(place, country):
    """The same by a shuffle, as covers that are too large for a broadcast are met."""
    return cover.inside(place.select("id", "lon", "lat"), lands(country), broadcast=0).select("id", "pid")


@query("j10_land_of_place", "v_place", "v_country", sql=f"WITH {LAND_SQL} SELECT p.id, min_by(pid, cc) AS pid FROM v_place p LEFT JOIN held ON p.id = held.id GROUP BY p.id")
def land_of_place(place, country):
    """Of the lands that hold a place the first by name; places at sea or in a lake have none."""
    found = cover.inside(place.select("id", "lon", "lat"), lands(country)).groupBy("id").agg(F.min_by("pid", "cc").alias("pid"))
    return place.select("id").join(found, "id", "left")


@query("g05_centroid", "v_country", sql="SELECT id, (west + east) / 2 AS x, (south + north) / 2 AS y, (east - west) * (north - south) AS area FROM v_country")
def centroid(country):
    """G05, G06."""
    ring = F.get(F.get(S.box_polygon(F.col("west"), F.col("east"), F.col("south"), F.col("north")), 0), 0)
    rows = country.select("id", S.centroid(ring).alias("c"), S.area(ring).alias("area"))
    return rows.select("id", F.round("c.x", 9).alias("x"), F.round("c.y", 9).alias("y"), F.round("area", 9).alias("area"))


@query("j10_country_of_place", "v_place", "v_country", sql="SELECT p.id, min_by(c.id, c.country_code) AS pid FROM v_place p JOIN v_country c ON lon > west AND lon < east AND lat > south AND lat < north GROUP BY p.id")
def country_of_place(place, country):
    found = G.inside(place.select("id", "lon", "lat"), country.select(F.col("id").alias("pid"), F.col("country_code").alias("cc"), "west", "east", "south", "north"))
    return found.groupBy("id").agg(F.min_by("pid", "cc").alias("pid"))


@query("d05_fill_countries", "v_place", "v_country", sql="SELECT p.id, CASE WHEN p.id % 3 = 0 THEN c.country_code ELSE p.country_code END AS country_code FROM v_place p LEFT JOIN v_country c ON lon > west AND lon < east AND lat > south AND lat < north")
def fill_countries(place, country):
    holed = place.withColumn("country_code", F.when(F.col("id") % 3 != 0, F.col("country_code")))
    return G.fill_countries(holed, country).select("id", "country_code")


def inputs(place):
    """Rows to conflate: the first place of each name and kind, moved north by 5.6 or 56 km."""
    rows = place.groupBy("name", "feature_code").agg(F.min_by(F.struct("id", "lat", "lon", "country_code", "population", "importance"), "id").alias("f")).select("name", "f.*")
    return rows.select(F.col("id").alias("input_id"), "name", (F.col("lat") + F.when(F.col("id") % 2 == 0, 0.05).otherwise(0.5)).alias("lat"), "lon", "country_code", "population", "importance")


_IN = "WITH i AS (SELECT id AS input_id, name, lat + CASE WHEN id % 2 = 0 THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END AS lat, lon, country_code, population, importance FROM v_place WHERE id IN (SELECT min(id) FROM v_place GROUP BY name, feature_code)), m AS (SELECT input_id, p.id, i.population AS pop, p.population, p.admin_level, " + METRES.format(a="i", b="p") + " AS m FROM i JOIN v_place p ON i.name = p.name)"


@query("d01_best_place", "v_place", sql=f"""{_IN}, s AS (SELECT input_id, id, {SCORE.format(m='m')} + CAST(pop IS NOT NULL AS INT) * 10 + CASE WHEN pop IS NOT NULL AND population > 0 AND CAST(abs(pop - population) AS DOUBLE) / greatest(pop, population) < 0.05 THEN 1000 ELSE 0 END AS score FROM m WHERE m <= 1000000)
 SELECT input_id, place_id, CAST(score AS INT) AS score FROM (SELECT input_id, id AS place_id, score, row_number() OVER (PARTITION BY input_id ORDER BY score DESC, id) AS r FROM s) WHERE r = 1""")
def best_place(place):
    """Bands of distance, population, lowest id among equals."""
    return G.best(G.candidates_nearby(inputs(place), place, 1_000_000, WIDE, exact=False), "input_id").select("input_id", "place_id", "score")


@query("d02_osm_place", "v_place", sql=f"""{_IN}, s AS (SELECT input_id, id, {SCORE.format(m='m')} + CAST(population IS NOT NULL AS INT) * 10 + CAST(admin_level IS NOT NULL AS INT) * 10 AS score FROM m WHERE m <= 1000000)
 SELECT input_id, place_id, CAST(score AS INT) AS score FROM (SELECT input_id, id AS place_id, score, row_number() OVER (PARTITION BY input_id ORDER BY score DESC, id) AS r FROM s) WHERE r = 1""")
def osm_place(place):
    return G.best(G.candidates_nearby(inputs(place), place, 1_000_000, WIDE, variant="osm", exact=False), "input_id").select("input_id", "place_id", "score")


BANDS_SQL = "CAST(m <= 1 AS INT) * 10000 + CAST(m <= 10 AS INT) * 1000 + CAST(m <= 100 AS INT) * 100 + CAST(m <= 1000 AS INT) * 10 + CAST(m <= 10000 AS INT)"
BEST_SQL = "b AS (SELECT input_id, id AS place_id, pop FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY score DESC, id) AS r FROM s) WHERE r = 1)"


#: Clusters of lost inputs: whatever is reached from one by pairs within 10 km.
NEAR_SQL = f"near AS MATERIALIZED (SELECT x.input_id AS a, y.input_id AS b FROM lost x JOIN lost y ON x.name = y.name AND abs(x.lat - y.lat) < 0.1 WHERE {METRES.format(a='x', b='y')} <= 10000), reach AS (SELECT input_id AS a, input_id AS b FROM lost UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a), found AS (SELECT a AS input_id, min(b) AS cluster FROM reach GROUP BY a)"


@query("d01_conflate", "v_place", sql=f"""{_IN.replace("WITH", "WITH RECURSIVE", 1)}, s AS (SELECT input_id, id, pop, {BANDS_SQL} + CAST(pop IS NOT NULL AS INT) * 10 + CASE WHEN pop IS NOT NULL AND population > 0 AND CAST(abs(pop - population) AS DOUBLE) / greatest(pop, population) < 0.05 THEN 1000 ELSE 0 END AS score FROM m WHERE m <= 10000),
 {BEST_SQL}, fill AS (SELECT place_id, min_by(pop, input_id) FILTER (WHERE pop IS NOT NULL) AS pop FROM b GROUP BY 1), lost AS (SELECT * FROM i WHERE input_id NOT IN (SELECT input_id FROM b)), {NEAR_SQL},
 n AS (SELECT min_by(name, input_id) AS name, min_by(lat, input_id) AS lat, min_by(lon, input_id) AS lon, min_by(country_code, input_id) FILTER (WHERE country_code IS NOT NULL) AS country_code, min_by(population, input_id) FILTER (WHERE population IS NOT NULL) AS population, cluster FROM lost JOIN found USING (input_id) GROUP BY cluster)
 SELECT p.id, p.name, p.lat, p.lon, p.country_code, coalesce(p.population, f.pop) AS population FROM v_place p LEFT JOIN fill f ON p.id = f.place_id
 UNION ALL SELECT (SELECT max(id) FROM v_place) + cluster, name, lat, lon, country_code, population FROM n""")
def conflate(place):
    """The table after the inputs went in: those with a neighbour fill its gaps, others are new places."""
    return G.conflate(inputs(place), place).select("id", "name", "lat", "lon", "country_code", "population")


#: Rows of a chain of up to nine steps of 7.8 km to the north of each place, from where cells of a tenth of a degree end, and the same a little aside.
_CHAINS = """lost AS (SELECT id * 100 + k * 2 + side AS input_id, name, floor(lat * 10) / 10 + 0.0999999::DOUBLE + 0.07::DOUBLE * k AS lat, lon + 0.0000002::DOUBLE * side AS lon FROM v_place, (SELECT unnest(range(9)) AS k), (SELECT unnest(range(2)) AS side) WHERE k <= id % 9)"""


@query("d01_clusters", "v_place", sql=f"WITH RECURSIVE {_CHAINS}, {NEAR_SQL} SELECT input_id, cluster FROM found")
def chains(place):
    """Inputs astride the edges of cells, and chains of them whose ends are far apart, are one place each."""
    rows = place.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 9))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    lat = F.floor(F.col("lat") * 10) / 10 + 0.0999999 + F.lit(0.07) * F.col("k")
    return clusters.clusters(rows.select((F.col("id") * 100 + F.col("k") * 2 + F.col("side")).alias("input_id"), "name", lat.alias("lat"), (F.col("lon") + F.lit(0.0000002) * F.col("side")).alias("lon")))


@query("d03_osm_importance", "v_place", "v_wikipedia", sql=f"""{_IN.replace("WITH", "WITH RECURSIVE", 1)}, s AS (SELECT input_id, id, pop, {BANDS_SQL} + CAST(population IS NOT NULL AS INT) * 10 + CAST(admin_level IS NOT NULL AS INT) * 10 AS score FROM m WHERE m <= 10000),
 {BEST_SQL}, lost AS (SELECT * FROM i WHERE input_id NOT IN (SELECT input_id FROM b)), {NEAR_SQL}, o AS (SELECT coalesce(place_id, -cluster) AS place_id, max_by(importance, input_id) AS importance FROM i LEFT JOIN b USING (input_id) LEFT JOIN found USING (input_id) GROUP BY 1) SELECT place_id, charcount, importance FROM v_wikipedia FULL JOIN o USING (place_id)""")
def osm_importance(place, wikipedia):
    return G.load_osm_importance(inputs(place), place, wikipedia.withColumn("importance", F.lit(None).cast("double")))


@query("d04_aliases", "v_alias", "v_place", sql="""WITH o AS (SELECT alias, min(place_id) AS id FROM v_alias GROUP BY 1), n AS (SELECT id + (SELECT max(id) FROM o) AS id, alias || '!' AS alias FROM o)
 SELECT id AS alias_id, alias, NULL AS place_id FROM o UNION ALL SELECT id, alias, NULL FROM n UNION ALL SELECT DISTINCT n.id, NULL, place_id FROM v_alias v JOIN n ON n.alias = v.alias || '!'""")
def aliases(alias, place):
    """Alternate names, each row twice: new aliases once, links once, an empty start for links."""
    rows = alias.select(F.col("place_id").alias("line"), F.col("place_id").alias("geonameid"), F.concat("alias", F.lit("!")).alias("alternate_name"), F.lit("en").alias("language"))
    old = alias.groupBy("alias").agg(F.min("place_id").alias("id")).select("id", "alias", F.lit("en").alias("language"))
    none = alias.sparkSession.createDataFrame([], "alias_id long, place_id long")
    a, links = G.load_aliases(rows.unionByName(rows), old, none, place.withColumn("geonames_id", F.col("id")))
    return a.select(F.col("id").alias("alias_id"), "alias", F.lit(None).cast("long").alias("place_id")).unionByName(links.select("alias_id", F.lit(None).cast("string").alias("alias"), "place_id"))


@query("d06_update_popularity", "v_place", "v_featureplace", "v_feature", sql="WITH n AS (SELECT place_id, count(*) FILTER (WHERE correct) - count(*) FILTER (WHERE NOT correct) AS v FROM v_featureplace fp JOIN v_feature f ON fp.feature_id = f.id WHERE verified GROUP BY 1) SELECT id, CAST(coalesce(v, -1000) AS BIGINT) AS popularity FROM v_place LEFT JOIN n ON id = place_id")
def update_popularity(place, featureplace, feature):
    from ..operators import analytics as A

    return A.update_popularity(place.withColumn("popularity", F.lit(-1000).cast("long")), featureplace, feature).select("id", "popularity")


@query("d06_update_popularity_of_order", "v_place", "v_featureplace", "v_feature", sql="""WITH n AS (SELECT place_id, count(*) FILTER (WHERE correct) - count(*) FILTER (WHERE NOT correct) AS v FROM v_featureplace fp JOIN v_feature f ON fp.feature_id = f.id WHERE verified GROUP BY 1),
 o AS (SELECT DISTINCT place_id FROM v_featureplace fp JOIN v_feature f ON fp.feature_id = f.id WHERE verified AND order_id = 7) SELECT id, CAST(v AS BIGINT) AS popularity FROM v_place LEFT JOIN (SELECT * FROM n JOIN o USING (place_id)) ON id = place_id""")
def update_popularity_of_order(place, featureplace, feature):
    from ..operators import analytics as A

    return A.update_popularity(place, featureplace, feature, order_id=7).select("id", "popularity")


@query("d09_verify", "v_feature", sql="SELECT id, verified OR order_id = 7 AS verified FROM v_feature")
def verify(feature):
    from ..plans import request

    return request.verify(feature, 7).select("id", "verified")


@query("d10_set_correct", "v_featureplace", sql="SELECT id, CASE WHEN place_id = 5 THEN true ELSE correct END AS correct FROM v_featureplace")
def set_correct(featureplace):
    from ..plans import request

    changes = featureplace.where("place_id = 5").select("id", F.lit(True).alias("correct")).distinct()
    return request.set_correct(featureplace, changes).select("id", "correct")


@query("d11_get_or_create", "v_alias", sql="SELECT alias, NULL AS made FROM (SELECT DISTINCT alias FROM v_alias) UNION ALL SELECT DISTINCT upper(left(alias, 5)), true FROM v_alias WHERE upper(left(alias, 5)) NOT IN (SELECT alias FROM v_alias)")
def get_or_create(alias):
    """What is there stays, and of what is asked for the rest is made."""
    old = alias.select("alias").distinct()
    wanted = old.unionByName(alias.select(F.upper(F.left("alias", F.lit(5))).alias("alias"))).withColumn("made", F.lit(True))
    return G.get_or_create(old, wanted, "alias").select("alias", "made")


@query("d12_changed_fields", "v_place", sql="SELECT id, 'population' AS field FROM v_place WHERE population IS NULL")
def changed_fields(place):
    old = place.select("id", "population", "name")
    return G.changed_fields(old, old.fillna({"population": 1}), "id")


@query("j17_match_places", "v_place", sql=f"""WITH i AS (SELECT id AS input_id, name, country_code, lat + CASE id % 3 WHEN 1 THEN 0.00002::DOUBLE WHEN 2 THEN 0.01::DOUBLE ELSE 0 END AS lat, lon, admin_level FROM v_place),
 m AS (SELECT input_id, p.id, CASE WHEN i.lat = p.lat AND i.lon = p.lon THEN 1 WHEN {METRES.format(a='i', b='p')} < 5 THEN 3 END AS r, {METRES.format(a='i', b='p')} AS d, coalesce(CAST(coalesce(i.admin_level, 3) = p.admin_level AS INT), 0) AS same FROM i JOIN v_place p ON i.name = p.name AND i.country_code = p.country_code)
 SELECT input_id, id AS place_id, r AS match_rank FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY r, same DESC, d, id) AS nth FROM m WHERE r IS NOT NULL) WHERE nth = 1""")
def match_places(place):
    """Rows at a place's point, two metres off, and a kilometre off, which match nothing."""
    north = F.when(F.col("id") % 3 == 1, 0.00002).when(F.col("id") % 3 == 2, 0.01).otherwise(0.0)
    return G.match_places(place.select(F.col("id").alias("input_id"), "name", "country_code", (F.col("lat") + north).alias("lat"), "lon", "admin_level"), place)


@query("j17_match_in_polygons", "v_place", sql=f"""WITH i AS (SELECT id AS input_id, name, country_code, lat + 0.05::DOUBLE AS lat, lon, admin_level, lon - 30 AS w, lon + 20 AS e, lat - 25 AS s, lat + 15 AS n FROM v_place),
 m AS (SELECT input_id, p.id, coalesce(CAST(coalesce(i.admin_level, 3) = p.admin_level AS INT), 0) AS same, pow(i.lat - p.lat, 2) + pow(i.lon - p.lon, 2) AS d FROM i JOIN v_place p ON i.name = p.name AND i.country_code = p.country_code WHERE p.lon > w AND p.lon < e AND p.lat > s AND p.lat < n)
 SELECT input_id, max(same) AS same, 2 AS match_rank FROM m GROUP BY input_id""")
def match_in_polygons(place):
    """Rows whose polygon holds places of their name and country: the rank, and whether one of the row's level was taken where there is one."""
    shape = S.box_polygon(F.col("lon") - 30, F.col("lon") + 20, F.col("lat") - 25, F.col("lat") + 15)
    rows = place.select(F.col("id").alias("input_id"), "name", "country_code", (F.col("lat") + 0.05).alias("lat"), "lon", "admin_level", shape.alias("mpoly"))
    found = G.match_places(rows, place).join(rows.select("input_id", F.col("admin_level").alias("wanted")), "input_id")
    same = F.coalesce((F.coalesce("wanted", F.lit(3)) == F.col("admin_level")).cast("int"), F.lit(0))
    return found.join(place.select(F.col("id").alias("place_id"), "admin_level"), "place_id").select("input_id", same.alias("same"), "match_rank")


@query("j18_match_countries", "v_country", sql="SELECT id AS input_id, id AS place_id FROM v_country")
def match_countries(country):
    known = country.select("id", F.col("country_code").alias("name"), "country_code", F.lit(0).alias("admin_level"))
    wanted = country.select(F.col("id").alias("input_id"), F.col("country_code").alias("name"), "country_code")
    return G.match_countries(wanted, known)
