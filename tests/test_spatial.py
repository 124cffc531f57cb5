"""Distances on the spheroid, the cover of polygons, clusters and simplification, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placewright.functions import geodesic, simplify, spatial
from placewright.operators import clusters, cover, gazetteer
from placewright.queries import QUERIES
from placewright.queries.spatial import LAND

#: Points and published or computed lengths of the geodesic between them.
KNOWN = [
    (-37.951033417, 144.424867889, -37.652821139, 143.926495528, 54972.271), (0, 0, 0, 1, 111319.491), (0, 0, 1, 0, 110574.389), (40.6, -73.8, 51.6, -0.5, 5551759.400),
    (0, 0, 0.5, 179.5, 19936288.579), (0, 0, 0.5, 179.7, 19944127.421), (0, 0, 0, 180, 20003931.459), (90, 0, -90, 50, 20003931.459), (0, 0, 0, 179.5, 19980861.909), (10, 20, 10, 20, 0), (10, 179.9, 10, -179.9, 21928.0),
]
SHAPE = "pid long, mpoly array<array<array<struct<x:double,y:double>>>>"


def test_known_geodesics(spark):
    df = spark.createDataFrame([(i, *map(float, k)) for i, k in enumerate(KNOWN)] + [(99, None, 0.0, 0.0, 0.0, 0.0)], "i int, a double, b double, c double, d double, want double")
    ends = [F.col(c) for c in "abcd"]
    for r in df.select("i", "want", geodesic.distance(*ends).alias("m")).collect():
        assert r.m is None if r.i == 99 else abs(r.m - r.want) < (0.5 if r.i == 10 else 0.001)
    for r in df.where("want < 1900000").select("want", geodesic.short(*ends).alias("m"), geodesic.within(*ends, 54972.3).alias("near"), "i").collect():
        if r.i != 99:
            assert abs(r.m - r.want) < (0.5 if r.i == 10 else 0.001) and r.near == (r.want <= 54972.3)


def ring(rng, x, y, size, n):
    out = [(x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*out, out[0]]


def rows(polygons):
    return [(i, p and [[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings] for rings in p]) for i, p in polygons]


@pytest.mark.parametrize("most", [16, 3])
def test_cover_equals_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(cover, "MOST_EDGES", most)
    rng = random.Random(most)
    polygons = [(i, [[ring(rng, rng.uniform(-170, 170), rng.uniform(-80, 80), rng.choice([0.001, 1, 20, 60]), rng.choice([3, 8, 60, 500]))] for _ in range(rng.randint(1, 3))]) for i in range(25)]
    polygons += [(30, [[ring(rng, 0, 0, 50, 200), ring(rng, 0, 0, 10, 40)], [ring(rng, 0, 0, 2, 10)]]), (31, [[[(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]]]), (32, None), (33, []), (34, [[[]]]), (35, [[[(5, 5)]]]), (36, [[[(512, 512), (1536, 512), (1536, 2000), (512, 512)]]])]
    shapes = spark.createDataFrame(rows(polygons), SHAPE)
    dots = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(300)] + [(400 + i, x, y) for i, (x, y) in enumerate((float(a), float(b)) for a in (0, 5, 10, -8) for b in (0, 5, 10, 16))]
    dots += [(500 + i, p["x"], p["y"]) for i, p in enumerate(rows(polygons)[25][1][0][0][:40])] + [(600, 900.0, 800.0), (601, None, 1.0), (602, 1.0, None)]
    points = spark.createDataFrame(dots, "id long, lon double, lat double")
    want = sorted((r.id, r.pid) for r in points.crossJoin(shapes).where(spatial.contains(F.col("mpoly"), F.col("lon"), F.col("lat"))).select("id", "pid").collect())
    assert len(want) > 50
    assert sorted((r.id, r.pid) for r in cover.inside(points, shapes).collect()) == want
    monkeypatch.setattr(cover, "CELL_POINTS", 5)
    assert sorted((r.id, r.pid) for r in cover.inside(points, shapes, broadcast=0).collect()) == want
    cells = cover.cover(shapes).collect()
    assert any(c["_cell_whole"] for c in cells)
    if most == 16:  # cells of the last cut may hold more, where more edges meet
        assert max(len(c["_cell_ax"]) for c in cells) <= most
    assert cover.inside(points, shapes.limit(0)).count() == 0 and cover.inside(points.limit(0), shapes).count() == 0


def test_boxes_by_cell(spark):
    shapes = spark.createDataFrame([(i, (i % 6) * 60.0 - 180, (i % 6) * 60.0 - 121, (i // 6) * 30.0 - 90, (i // 6) * 30.0 - 61) for i in range(36)], "pid long, west double, east double, south double, north double")
    dots = spark.range(500).select("id", ((F.col("id") * 37) % 360 - 180 + 0.5).cast("double").alias("lon"), ((F.col("id") * 53) % 180 - 90 + 0.25).cast("double").alias("lat"))
    plain = sorted((r.id, r.pid) for r in dots.join(shapes, spatial.within_box(F.col("lon"), F.col("lat"), F.col("west"), F.col("east"), F.col("south"), F.col("north"))).collect())
    for few in (0, 10_000):
        assert sorted((r.id, r.pid) for r in cover.inside(dots, shapes, broadcast=few).collect()) == plain and plain


def brute_clusters(near, ids):
    low = {i: i for i in ids}
    while True:
        new = {i: min([low[i], *[low[j] for j in near[i]]]) for i in ids}
        if new == low:
            return low
        low = new


def test_neighbouring_cubes_meet_in_blocks(spark):
    """Every two cubes that may have near points meet once, over the edges of blocks and of octants too, and a cube is dealt to two or so blocks, not to its 62 neighbours."""
    side, maybe = clusters._chord(9_900) / math.sqrt(3), clusters._chord(10_100)
    rng = random.Random(5)
    dots = [(rng.uniform(-0.6, 0.6), rng.uniform(-0.6, 0.6)) for _ in range(500)] + [(89.9 + rng.random() / 10, rng.uniform(-180, 180)) for _ in range(60)]
    rows = {}
    for at, (lat, lon) in enumerate(dots):
        flat = math.cos(math.radians(lat)) * geodesic.MEAN
        where = (flat * math.cos(math.radians(lon)), flat * math.sin(math.radians(lon)), math.sin(math.radians(lat)) * geodesic.MEAN)
        rows.setdefault(tuple(math.floor(v / side) for v in where), (at, "x", lat, lon, [(lat, lon)]))
    gap = lambda a, b: side * math.sqrt(sum(max(abs(u - v) - 1, 0) ** 2 for u, v in zip(a, b, strict=True)))
    want = sorted((rows[a][0], rows[b][0]) for a in rows for b in rows if a < b and gap(a, b) <= maybe)
    nodes = spark.createDataFrame(list(rows.values()), "node long, name string, _lat double, _lon double, dots array<struct<lat: double, lon: double>>")
    assert sorted((r.a, r.b) for r in clusters._beside(nodes, side, maybe).collect()) == want and want
    wide = spark.range(40_000).selectExpr("struct(id % 200 - 100 AS c0, id div 200 - 100 AS c1, id % 37 - 18 AS c2) AS cube")
    assert clusters._reached(wide).count() < 2 * wide.count()


@pytest.mark.parametrize("pairs", [4096, 64])
def test_clusters_against_brute_force(spark, monkeypatch, pairs):
    """Chains over cells' edges, the poles and the date line, crowds in a cell, and names kept apart; with cubes cut down or compared point by point."""
    monkeypatch.setattr(clusters, "PAIRS", pairs)
    rng = random.Random(pairs)
    spots = [(rng.uniform(10, 10.6), rng.uniform(20, 20.6)) for _ in range(60)] + [(rng.uniform(89.8, 90), rng.uniform(-180, 180)) for _ in range(25)] + [(rng.uniform(-0.2, 0.2), rng.choice([-180, 180]) + rng.uniform(-0.2, 0.2)) for _ in range(40)]
    spots += [(50 + 0.08 * i, 7.0) for i in range(30)] + [(10.0999999, 5.0), (10.1000001, 5.0)] + [(30.0, 30.0)] * 5 + [(30.0 + rng.uniform(0, 0.04), 30.09 + rng.uniform(0, 0.04)) for _ in range(25)] + [(30.0 + rng.uniform(0, 0.04), 30.0 + rng.uniform(0, 0.04)) for _ in range(25)]
    data = [(i, rng.choice(["a", "a", "b"]) if i < 120 else "c", *p) for i, p in enumerate(spots)] + [(900, None, 1.0, 1.0), (901, None, 1.0, 1.0), (902, "c", None, 1.0)]
    df = spark.createDataFrame(data, "input_id long, name string, lat double, lon double")
    a, b = df.alias("a"), df.alias("b")
    joined = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.abs(F.col("a.lat") - F.col("b.lat")) < 0.2)).where(geodesic.distance(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 10_000)
    near = {i: [] for i, *_ in data}
    for r in joined.select(F.col("a.input_id").alias("i"), F.col("b.input_id").alias("j")).collect():
        near[r.i].append(r.j)
    want = brute_clusters(near, near)
    got = {r.input_id: r.cluster for r in clusters.clusters(df).collect()}
    assert got == want and len(set(want.values())) > 5
    assert clusters.clusters(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(500, i) for i in range(501, 540)] + [(7, 7), (3, 2), (3, 2)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    got = {r.member: r.cluster for r in clusters.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_clusters(near, near)


def test_inputs_across_a_cell_edge(spark):
    """Two inputs two centimetres apart are one place wherever they lie; gaps are filled from the second."""
    places = spark.createDataFrame([(1, "B", 0.0, 0.0, None, None, None)], "id long, name string, lat double, lon double, country_code string, population long, admin_level int")
    inputs = spark.createDataFrame([(1, "A", 10.0999999, 3.0, None, None), (2, "A", 10.1000001, 3.0, "X", 7), (3, "A", 10.3, 3.0, "Y", 8)], "input_id long, name string, lat double, lon double, country_code string, population long")
    out = {r.id: r for r in gazetteer.conflate(inputs, places).collect()}
    assert sorted(out) == [1, 2, 4] and (out[2].lat, out[2].country_code, out[2].population) == (10.0999999, "X", 7)


def crossings(rings):
    sides = [(r, i, ring[i], ring[i + 1]) for r, ring in enumerate(rings) for i in range(len(ring) - 1)]
    out = 0
    for n, (r, i, a, b) in enumerate(sides):
        for q, j, c, d in sides[n + 1 :]:
            out += simplify.meet(a, b, c, d)
    return out


def off(point, ring):
    def one(a, b):
        length = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = max(0.0, min(1.0, ((point[0] - a[0]) * (b[0] - a[0]) + (point[1] - a[1]) * (b[1] - a[1])) / length)) if length else 0.0
        return math.hypot(point[0] - a[0] - t * (b[0] - a[0]), point[1] - a[1] - t * (b[1] - a[1]))

    return min(one(a, b) for a, b in zip(ring, ring[1:], strict=False))


def test_simplify_keeps_rings_apart():
    flat = [(0, 0), (5, 0.001), (10, 0), (10, 10), (0, 10), (0, 0)]
    assert simplify.simplified([flat], 0.02) == [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]]
    tiny = [(0, 0), (0.001, 0), (0.001, 0.001), (0, 0)]
    assert simplify.simplified([tiny], 0.02) == [tiny]
    #: A lake that lies within a bay's spike, and a spike that reaches through a gap: a plain rule would cut them off.
    spiky = [(0, 0), (4.9, 0), (5, 3), (5.1, 0), (10, 0), (10, 10), (5.5, 10), (5, 4), (4.5, 10), (0, 10), (0, 0)]
    lake = [(4.97, 1.0), (5.0, 1.4), (5.03, 1.0), (4.97, 1.0)]
    inner = [(4.95, 5.0), (5.0, 4.3), (5.05, 5.0), (4.95, 5.0)]
    for tolerance in (0.1, 0.6, 3.5, 20):
        for rings in ([spiky], [spiky, lake], [spiky, inner], [spiky, lake, inner]):
            assert crossings(rings) == 0
            out = simplify.simplified(rings, tolerance)
            assert crossings(out) == 0 and all(r[0] == r[-1] and len(r) >= 4 for r in out)
            for hole, before in zip(out[1:], rings[1:], strict=True):
                assert simplify._within(hole[0], out[0]) == simplify._within(before[0], rings[0])
    rng = random.Random(9)
    for trial in range(25):
        coast = [(10 * math.cos(2 * math.pi * i / 150) * (1 + 0.2 * rng.random()), 10 * math.sin(2 * math.pi * i / 150) * (1 + 0.2 * rng.random())) for i in range(150)]
        rings = [[*coast, coast[0]], [(9.0, 0.0), (9.2, 0.3), (9.4, 0.0), (9.2, -0.3), (9.0, 0.0)]]
        if crossings(rings):
            continue
        out = simplify.simplified(rings, 0.5)
        assert crossings(out) == 0 and len(out[0]) < len(rings[0]), trial
        assert max(off(p, out[0]) for p in rings[0]) <= 0.5 + 1e-9


def test_simplify_lands():
    shape = [r for polygon in LAND for r in polygon]
    assert crossings(shape) == 0
    for tolerance in (0.005, 0.03, 0.2):
        assert crossings(simplify.simplified(shape, tolerance)) == 0


def _broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def _places(spark, n: int = 200):
    none = F.lit(None).cast("long")
    return spark.range(n).select("id", F.lit("n").alias("name"), F.lit("c").alias("country_code"), (F.col("id") % 50).cast("double").alias("lat"), (F.col("id") % 7).cast("double").alias("lon"), none.alias("population"), none.cast("int").alias("admin_level"))


def test_places_near_inputs_are_not_broadcast(spark):
    """Small in Parquet isn't small in memory; only inputs that are said to be few are sent to all."""
    places = _places(spark)
    inputs = places.withColumnRenamed("id", "input_id").drop("admin_level")
    assert _broadcasts(gazetteer.candidates_nearby(inputs, places, 1_000_000)) == 0
    assert _broadcasts(gazetteer.candidates_nearby(inputs.limit(1), places, few=True)) == 1


@pytest.mark.parametrize("name", ["t08_score_order", "g02_distance", "j17_match_places"])
def test_queries_of_near_places_send_none_of_them_to_all(spark, name):
    assert _broadcasts(QUERIES[name](spark, "/root/testdata/sf0.001")) == 0


def test_five_metres_are_told_over_batches(spark):
    """Not by a function of each row that Spark doesn't compile."""
    plan = QUERIES["g04_within_5m"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_five_metres_are_told_of_near_points_alone(spark):
    """What the sphere rules out is left out before points are sent to Python; about five metres the spheroid decides."""
    plan = QUERIES["g04_within_5m"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ASIN" in plan[plan.index("ArrowEvalPython") :]
    rows = [(i * 7 + k, float(lat), 4.9 + 0.02 * k) for i, lat in enumerate(range(-90, 91, 5)) for k in range(11)]
    df = spark.createDataFrame(rows, "i long, lat double, metres double").withColumn("other", F.col("lat") + F.when(F.col("lat") < 0, 1).otherwise(-1) * F.col("metres") / 111_132)
    ends = [F.col("lat"), F.lit(3.0), F.col("other"), F.lit(3.0)]
    told = df.select(geodesic.nearer(*ends, 5).alias("told"), (geodesic.distance(*ends) < 5).alias("exact")).collect()
    assert all(r.told == r.exact for r in told) and {r.told for r in told} == {True, False}


def test_bands_are_told_as_by_the_exact_distance(spark):
    """Points about each limit of a band, where the sphere is wrong."""
    rows = [(i, 40.0, 3.0, 40.0 + limit * (0.985 + 0.0003 * k) / 111_000 * (k % 2), 3.0 + limit * (0.985 + 0.0003 * k) / 85_000 * ((k + 1) % 2)) for i, (limit, k) in enumerate((x, k) for x in (1, 10_000, 500_000) for k in range(100))]
    ends = [F.col(c) for c in ("a", "b", "c", "d")]
    df = spark.createDataFrame([*rows, (-1, None, 3.0, 4.0, 5.0)], "i long, a double, b double, c double, d double")
    limits = (1, 10_000, 500_000)
    told = [(geodesic.telling(*ends, limits) <= x).alias(f"t{x}") for x in limits]
    exact = [(geodesic.distance(*ends) <= x).alias(f"e{x}") for x in limits]
    for r in df.select("i", *told, *exact).collect():
        assert all(r[f"t{x}"] == r[f"e{x}"] for x in limits), r


def test_places_match_in_one_join_by_points(spark):
    """Points that many places share, five metres either way, coordinates that are none: as by all pairs, in one join whose pairs don't grow with the places of a point."""
    nan = float("nan")
    spots = [(40.0, 3.0), (40.00004, 3.0), (40.00005, 3.0), (-90.0, 0.0), (-90.0, 90.0), (0.0, 180.0), (0.00001, -180.0), (nan, 3.0), (None, 3.0)]
    places = [(i * len(spots) + k, "n", "c", lat, lon, (None, 1, 2, 3)[i % 4]) for i in range(40) for k, (lat, lon) in enumerate(spots)]
    kinds = "name string, country_code string, lat double, lon double, admin_level int"
    p, rows = (spark.createDataFrame(places, f"{c} long, {kinds}") for c in ("id", "input_id"))
    found = gazetteer.match_places(rows, p)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "min(place_id" in plan[plan.index("SortMergeJoin") :]
    pairs = rows.join(p.toDF(*[f"_{c}" for c in p.columns]), F.expr("name = _name AND country_code = _country_code"))
    ends = [F.col(c) for c in ("lat", "lon", "_lat", "_lon")]
    pairs = pairs.withColumn("d", F.explode(F.array(geodesic.short(*ends)))).withColumn("r", F.expr("CASE WHEN lat = _lat AND lon = _lon THEN 1 WHEN d < 5 THEN 3 END")).where("r IS NOT NULL")
    best = pairs.groupBy("input_id").agg(F.expr("min_by(struct(_id, r), struct(r, -coalesce(cast(coalesce(admin_level, 3) = _admin_level AS int), 0), coalesce(d, double('inf')), _id)) AS m")).select("input_id", "m.*")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, best.collect())) and found.count() == 320


def test_places_on_the_border_of_a_polygon_are_not_matched(spark):
    """A box of which places lie on each side, at a corner and, one of them, within."""
    places = spark.createDataFrame([(i, "n", "c", y, x, None, 1) for i, (x, y) in enumerate([(0.0, 5.0), (10.0, 5.0), (5.0, 0.0), (5.0, 10.0), (0.0, 0.0), (5.0, 5.0)])], "id long, name string, country_code string, lat double, lon double, population long, admin_level int")
    rows = spark.createDataFrame([(1, "n", "c", 1.0, 1.0, 1)], "input_id long, name string, country_code string, lat double, lon double, admin_level int")
    box = lambda top: rows.withColumn("mpoly", spatial.box_polygon(F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(top)))
    assert [(r.place_id, r.match_rank) for r in gazetteer.match_places(box(10.0), places).collect()] == [(5, 2)]
    assert gazetteer.match_places(box(10.0), places.where("id < 5")).count() == 0


def test_polygons_of_few_edges_are_covered_without_python(spark):
    """Boxes of rows lie whole in their cells; other shapes of few edges, with gaps, holes and numbers that are none in them, hold what all their edges say. Those of many edges are dealt over tasks."""
    ring = lambda *points: [dict(zip("xy", p, strict=True)) for p in points]
    nan = float("nan")
    shapes = [
        [[ring((0.0, 0.0), (50.0, 0.0), (50.0, 40.0), (0.0, 40.0), (0.0, 0.0))]],
        [[ring((0.0, 0.0), (0.0, 40.0), (50.0, 40.0), (50.0, 0.0), (0.0, 0.0))]],
        [[ring((0.0, 0.0), (50.0, 40.0), (50.0, 0.0), (0.0, 40.0), (0.0, 0.0))]],
        [[ring((0.0, 0.0), (50.0, 5.0), (20.0, 40.0), (0.0, 0.0)), ring((10.0, 8.0), (22.0, 10.0), (19.0, 20.0), (10.0, 8.0))]],
        [[ring((0.0, 0.0), (nan, 0.0), (50.0, 40.0), (0.0, 40.0), (0.0, 0.0), (7.0, 39.0))]],
        [[ring((3.0, 3.0))], [ring((nan, 1.0), (2.0, nan))]],
    ]
    kind = "pid int, mpoly array<array<array<struct<x:double,y:double>>>>"
    closed = spark.createDataFrame(list(enumerate(shapes)), kind)
    points = spark.createDataFrame([(i, x * 1.25 - 3, y * 1.25 - 3) for i, (x, y) in enumerate((x, y) for x in range(45) for y in range(37))], "id int, lon double, lat double")
    boxed = closed.select("pid", "mpoly", F.lit(0.0).alias("west"), F.lit(50.0).alias("east"), F.lit(0.0).alias("south"), F.lit(40.0).alias("north"))
    narrow = closed.withColumns({c: F.lit(v) for c, v in (("west", 1.0), ("east", 30.5), ("south", -9.0), ("north", 38.0))})
    for polygons in (closed, boxed, narrow):
        within = spatial.within_box(*[F.col(c) for c in ("lon", "lat", "west", "east", "south", "north")]) if "west" in polygons.columns else F.lit(True)
        want = sorted((r.id, r.pid) for r in points.crossJoin(polygons).where(within & spatial.contains(F.col("mpoly"), F.col("lon"), F.col("lat"))).where("pid < 4").collect())
        for few in (0, 20_000):
            assert sorted((r.id, r.pid) for r in cover.inside(points, polygons, broadcast=few).where("pid < 4").collect()) == want and want
    cells = cover.cover(boxed).collect()
    assert {r.pid for r in cells if r._cell_whole} == {0, 1} and not any(r._cell_ax for r in cells if r._cell_whole) and 5 not in {r.pid for r in cells}
    null = spark.createDataFrame([(1, None, 0.0, 50.0, 0.0, 40.0), (2, None, 9.0, 4.0, 0.0, 40.0), (3, None, 0.0, None, 0.0, 40.0)], kind + ", west double, east double, south double, north double")
    assert {r.pid for r in cover.inside(points, null).collect()} == {1}
    many = spark.range(0, 40, 1, 1).select("id", spatial.box_polygon(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("mpoly")).withColumn("mpoly", F.array(F.flatten(F.array_repeat(F.get("mpoly", F.lit(0)), 5))))
    assert cover.cover(many).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_the_nearest_place_in_a_polygon_is_taken(spark):
    """As by all pairs: of the level if there is one, then by the distance along the spheroid, then by id; also for inputs without a point."""
    places = spark.sql("SELECT id, 'n' AS name, 'c' AS country_code, double(id * 37 % 170 - 85) AS lat, double(id * 53 % 360 - 180) AS lon, int(nullif(id % 6, 5)) AS admin_level FROM range(900)")
    rows = places.where("id % 9 = 0").selectExpr("id AS input_id", "name", "country_code", "CASE WHEN id % 27 = 0 THEN null WHEN id % 18 = 0 THEN lat + 0.5 ELSE lat + 3 END AS lat", "lon", "int(CASE WHEN id % 63 = 0 THEN 9 ELSE admin_level END) AS admin_level", "lon - 8 AS w", "lon + 7 AS e", "lat - 9 AS s", "lat + 6 AS n")
    inputs = rows.withColumn("mpoly", spatial.box_polygon(*[F.col(c) for c in "wesn"]))
    pairs = rows.join(places.toDF(*[f"_{c}" for c in places.columns]), F.expr("_lon > w AND _lon < e AND _lat > s AND _lat < n"))
    pairs = pairs.withColumn("d", F.explode(F.array(F.coalesce(geodesic.distance(*[F.col(c) for c in ("lat", "lon", "_lat", "_lon")]), F.lit(float("inf"))))))
    best = pairs.groupBy("input_id").agg(F.expr("min_by(_id, struct(-coalesce(int(coalesce(admin_level, 3) = _admin_level), 0), d, _id))").alias("place_id")).collect()
    found = {r.input_id: r.place_id for r in gazetteer.match_places(inputs.drop(*"wesn"), places).where("match_rank = 2").collect()}
    assert found == {r.input_id: r.place_id for r in best} and len(found) > 90


def test_pairs_in_order_of_score_are_not_shuffled(spark, monkeypatch):
    """What is sent grows with the places: after the join there is no exchange. Cubes of many pairs, and ids that repeat, give the same order."""
    plan = QUERIES["t08_score_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")] and "Window" in plan
    places = _places(spark).withColumn("lat", F.col("lat") + F.when(F.col("id") % 3 == 0, 0.00001).otherwise(0.0)).withColumn("lat", F.when(F.col("id") % 40 == 7, None).otherwise(F.col("lat")))
    inputs = places.withColumnRenamed("id", "input_id")
    bands = ((1, 10000), (10, 1000), (200_000, 10), (700_000, 1))
    rank = lambda df: sorted(map(tuple, df.selectExpr("input_id", "place_id", "int(score)", "row_number() OVER (PARTITION BY input_id ORDER BY score DESC, place_id)").collect()))
    want = rank(gazetteer.candidates_nearby(inputs, places, 700_000, bands, "osm"))
    for most in (16_000_000, 50):
        monkeypatch.setattr(gazetteer, "PAIRS", most)
        monkeypatch.setattr(gazetteer, "MOST_TASKS", 8)
        assert sorted(map(tuple, gazetteer.ranked_nearby(inputs, places, 700_000, bands).collect())) == want and want
    twice = inputs.withColumn("input_id", F.col("input_id").bitwiseAND(~1))
    found = gazetteer.ranked_nearby(twice, places, 700_000, bands).collect()
    both = gazetteer.candidates_nearby(twice, places, 700_000, bands, "osm").groupBy("input_id").count().collect()
    assert all(sorted(r.place for r in found if r.input_id == b.input_id) == list(range(1, b["count"] + 1)) for b in both[:20])
