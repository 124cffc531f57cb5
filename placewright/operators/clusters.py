"""Points of one name that lie near each other, directly or by way of others, as clusters.

Points are put into cubes so small that any two in a cube are near, so a cube is one node, however many points it holds.
Neighbouring cubes are joined by an edge if a point of one is near a point of the other. Cubes of few points carry them along and
are compared where they meet. Where points are many, that is told without pairing them: cubes are cut into smaller ones until two of those are surely near, or all are too far, or few points are left to
compare. Components of the edges are found by stars: alternately every node hands its larger and its smaller neighbours to
the smallest one it knows, until nothing changes; the rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesic, spatial
from ..session import drop, kept

#: A cube is cut into so many along each side.
CUT = 8
#: Pairs of points of two cubes that are compared one by one, at most; beyond, the cubes are cut.
PAIRS = 4096
#: Cubes along each side of a block, in which neighbouring cubes meet.
BLOCK = 16
#: How often cubes are cut: the last are a tenth of a millimetre wide for a radius of 10 km, and points in one are then one.
DEEPEST = 9
#: The spheroid's distances differ from the sphere's by less than this share.
SLACK = 0.01


def _cube(side: float, depth: int = 0) -> Column:
    return F.struct(*[F.floor(v / side * CUT**depth).alias(f"c{i}") for i, v in enumerate(spatial.axes(F.col("lat"), F.col("lon")))])


def _gap(a: Column, b: Column, side: float, extra: int) -> Column:
    """Distance through the sphere of the nearest (extra -1) or farthest (1) corners of two cubes."""
    steps = [F.greatest(F.abs(a[f"c{i}"] - b[f"c{i}"]) + extra, F.lit(0)).cast("double") * side for i in range(3)]
    return F.sqrt(steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2])


def _chord(radius: float) -> float:
    """The way through the sphere between points that are a radius apart along it."""
    return 2 * geodesic.MEAN * math.sin(min(radius / geodesic.MEAN, math.pi) / 2)


def clusters(points: DataFrame, radius: float = 10_000) -> DataFrame:
    """(input_id, cluster) of points (input_id, name, lat, lon): the smallest id that is reached by steps within the radius from point to point of that name.

    Null names meet no others; a point without coordinates is a cluster of its own.
    """
    sure, maybe = _chord(radius * (1 - SLACK)), _chord(radius * (1 + SLACK))
    side = sure / math.sqrt(3)
    rows = points.select("input_id", "name", "lat", "lon")
    placed = kept(rows.where("name IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL"), "placed").withColumn("cube", _cube(side))
    #: Written, so that both sides of the join come straight from a shuffle and a cube of very many points is split.
    node = kept(placed.groupBy("name", "cube").agg(F.min("input_id").alias("node"), F.count(F.lit(1)).alias("n")), "cubes")
    tagged = kept(placed.join(node, ["name", "cube"]).select("input_id", "node", "n", "name", "lat", "lon"), "tagged")
    #: A cube of few points carries them along; of others, one tells where the cube is.
    spot, few = F.struct("lat", "lon"), F.col("n") <= math.isqrt(PAIRS)
    nodes = kept(tagged.groupBy("node").agg(F.first("name").alias("name"), F.min("lat").alias("_lat"), F.min_by("lon", "lat").alias("_lon"), F.collect_set(F.when(few, spot)).alias("dots")), "nodes")
    found = components(_edges(placed, nodes, side, radius, sure, maybe))
    known = tagged.select("input_id", "node").join(found, F.col("node") == F.col("member"), "left").select("input_id", F.coalesce("cluster", "node").alias("cluster"))
    lost = rows.where("name IS NULL OR lat IS NULL OR lon IS NULL").select("input_id", F.col("input_id").alias("cluster"))
    return known.unionByName(lost)


def _beside(nodes: DataFrame, side: float, maybe: float) -> DataFrame:
    """(name, a, one, dots_a, b, other, dots_b): each pair of nodes of a name that may have points near each other, once.

    Cubes meet in blocks: one of the pair is in its own block alone, the other in every block that it reaches two cubes far. So a cube is
    shuffled about three times, not once for each of its 62 neighbours, and a block holds no more cubes than the sphere has there.
    """
    cube = F.struct(*[F.floor(v / side).alias(f"c{i}") for i, v in enumerate(spatial.axes(F.col("_lat"), F.col("_lon")))])
    of = nodes.select("name", "node", "dots", cube.alias("cube"))
    one = of.select(F.col("name"), F.col("node").alias("a"), F.col("cube").alias("one"), F.col("dots").alias("dots_a"), *[_block(i, 0).alias(f"_b{i}") for i in range(3)])
    other = _reached(of).select(F.col("name").alias("_name"), F.col("node").alias("b"), F.col("cube").alias("other"), F.col("dots").alias("dots_b"), "_o0", "_o1", "_o2")
    met = (F.col("name") == F.col("_name")) & (F.col("_b0") == F.col("_o0")) & (F.col("_b1") == F.col("_o1")) & (F.col("_b2") == F.col("_o2"))
    pairs = one.join(other.hint("merge"), met & (F.col("other") > F.col("one")) & (_gap(F.col("one"), F.col("other"), side, -1) <= maybe))
    return pairs.select("name", "a", "one", "dots_a", "b", "other", "dots_b")


def _block(i: int, off: int) -> Column:
    return F.floor((F.col(f"cube.c{i}") + off) / BLOCK)


def _reached(cubes: DataFrame) -> DataFrame:
    """A row for each block that a cube reaches: blocks of cubes that it's ahead of, so never behind it along the first axis."""
    out = cubes.withColumn("_o0", F.explode(F.sequence(_block(0, -2), _block(0, 0))))
    for i in (1, 2):
        out = out.withColumn(f"_o{i}", F.explode(F.sequence(_block(i, -2), _block(i, 2))))
    return out


def _edges(placed: DataFrame, nodes: DataFrame, side: float, radius: float, sure: float, maybe: float) -> DataFrame:
    """(a, b) of nodes that have points near each other; a pair may come more than once."""
    pairs = _beside(nodes, side, maybe)
    each = pairs.select("a", "b", F.explode("dots_a").alias("p"), "dots_b").select("a", "b", "p", F.explode("dots_b").alias("q"))
    ends = [F.col(c) for c in ("p.lat", "p.lon", "q.lat", "q.lon")]
    edges = each.where(geodesic.sphere(*ends) <= radius * (1 + SLACK)).where(geodesic.within(*ends, radius)).select("a", "b")
    if nodes.where(F.size("dots") == 0).isEmpty():
        return edges
    many = kept(pairs.where((F.size("dots_a") == 0) | (F.size("dots_b") == 0)).select("name", "a", "b", "one", "other"), "pairs")
    return edges if many.isEmpty() else edges.unionByName(_cut(placed, many, side, radius, sure, maybe))


def _cut(placed: DataFrame, pairs: DataFrame, side: float, radius: float, sure: float, maybe: float) -> DataFrame:
    """(a, b) of the pairs that have points near each other, told by cutting their cubes."""
    near = placed.join(pairs.select("name", F.col("one").alias("cube")).unionByName(pairs.select("name", F.col("other").alias("cube"))).distinct(), ["name", "cube"], "left_semi")
    dots = kept(near.groupBy("name", "lat", "lon").agg(F.first("cube").alias("root")), "dots")
    done: DataFrame | None = None
    for depth in range(DEEPEST + 1):
        #: The cubes of this depth, with the points in them, and those that the pairs still in doubt are made of.
        at = dots.withColumn("cube", _cube(side, depth)) if depth else dots.withColumn("cube", F.col("root"))
        cubes = kept(at.groupBy("name", "root", "cube").agg(F.count(F.lit(1)).alias("n")), "cubes")
        parent = F.struct(*[F.floor(F.col(f"cube.c{i}") / CUT).alias(f"c{i}") for i in range(3)]) if depth else F.col("cube")
        inside = cubes.select("name", "cube", "n", parent.alias("parent"))
        first = inside.select(F.col("name").alias("_name"), F.col("parent").alias("_p"), F.col("cube").alias("ca"), F.col("n").alias("na"))
        second = inside.select(F.col("name").alias("_name2"), F.col("parent").alias("_q"), F.col("cube").alias("cb"), F.col("n").alias("nb"))
        width = side / CUT**depth
        met = pairs.join(first, (F.col("name") == F.col("_name")) & (F.col("one") == F.col("_p"))).join(second, (F.col("name") == F.col("_name2")) & (F.col("other") == F.col("_q")))
        met = kept(met.where(_gap(F.col("ca"), F.col("cb"), width, -1) <= maybe).select("name", "a", "b", "ca", "cb", "na", "nb", (_gap(F.col("ca"), F.col("cb"), width, 1) <= sure).alias("sure")), "met")
        linked = met.where("sure").select("a", "b").distinct()
        doubt = met.join(linked, ["a", "b"], "left_anti")
        last = depth == DEEPEST
        few = doubt if last else doubt.where(F.col("na") * F.col("nb") <= PAIRS)
        spots = at.select(F.col("name").alias("_n"), "cube", "lat", "lon")
        #: Points of the deepest cubes are a tenth of a millimetre apart at most: one stands for all.
        spots = spots.groupBy("_n", "cube").agg(F.min_by(F.struct("lat", "lon"), F.struct("lat", "lon")).alias("_p")).select("_n", "cube", "_p.lat", "_p.lon") if last else spots
        left = spots.select(F.col("_n").alias("_n1"), F.col("cube").alias("_c1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
        right = spots.select(F.col("_n").alias("_n2"), F.col("cube").alias("_c2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
        beside = few.join(left, (F.col("name") == F.col("_n1")) & (F.col("ca") == F.col("_c1"))).join(right, (F.col("name") == F.col("_n2")) & (F.col("cb") == F.col("_c2")))
        exact = beside.where(geodesic.within(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), radius)).select("a", "b").distinct()
        linked = kept(linked.unionByName(exact), "linked")
        done = linked if done is None else done.unionByName(linked)
        if last:
            break
        pairs = kept(doubt.where(F.col("na") * F.col("nb") > PAIRS).join(linked, ["a", "b"], "left_anti").select("name", "a", "b", F.col("ca").alias("one"), F.col("cb").alias("other")), "pairs")
        if pairs.isEmpty():
            break
    return done.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(member, cluster) of the nodes of edges (a, b): the smallest node of each one's component."""
    edges = kept(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        before, larger = edges, kept(_larger(edges), "larger")
        edges = kept(_smaller(larger), "edges")
        drop(before)
        drop(larger)
        if edges.where("moved").isEmpty():
            break
    return edges.select(F.col("a").alias("member"), F.col("b").alias("cluster")).unionByName(edges.select(F.col("b").alias("member"), F.col("b").alias("cluster")).distinct())


def _larger(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours lead to the smallest node that it knows, itself included. moved: that isn't itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("_m", F.col("a")).alias("_m"))
    ahead = edges.select(F.col("b").alias("_of"), "a").join(least, F.col("_of") == F.col("_a"))
    return ahead.select("a", F.col("_m").alias("b"), (F.col("_m") != F.col("_of")).alias("moved"))


def _smaller(edges: DataFrame) -> DataFrame:
    """Each node and its neighbours, all smaller, lead to the smallest of them. moved: of a node, that an edge has changed; none has if all are stars."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m"), (F.max("moved") | (F.min("b") < F.max("b"))).alias("moved")).select(F.col("a").alias("_a"), "_m", "moved")
    others = edges.select("a", "b").join(least, F.col("a") == F.col("_a")).where(F.col("b") != F.col("_m"))
    led = others.select(F.col("b").alias("a"), F.col("_m").alias("b"), F.lit(True).alias("moved")).unionByName(least.select(F.col("_a").alias("a"), F.col("_m").alias("b"), "moved"))
    return led.groupBy("a", "b").agg(F.max("moved").alias("moved"))
