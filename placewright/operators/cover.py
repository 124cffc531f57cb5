"""Points in polygons by an adaptive cover.

Each polygon is covered by cells of a quadtree: a cell that lies within it whole is flagged so and kept as large as it is; a cell that
the border crosses is cut in four until few edges are left in it. Points look their cells up, at each size that the cover
has. In a whole cell nothing is left to compute; in a border cell a ray is cast against the few edges there. Edges
right of the cell aren't kept: where a ray crosses them depends on nothing but its height, so the heights at which their number turns
from even to odd are enough. The result is that of casting a ray against all edges, to the last bit.

A cover that is small is broadcast after a count. A larger one is joined by cell; cells that hold more than CELL_POINTS points are
dealt over several tasks, with their cover beside each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spatial
from ..session import kept

#: The widest cell; a cell of level n is 2 to the n times narrower.
WORLD = 512.0
#: Edges of a border cell that isn't cut further, and how often the smallest cell that holds a polygon's box is cut.
MOST_EDGES, CUTS = 16, 26
#: Rows of a cover that are broadcast, after a count: a few hundred bytes each.
BROADCAST_CELLS = 20_000
#: Points that one task takes of a cell.
CELL_POINTS = 500_000

def _level(width: float) -> int:
    """The level of the narrowest cells that are at least so wide."""
    level = 0
    while WORLD / 2.0 ** (level + 1) >= width and level < 30:
        level += 1
    while WORLD / 2.0**level < width:
        level -= 1
    return level


def quadtree(edges: np.ndarray) -> Iterator[tuple]:
    """(level, cx, cy, whole, odd, flips, edges) of the cells of a polygon: edges are rows of ax, ay, bx, by."""
    low, high = np.minimum(edges[:, :2], edges[:, 2:]).min(axis=0), np.maximum(edges[:, :2], edges[:, 2:]).max(axis=0)
    level = _level(max(high - low))
    size = WORLD / 2.0**level
    first, last = np.floor(low / size).astype(int), np.floor(high / size).astype(int)
    stack = [(level, int(x), int(y), edges, False, np.empty(0)) for x in range(first[0], last[0] + 1) for y in range(first[1], last[1] + 1)]
    while stack:
        at, x, y, near, odd, flips = stack.pop()
        size = WORLD / 2.0**at
        west, south = x * size, y * size
        east, north = west + size, south + size
        ax, ay, bx, by = near.T
        across = (np.maximum(ay, by) > south) & (np.minimum(ay, by) < north) & (ay != by)
        near, ax, ay, bx, by = near[across], ax[across], ay[across], bx[across], by[across]
        #: Where the edges are between the heights of the cell, and how far rounding may move a crossing.
        slope = (bx - ax) / (by - ay)
        one, two = (slope * (np.clip(v, np.minimum(ay, by), np.maximum(ay, by)) - ay) + ax for v in (south, north))
        scale = abs(west) + abs(east) + abs(south) + abs(north) + 1
        hair = scale * (1e-11 + 1e-13 * np.abs(slope))
        left, right = np.maximum(one, two) < west - hair, np.minimum(one, two) > east + hair
        ends = np.concatenate([flips, near[right][:, 1], near[right][:, 3]])
        odd ^= bool((ends <= south).sum() % 2)
        values, counts = np.unique(ends[(ends > south) & (ends < north)], return_counts=True)
        flips = values[counts % 2 == 1]
        here = near[~left & ~right]
        if not len(here) and not len(flips):
            if odd:
                yield at, x, y, True, True, [], here
        elif len(here) <= MOST_EDGES or at >= level + CUTS:
            yield at, x, y, False, odd, flips.tolist(), here
        else:
            stack += [(at + 1, 2 * x + i, 2 * y + j, here, odd, flips) for i in (0, 1) for j in (0, 1)]


def cover(polygons: DataFrame, shape: str = "mpoly") -> DataFrame:
    """The cells of polygons: their columns but the shape, and level, cx, cy, whole, odd, flips and the edges as ax, ay, bx and by.

    Polygons have a shape, or west, east, south and north, or both; a null shape is that box.
    """
    names = [c for c in polygons.columns if c != shape]
    plain = [F.col(f"`{c}`") for c in names]
    rings = F.filter(F.flatten(F.col(shape)), lambda r: F.size(r) >= 2) if shape in polygons.columns else F.lit(None).cast("array<array<struct<x:double,y:double>>>")
    rows = polygons.select(*plain, rings.alias("_cell_rings"))
    many = F.coalesce(F.size(F.flatten("_cell_rings")) - F.size("_cell_rings") > MOST_EDGES, F.lit(False))
    few = _uncut(rows.where(~many), names)
    if shape not in polygons.columns:
        return few
    of = lambda c: F.transform("_cell_rings", lambda r: F.transform(r, lambda p: p[c].cast("double")))
    #: Dealt over tasks, as a small file may hold many polygons.
    tasks = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.where(many).select(*plain, of("x").alias("_cell_xs"), of("y").alias("_cell_ys")).repartition(tasks)
    form = T.StructType([*[polygons.schema[c] for c in names], *few.schema[len(names) :]])

    def cells(xs: list, ys: list) -> Iterator[tuple]:
        parts = []
        for x, y in zip(xs, ys, strict=True):
            px, py = np.array(x, dtype=float), np.array(y, dtype=float)
            parts.append(np.stack([px[:-1], py[:-1], px[1:], py[1:]], axis=1))
        edges = np.concatenate(parts)
        edges = edges[np.isfinite(edges).all(axis=1)]
        if len(edges):
            yield from quadtree(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(cells(*[batch.column(c)[i].as_py() for c in ("_cell_xs", "_cell_ys")]))
                kept_columns = [batch.column(c).take(pa.array([i] * len(found), pa.int64())) for c in names]
                made = [pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.float64())))]
                sides = [pa.array([f[6][:, j].tolist() for f in found], pa.list_(pa.float64())) for j in range(4)]
                yield pa.RecordBatch.from_arrays([*kept_columns, *made, *sides], names=[f.name for f in form])

    return few.unionByName(cut.mapInArrow(run, form))


def _uncut(rows: DataFrame, names: list[str]) -> DataFrame:
    """The cells of polygons of so few edges that none is cut, and of boxes without a shape.

    A shape that is the box of its row lies whole in its cells, as points are held against the box anyway.
    """
    plain = [F.col(f"`{c}`") for c in names]
    corner = lambda c: F.col(c).cast("double") if "west" in names else F.lit(None).cast("double")
    west, south, east, north = map(corner, ("west", "south", "east", "north"))
    points = lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.struct(*[F.get(r, i + j)[c].cast("double").alias(f"{end}{c}") for j, end in ((0, "a"), (1, "b")) for c in "xy"]))
    finite = lambda e: F.coalesce(F.abs(e["ax"]) + F.abs(e["ay"]) + F.abs(e["bx"]) + F.abs(e["by"]) < float("inf"), F.lit(False))
    edges = F.coalesce(F.filter(F.flatten(F.transform("_cell_rings", points)), finite), F.array())
    #: Exploded, so that an array isn't computed for each of its uses.
    out = rows.select(*plain, F.col("_cell_rings").isNull().alias("_cell_odd"), (F.size(F.get("_cell_rings", F.lit(0))) == 5).alias("_cell_five"), F.size("_cell_rings").alias("_cell_n"), F.explode(F.array(edges)).alias("_cell_edges"))
    out = out.where(F.col("_cell_odd") | (F.size("_cell_edges") > 0))
    all_of = lambda end, c: F.transform("_cell_edges", lambda e: e[f"{end}{c}"])
    least = lambda c: F.least(F.array_min(all_of("a", c)), F.array_min(all_of("b", c)))
    most = lambda c: F.greatest(F.array_max(all_of("a", c)), F.array_max(all_of("b", c)))
    reach = F.struct(*[F.when(F.col("_cell_odd"), box).otherwise(shape).alias(k) for k, box, shape in (("w", west, least("x")), ("s", south, least("y")), ("e", east, most("x")), ("n", north, most("y")))])
    out = out.withColumn("_cell_r", F.explode(F.array(reach))).where("_cell_r.w <= _cell_r.e AND _cell_r.s <= _cell_r.n")
    w, s, e, n = (F.col(f"_cell_r.{k}") for k in "wsen")
    side = lambda i, c: F.get("_cell_edges", F.lit(i))[f"a{c}"] == F.get("_cell_edges", F.lit(i))[f"b{c}"]
    turns = lambda one, two: side(0, one) & side(1, two) & side(2, one) & side(3, two)
    closed = F.get("_cell_edges", F.lit(3))
    closed = (closed["bx"] == F.get("_cell_edges", F.lit(0))["ax"]) & (closed["by"] == F.get("_cell_edges", F.lit(0))["ay"])
    whole = (F.col("_cell_n") == 1) & F.col("_cell_five") & (F.size("_cell_edges") == 4) & closed & (turns("x", "y") | turns("y", "x")) & (w == west) & (s == south) & (e == east) & (n == north)
    out = out.withColumn("_cell_whole", F.coalesce(whole | F.col("_cell_odd"), F.lit(False)))
    width = F.greatest(e - w, n - s)
    level = F.when(width > WORLD / 2.0**30, F.floor(F.log2(WORLD / width))).otherwise(30).cast("int")
    out = out.withColumn("_cell_level", F.explode(F.array(level)))
    size = WORLD / F.pow(F.lit(2.0), F.col("_cell_level"))
    along = lambda low, high: F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))
    out = out.withColumn("_cell_cx", along(w, e)).withColumn("_cell_cy", along(s, n))
    ends = [F.when(F.col("_cell_whole"), F.array().cast("array<double>")).otherwise(all_of(*c)).alias(f"_cell_{''.join(c)}") for c in ("ax", "ay", "bx", "by")]
    return out.select(*plain, "_cell_level", "_cell_cx", "_cell_cy", "_cell_whole", (F.col("_cell_odd") | F.col("_cell_whole")).alias("_cell_odd"), F.array().cast("array<double>").alias("_cell_flips"), *ends)


def _holds(x: Column, y: Column) -> Column:
    """Whether the polygon of a cell's row holds a point of that cell."""
    edges = F.arrays_zip(F.col("_cell_ax").alias("ax"), F.col("_cell_ay").alias("ay"), F.col("_cell_bx").alias("bx"), F.col("_cell_by").alias("by"))
    met = F.size(F.filter(edges, lambda e: spatial.crosses(e["ax"], e["ay"], e["bx"], e["by"], x, y))) + F.size(F.filter("_cell_flips", lambda v: v <= y))
    return F.col("_cell_whole") | ((met % 2 == 1) != F.col("_cell_odd"))


def inside(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat", shape: str = "mpoly", on: dict[str, str] | None = None, broadcast: int = BROADCAST_CELLS) -> DataFrame:
    """points joined with the columns (but the shape) of the polygons that hold them.

    Where polygons have west, east, south and north, a point must lie within those too, not on them. on: columns of points that
    must equal columns of polygons. broadcast: rows of a cover that are broadcast.
    """
    return met(points, kept(cover(polygons, shape), "cover"), x, y, on, broadcast)


def met(points: DataFrame, cells: DataFrame, x: str = "lon", y: str = "lat", on: dict[str, str] | None = None, broadcast: int = BROADCAST_CELLS, where: Column | None = None) -> DataFrame:
    """inside() with a cover that has been written; where: a condition on columns of both, told before containment is."""
    names = [c for c in cells.columns if not c.startswith("_cell_")]
    known = cells.agg(F.count(F.lit(1)).alias("n"), F.collect_set("_cell_level").alias("levels")).first()  # some forty levels at most
    at = lambda level: [F.floor(F.col(c) / (WORLD / 2.0**level)) for c in (x, y)]
    keys = F.array(*[F.struct(F.lit(k).alias("level"), at(k)[0].alias("cx"), at(k)[1].alias("cy")) for k in sorted(known.levels)]) if known.levels else F.array().cast("array<struct<level:int,cx:bigint,cy:bigint>>")
    looked = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_cell_at", F.explode(keys))
    hit = (F.col("_cell_at.level") == F.col("_cell_level")) & (F.col("_cell_at.cx") == F.col("_cell_cx")) & (F.col("_cell_at.cy") == F.col("_cell_cy"))
    for mine, theirs in (on or {}).items():
        hit = hit & (F.col(mine) == F.col(theirs))
    if known.n <= broadcast:
        joined = looked.join(F.broadcast(cells), hit)
    else:
        looked, cells = _dealt(looked, cells)
        joined = looked.join(cells, hit & (F.col("_cell_part") == F.col("_cell_share")))
    if "west" in names:
        joined = joined.where(spatial.within_box(F.col(x), F.col(y), F.col("west"), F.col("east"), F.col("south"), F.col("north")))
    if where is not None:
        joined = joined.where(where)
    #: Exploded, so that the ray, which isn't compiled, is cast after the join and not within its condition.
    joined = joined.withColumn("_cell_held", F.explode(F.array(_holds(F.col(x), F.col(y))))).where("_cell_held")
    return joined.select(*points.columns, *names)


def _dealt(looked: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """looked with _part and cells with _share: cells of many points have a copy of their cover for each part of the points."""
    hot = looked.groupBy("_cell_at").agg(F.count(F.lit(1)).alias("_cell_n")).where(F.col("_cell_n") > CELL_POINTS)
    hot = kept(hot.select("_cell_at.*", F.ceil(F.col("_cell_n") / CELL_POINTS).cast("int").alias("_cell_parts")), "hot")
    #: One row for CELL_POINTS rows of points and more.
    few = F.broadcast(hot) if hot.count() <= BROADCAST_CELLS else hot
    named = few.select(F.col("level").alias("_cell_l"), F.col("cx").alias("_cell_xs"), F.col("cy").alias("_cell_ys"), "_cell_parts")
    parted = looked.join(named, (F.col("_cell_at.level") == F.col("_cell_l")) & (F.col("_cell_at.cx") == F.col("_cell_xs")) & (F.col("_cell_at.cy") == F.col("_cell_ys")), "left")
    parted = parted.withColumn("_cell_part", F.coalesce(F.pmod(F.xxhash64(*looked.columns), F.col("_cell_parts")), F.lit(0)).cast("int")).drop("_cell_l", "_cell_xs", "_cell_ys", "_cell_parts")
    copied = cells.join(named, (F.col("_cell_level") == F.col("_cell_l")) & (F.col("_cell_cx") == F.col("_cell_xs")) & (F.col("_cell_cy") == F.col("_cell_ys")), "left")
    copied = copied.withColumn("_cell_share", F.explode(F.sequence(F.lit(0), F.coalesce("_cell_parts", F.lit(1)) - 1))).drop("_cell_l", "_cell_xs", "_cell_ys", "_cell_parts")
    return parted, copied
