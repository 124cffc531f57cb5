"""Distances along the spheroid of WGS 84 as column expressions.

The inverse problem is solved by Vincenty's iteration, a fixed number of rounds: for points that are near each other over Arrow batches
of pairs (`short`), for any others each a step of an aggregate over a sequence, which isn't compiled. It
gains more than two digits a round but where the points are nearly opposite each other; there it doesn't settle. For those the shortest
way is looked for instead: every way from a point to the other side crosses the great circle a quarter of the world away from it, and
the distance is the smallest sum of the two parts, each of which the iteration solves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: the spheroid of WGS 84, its large half axis and flattening, and the mean radius.
A, FLAT, MEAN = 6378137.0, 1 / 298.257223563, 6371008.8
B = A * (1 - FLAT)
#: Rounds for points less than NEAR metres apart, and for others.
ROUNDS, FAR_ROUNDS, NEAR = 6, 24, 2_000_000
#: The last round's change, in radians, beyond which the iteration hasn't settled.
SETTLED = 1e-11
#: Places tried around the great circle, and rounds of narrowing down the best of them.
TRIED, NARROWED = 36, 45


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def sphere(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on a sphere of the mean radius (haversine); up to 0.6 % from the spheroid's."""
    up = lambda x: F.pow(F.sin(F.radians(x) / 2), F.lit(2.0))
    a = up(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * up(lon2 - lon1)
    return 2 * MEAN * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def _reduced(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Sines and cosines of the reduced latitudes, and the difference of longitudes within half a turn."""

    def parts(lat: Column) -> tuple[Column, Column]:
        north = F.sin(F.radians(lat)) * (1 - FLAT)
        flat = F.cos(F.radians(lat))
        length = F.sqrt(north * north + flat * flat)
        return north / length, flat / length

    (s1, c1), (s2, c2) = parts(lat1), parts(lat2)
    turn = F.radians(lon2 - lon1)
    turn = turn - 2 * math.pi * F.floor((turn + math.pi) / (2 * math.pi))
    return F.struct(s1.alias("s1"), c1.alias("c1"), s2.alias("s2"), c2.alias("c2"), turn.alias("l"))


def _on_sphere(p: Column, l: Column) -> Column:  # noqa: E741
    """What the auxiliary sphere says of a difference of longitudes: sine, cosine and size of the arc, cosine squared of the azimuth, and so on."""
    x = p["c2"] * F.sin(l)
    y = p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(l)

    def then(s: Column) -> Column:
        sine = F.coalesce(p["c1"] * p["c2"] * F.sin(l) / F.nullif(s["sin"], F.lit(0.0)), F.lit(0.0))
        return let(F.struct(s["sin"].alias("sin"), s["cos"].alias("cos"), F.atan2(s["sin"], s["cos"]).alias("arc"), sine.alias("sa"), F.greatest(F.lit(0.0), 1 - sine * sine).alias("ca2")), middle)

    def middle(s: Column) -> Column:
        return F.struct(s["sin"].alias("sin"), s["cos"].alias("cos"), s["arc"].alias("arc"), s["sa"].alias("sa"), s["ca2"].alias("ca2"), F.when(s["ca2"] < 1e-14, 0.0).otherwise(s["cos"] - 2 * p["s1"] * p["s2"] / s["ca2"]).alias("mid"))

    return let(F.struct(F.sqrt(x * x + y * y).alias("sin"), (p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(l)).alias("cos")), then)


def _next(p: Column, l: Column) -> Column:  # noqa: E741
    def then(s: Column) -> Column:
        c = FLAT / 16 * s["ca2"] * (4 + FLAT * (4 - 3 * s["ca2"]))
        return p["l"] + (1 - c) * FLAT * s["sa"] * (s["arc"] + c * s["sin"] * (s["mid"] + c * s["cos"] * (2 * s["mid"] * s["mid"] - 1)))

    return let(_on_sphere(p, l), then)


def _metres(p: Column, l: Column) -> Column:  # noqa: E741
    def then(s: Column) -> Column:
        u2 = s["ca2"] * ((A * A - B * B) / (B * B))
        return let(F.struct((1 + u2 / 16384 * (4096 + u2 * (u2 * (320 - 175 * u2) - 768))).alias("a"), (u2 / 1024 * (256 + u2 * (u2 * (74 - 47 * u2) - 128))).alias("b")), lambda k: length(s, k))

    def length(s: Column, k: Column) -> Column:
        mid2 = s["mid"] * s["mid"]
        less = k["b"] * s["sin"] * (s["mid"] + k["b"] / 4 * (s["cos"] * (2 * mid2 - 1) - k["b"] / 6 * s["mid"] * (4 * s["sin"] * s["sin"] - 3) * (4 * mid2 - 3)))
        return B * k["a"] * (s["arc"] - less)

    return let(_on_sphere(p, l), then)


def _solved(p: Column, rounds: Column) -> Column:
    """Metres, or null where the iteration hasn't settled within its rounds."""
    start = F.struct(p["l"].alias("l"), F.lit(1.0).alias("by"))

    def step(acc: Column, _: Column) -> Column:
        return let(_next(p, acc["l"]), lambda l: F.struct(l.alias("l"), F.abs(l - acc["l"]).alias("by")))  # noqa: E741

    def end(acc: Column) -> Column:
        return F.when((acc["by"] <= SETTLED) & (F.abs(acc["l"]) <= math.pi), _metres(p, acc["l"]))

    return F.aggregate(F.sequence(F.lit(1), rounds), start, step, end)


def _settled(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: Column) -> Column:
    return let(_reduced(lat1, lon1, lat2, lon2), lambda p: _solved(p, rounds))


def _round_the_back(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between points that are nearly opposite: the shortest way by a point of the great circle between them."""
    point = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))

    def by(turn: Column) -> Column:
        """Metres by the point of that circle in a direction from the first; null where a part isn't settled."""
        here = F.radians(lat1)
        north = F.cos(here) * F.cos(turn)
        lat = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), north))))
        lon = lon1 + F.degrees(F.atan2(F.sin(turn) * F.cos(here), -F.sin(here) * north))
        both = lambda m: F.transform(F.array(point(lat1, lon1), point(lat2, lon2)), lambda end: _settled(end["lat"], end["lon"], m["lat"], m["lon"], F.lit(FAR_ROUNDS)))
        return let(let(point(lat, lon), both), lambda parts: parts[0] + parts[1])

    width = 2 * math.pi / TRIED
    #: A step aside, so that neither pole is tried itself: a way there has no direction.
    tries = F.transform(F.sequence(F.lit(0), F.lit(TRIED - 1)), lambda i: let((i + 0.37) * width, lambda t: F.struct(by(t).alias("m"), t.alias("t"))))

    def narrow(acc: Column, _: Column) -> Column:
        third = (acc["hi"] - acc["lo"]) / 3
        ways = F.transform(F.array(acc["lo"] + third, acc["hi"] - third), by)
        return let(ways, lambda w: F.struct(F.when(w[0] <= w[1], acc["lo"]).otherwise(acc["lo"] + third).alias("lo"), F.when(w[0] <= w[1], acc["hi"] - third).otherwise(acc["hi"]).alias("hi")))

    def best(first: Column) -> Column:
        span = F.struct((first["t"] - width).alias("lo"), (first["t"] + width).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(NARROWED)), span, narrow, lambda acc: by((acc["lo"] + acc["hi"]) / 2))

    #: There are ways on either side of the second point; both are looked at, as the tries may rank them wrongly.
    sides = lambda found: F.concat(F.slice(found, 1, 1), F.slice(F.filter(found, lambda t: F.cos(t["t"] - found[0]["t"]) < 0.7), 1, 1))
    ordered = F.array_sort(F.filter(tries, lambda t: t["m"].isNotNull()))
    return F.array_min(F.transform(let(ordered, sides), best))


def _short(lat1: pa.Array, lon1: pa.Array, lat2: pa.Array, lon2: pa.Array) -> pa.Array:
    """Vincenty's iteration over a batch of pairs; pairs with a null aren't computed."""
    ends = [np.radians(c.to_numpy(zero_copy_only=False).astype(float)) for c in (lat1, lon1, lat2, lon2)]
    known = np.flatnonzero(np.isfinite(ends).all(axis=0))
    out = np.full(len(lat1), np.nan)
    with np.errstate(all="ignore"):
        out[known] = _near_metres(*(e[known] for e in ends))
    return pa.array(out, pa.float64(), mask=np.isnan(out))


def _near_metres(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Metres between points in radians after ROUNDS rounds; not a number where the iteration hasn't settled."""
    u1, u2 = (np.arctan2((1 - FLAT) * np.sin(v), np.cos(v)) for v in (lat1, lat2))
    (s1, c1), (s2, c2) = (np.sin(u1), np.cos(u1)), (np.sin(u2), np.cos(u2))
    turn = lon2 - lon1
    turn = turn - 2 * np.pi * np.floor((turn + np.pi) / (2 * np.pi))

    def on_sphere(l: np.ndarray) -> tuple[np.ndarray, ...]:  # noqa: E741
        x, y = c2 * np.sin(l), c1 * s2 - s1 * c2 * np.cos(l)
        sin, cos = np.sqrt(x * x + y * y), s1 * s2 + c1 * c2 * np.cos(l)
        sa = np.where(sin == 0, 0.0, c1 * c2 * np.sin(l) / sin)
        ca2 = np.maximum(0.0, 1 - sa * sa)
        return sin, cos, np.arctan2(sin, cos), sa, ca2, np.where(ca2 < 1e-14, 0.0, cos - 2 * s1 * s2 / ca2)

    l, by = turn, np.ones_like(turn)  # noqa: E741
    for _ in range(ROUNDS):
        sin, cos, arc, sa, ca2, mid = on_sphere(l)
        c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
        after = turn + (1 - c) * FLAT * sa * (arc + c * sin * (mid + c * cos * (2 * mid * mid - 1)))
        l, by = after, np.abs(after - l)  # noqa: E741
    sin, cos, arc, sa, ca2, mid = on_sphere(l)
    k = ca2 * ((A * A - B * B) / (B * B))
    a, b = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768)), k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
    mid2 = mid * mid
    less = b * sin * (mid + b / 4 * (cos * (2 * mid2 - 1) - b / 6 * mid * (4 * sin * sin - 3) * (4 * mid2 - 3)))
    return np.where((by <= SETTLED) & (np.abs(l) <= np.pi), B * a * (arc - less), np.nan)


def short(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points along the spheroid, to a millimetre, if they are less than NEAR metres apart."""
    return F.arrow_udf(_short, T.DoubleType())(*(c.cast("double") for c in (lat1, lon1, lat2, lon2)))


def near(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """As short(), by Spark's own functions: slower, but not called where a condition around it says so."""
    ends = (lat1, lon1, lat2, lon2)
    return F.coalesce(_settled(*ends, F.lit(ROUNDS)), sphere(*ends))


def telling(lat1: Column, lon1: Column, lat2: Column, lon2: Column, limits: tuple[float, ...]) -> Column:
    """Metres by which it can be told within which limits (less than NEAR) two points are: along the spheroid where the sphere leaves a doubt, else along the sphere."""
    ends = (lat1, lon1, lat2, lon2)
    round_ = sphere(*ends)
    doubt = F.lit(False)
    for limit in limits:
        doubt = doubt | round_.between(limit * 0.99, limit * 1.01)
    #: A null isn't computed, whereas a condition around the function doesn't keep it from being called.
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, F.coalesce(short(F.when(doubt, lat1), lon1, lat2, lon2), round_))


def axes(lat: Column, lon: Column) -> list[Column]:
    """Metres from the centre of the spheroid along three axes."""
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    normal = A / F.sqrt(1 - FLAT * (2 - FLAT) * s * s)
    return [normal * c * F.cos(F.radians(lon)), normal * c * F.sin(F.radians(lon)), normal * (1 - FLAT) ** 2 * s]


def chords(metres: float) -> tuple[float, float]:
    """Squares of straight lines through the spheroid: ends of a shorter one are within so many metres (less than NEAR) along it, those of a longer one aren't.

    A way bends no more than the tightest curve there is, b * b / a, and no less than the widest, a * a / b, by a hair for those that aren't plane.
    """
    straight = lambda r: 2 * r * math.sin(metres / (2 * r))
    low, high = straight(B * B / A) * (1 - 1e-6) - 1e-4, straight(A * A / B) * (1 + 1e-6) + 1e-4
    return max(0.0, low) ** 2, high**2


def nearer(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    """Whether two points are nearer to each other than a radius of less than NEAR; what the sphere rules out isn't sent to Python."""
    ends = (lat1, lon1, lat2, lon2)
    return (sphere(*ends) < radius * 1.01) & (short(*ends) < radius)


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points along the spheroid, to a millimetre. Null where a coordinate is."""
    rounds = F.when(sphere(lat1, lon1, lat2, lon2) < NEAR, ROUNDS).otherwise(FAR_ROUNDS)
    solved = _settled(lat1, lon1, lat2, lon2, rounds)
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, F.coalesce(solved, _round_the_back(lat1, lon1, lat2, lon2)))


def within(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    """Whether two points are within a radius: the sphere decides wherever it's beyond doubt."""
    if radius * 1.02 < NEAR:
        return F.coalesce(telling(lat1, lon1, lat2, lon2, (radius,)) <= radius, F.lit(False))
    round_ = sphere(lat1, lon1, lat2, lon2)
    return F.when(round_ > radius * 1.01, False).when(round_ < radius * 0.99, True).otherwise(distance(lat1, lon1, lat2, lon2) <= radius)
