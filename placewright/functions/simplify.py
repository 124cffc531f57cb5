"""Simplification of shapes that keeps their rings from crossing.

Each ring is simplified by Douglas and Peucker's rule. Then the simplified sides are held against each other in an index of cells:
where two cross or touch, or where a ring's point has come to lie on the other side of one, the vertex that lies farthest from the side is
put back, until nothing is wrong. The rings as they came are the last resort, so valid shapes stay valid.
"""

from __future__ import annotations

import math
from collections import defaultdict

Point = tuple[float, float]
#: A simplified side: its ring, and the numbers of the vertices at its ends.
Side = tuple[int, int, int]


def _farthest(ring: list[Point], lo: int, hi: int) -> tuple[float, int | None]:
    """Distance and number of the vertex between lo and hi that lies farthest from the side that joins them."""
    (ax, ay), (bx, by) = ring[lo], ring[hi]
    length = math.hypot(bx - ax, by - ay)
    far, at = -1.0, None
    for i in range(lo + 1, hi):
        px, py = ring[i]
        d = abs((bx - ax) * (ay - py) - (ax - px) * (by - ay)) / length if length else math.hypot(px - ax, py - ay)
        if d > far:
            far, at = d, i
    return far, at


def _sides(ring: list[Point], tolerance: float) -> list[tuple[int, int]]:
    """Sides of the ring by Douglas and Peucker's rule; three at least, where there are so many."""
    out, stack = [], [(0, len(ring) - 1)]
    while stack:
        lo, hi = stack.pop()
        far, at = _farthest(ring, lo, hi)
        if at is not None and far > tolerance:
            stack += [(lo, at), (at, hi)]
        else:
            out.append((lo, hi))
    while len(out) < 3 and any(hi - lo > 1 for lo, hi in out):
        lo, hi = max((s for s in out if s[1] - s[0] > 1), key=lambda s: (_farthest(ring, *s)[0], s))
        at = _farthest(ring, lo, hi)[1]
        out = [s for s in out if s != (lo, hi)] + [(lo, at), (at, hi)]
    return out


def _turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(a: Point, b: Point, p: Point) -> bool:
    return _turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def meet(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two sides cross or touch, other than by sharing one end."""
    shared = {a, b} & {c, d}
    if len(shared) == 2:
        return True
    if shared:
        (s,) = shared
        p, q = (b if a == s else a), (d if c == s else c)
        return _on(s, p, q) or _on(s, q, p)
    if _on(a, b, c) or _on(a, b, d) or _on(c, d, a) or _on(c, d, b):
        return True
    return (_turn(a, b, c) > 0) != (_turn(a, b, d) > 0) and (_turn(c, d, a) > 0) != (_turn(c, d, b) > 0)


def _within(p: Point, chain: list[Point]) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(chain, chain[1:] + chain[:1], strict=True):
        if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
            odd = not odd
    return odd


class Index:
    """Sides by the cells that their boxes touch."""

    def __init__(self, size: float) -> None:
        self.size, self.cells = size or 1.0, defaultdict(set)

    def keys(self, a: Point, b: Point):
        for x in range(math.floor(min(a[0], b[0]) / self.size), math.floor(max(a[0], b[0]) / self.size) + 1):
            for y in range(math.floor(min(a[1], b[1]) / self.size), math.floor(max(a[1], b[1]) / self.size) + 1):
                yield x, y

    def near(self, a: Point, b: Point) -> set[Side]:
        return set().union(*[self.cells[k] for k in self.keys(a, b) if k in self.cells])


def simplified(rings: list[list[Point]], tolerance: float) -> list[list[Point]]:
    """Closed rings with fewer vertices: none is farther than the tolerance from the ring it came from, and rings that didn't meet don't."""
    sides: set[Side] = {(r, lo, hi) for r, ring in enumerate(rings) if len(ring) > 1 for lo, hi in _sides(ring, tolerance)}
    lengths = [math.dist(rings[r][lo], rings[r][hi]) for r, lo, hi in sides]
    index = Index(2 * sum(lengths) / len(lengths) if lengths else 1.0)
    ends = lambda s: (rings[s[0]][s[1]], rings[s[0]][s[2]])
    for s in sides:
        for k in index.keys(*ends(s)):
            index.cells[k].add(s)
    spots = [(r, ring[0]) for r, ring in enumerate(rings) if ring]

    def split(s: Side) -> list[Side]:
        sides.discard(s)
        for k in index.keys(*ends(s)):
            index.cells[k].discard(s)
        at = _farthest(rings[s[0]], s[1], s[2])[1]
        made = [(s[0], s[1], at), (s[0], at, s[2])]
        for m in made:
            sides.add(m)
            for k in index.keys(*ends(m)):
                index.cells[k].add(m)
        return made

    #: Sides to be looked at again; one that was split away is passed over.
    due = sorted(sides)
    while due:
        s = due.pop()
        if s not in sides:
            continue
        a, b = ends(s)
        others = [o for o in index.near(a, b) if o != s and meet(a, b, *ends(o))]
        wrong = [o for o in (*others, s) if o[2] - o[1] > 1] if others else []
        if not wrong and s[2] - s[1] > 1:
            chain = rings[s[0]][s[1] : s[2] + 1]
            west, east = min(p[0] for p in chain), max(p[0] for p in chain)
            south, north = min(p[1] for p in chain), max(p[1] for p in chain)
            if any(r != s[0] and west <= p[0] <= east and south <= p[1] <= north and _within(p, chain) for r, p in spots):
                wrong = [s]
        for o in wrong:
            if o in sides:
                due += split(o)
        if wrong and s in sides:
            due.append(s)
    out = []
    for r, ring in enumerate(rings):
        mine = sorted((lo, hi) for q, lo, hi in sides if q == r)
        out.append([ring[lo] for lo, _ in mine] + [ring[-1]] if mine else ring)
    return out
