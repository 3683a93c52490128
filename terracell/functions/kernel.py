"""Exact predicates on any two geometries, for what the column expressions of predicates.py don't cover.

Coordinates become fractions, so nothing is rounded. A geometry is cut into points, segments and polygons; a predicate
cuts the one's segments where they meet the other's and asks of each piece's middle whether it lies inside, on the border
or outside of the other.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import pairwise

from terracell.functions.types import LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON

Place = tuple[Fraction, Fraction]
INSIDE, BORDER, OUTSIDE = 1, 0, -1


def _turn(a: Place, b: Place, c: Place) -> int:
    d = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (d > 0) - (d < 0)


def on_segment(p: Place, a: Place, b: Place) -> bool:
    return _turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def meets(a: Place, b: Place, c: Place, d: Place) -> list[Place]:
    """Places where two segments meet; of an overlap, its ends."""
    r, s = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
    cross = r[0] * s[1] - r[1] * s[0]
    if cross == 0:
        return [p for p in (c, d) if on_segment(p, a, b)] + [p for p in (a, b) if on_segment(p, c, d)]
    t = ((c[0] - a[0]) * s[1] - (c[1] - a[1]) * s[0]) / cross
    u = ((c[0] - a[0]) * r[1] - (c[1] - a[1]) * r[0]) / cross
    return [(a[0] + t * r[0], a[1] + t * r[1])] if 0 <= t <= 1 and 0 <= u <= 1 else []


def in_rings(p: Place, rings: list[list[Place]]) -> int:
    """Of a place and a polygon with holes, by crossings of a ray to the right."""
    odd = False
    for ring in rings:
        for a, b in pairwise(ring):
            if on_segment(p, a, b):
                return BORDER
            if (a[1] > p[1]) != (b[1] > p[1]) and (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] > p[0]:
                odd = not odd
    return INSIDE if odd else OUTSIDE


class Shape:
    def __init__(self, gtype: int, parts: list) -> None:
        made = [[[(Fraction(p["x"]), Fraction(p["y"])) if isinstance(p, dict) else (Fraction(p[0]), Fraction(p[1])) for p in r] for r in part] for part in parts]
        self.points: list[Place] = []
        self.lines: list[list[Place]] = []
        self.polygons: list[list[list[Place]]] = []
        for part in made:
            if gtype in (POLYGON, MULTIPOLYGON) or gtype not in (POINT, LINE, MULTIPOINT, MULTILINE) and len(part[0]) > 3 and part[0][0] == part[0][-1]:
                self.polygons.append([r if r[0] == r[-1] else [*r, r[0]] for r in part])
            elif len(part[0]) == 1:
                self.points.append(part[0][0])
            else:
                self.lines.append(part[0])
        ends: dict[Place, int] = {}
        for line in self.lines:
            for e in (line[0], line[-1]):
                ends[e] = ends.get(e, 0) + 1
        self.ends = {p for p, n in ends.items() if n % 2}
        self.segments = [s for line in self.lines for s in pairwise(line)]
        self.edges = [s for poly in self.polygons for ring in poly for s in pairwise(ring)]

    def locate(self, p: Place) -> int:
        """The best of all parts' answers. A line's ends are its border, a point has none."""
        best = OUTSIDE
        for rings in self.polygons:
            best = max(best, in_rings(p, rings))
        if best < INSIDE and self.lines and any(on_segment(p, *s) for s in self.segments):
            best = max(best, BORDER if p in self.ends else INSIDE)
        return INSIDE if p in self.points else best

    def pieces(self, other: Shape, segments: list) -> list[Place]:
        """Middles of the pieces into which the other's segments and edges cut these ones, and their ends."""
        out = []
        cutters = [*other.segments, *other.edges]
        for a, b in segments:
            at = {a, b}
            for c, d in cutters:
                at.update(meets(a, b, c, d))
            at.update(p for p in other.points if on_segment(p, a, b))
            cut = sorted(at, key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
            out += [((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for p, q in pairwise(cut)] or [a]
            out += cut
        return out

    def inner_places(self, other: Shape) -> list[Place]:
        """A place inside each polygon, not on the other's edges, where there is one."""
        out = []
        for rings in self.polygons:
            ys = sorted({p[1] for r in rings for p in r} | {p[1] for e in other.edges for p in e})
            for lo, hi in pairwise(ys):
                y = (lo + hi) / 2
                xs = sorted({a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) for r in [*rings, *[r for q in other.polygons for r in q]] for a, b in pairwise(r) if (a[1] > y) != (b[1] > y)})
                out += [((p + q) / 2, y) for p, q in pairwise(xs) if in_rings(((p + q) / 2, y), rings) == INSIDE]
        return out


def intersects(a: Shape, b: Shape) -> bool:
    for x, y in ((a, b), (b, a)):
        probes = [*x.points, *[p for s in [*x.segments, *x.edges] for p in s]]
        if any(y.locate(p) != OUTSIDE for p in probes):
            return True
    return any(meets(*s, *t) for s in [*a.segments, *a.edges] for t in [*b.segments, *b.edges])


def covers(a: Shape, b: Shape) -> bool:
    """No place of b outside a."""
    probes = [*b.points, *b.pieces(a, [*b.segments, *b.edges]), *b.inner_places(a)]
    return bool(probes) and all(a.locate(p) != OUTSIDE for p in probes)


def contains(a: Shape, b: Shape) -> bool:
    """Covers, and the insides meet."""
    if not covers(a, b):
        return False
    probes = [*b.points, *[p for p in b.pieces(a, b.segments) if p not in b.ends], *b.inner_places(a)]
    return any(a.locate(p) == INSIDE for p in probes)


TESTS = {
    "intersects": intersects,
    "contains": contains,
    "containedby": lambda a, b: contains(b, a),
    "covers": covers,
    "coveredby": lambda a, b: covers(b, a),
}
