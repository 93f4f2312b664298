"""Planar geometry as Column expressions.

A ring is an array of structs (x, y), open (its first vertex isn't repeated); a
shape is an array of rings; a line is an array of two points. Nothing here
leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
SHAPE = f"array<{RING}>"
#: Directions closer than this are parallel, in radians.
PARALLEL = 0.0015


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def ring(*points: Column) -> Column:
    return F.array(*points)


def box(x, y, width, height) -> Column:
    """A counter-clockwise rectangle from its lower left corner."""
    x, y, width, height = (F.lit(v) for v in (x, y, width, height))
    return ring(point(x, y), point(x + width, y), point(x + width, y + height), point(x, y + height))


def line(a: Column, b: Column) -> Column:
    return F.array(a, b)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; nested expressions would repeat it at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def following(r: Column) -> Column:
    """The ring turned by one vertex."""
    return let(r, lambda v: F.when(F.size(v) > 1, F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))).otherwise(v))


def by_side(r: Column, body) -> Column:
    """``body`` of each vertex and the next, as an array; the ring is computed once, however long its expression."""
    return let(r, lambda v: F.zip_with(v, following(v), body))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(r: Column) -> Column:
    """Positive for counter-clockwise rings."""
    return _sum(by_side(r, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def polygon_area(shape: Column) -> Column:
    """The sum of the rings' absolute areas: holes add."""
    return _sum(F.transform(shape, lambda r: F.abs(signed_area(r))))


def shape_area(shape: Column) -> Column:
    """Counter-clockwise rings add, clockwise ones subtract."""
    return _sum(F.transform(shape, signed_area))


def region_areas(shape: Column) -> Column:
    return F.transform(shape, lambda r: F.abs(signed_area(r)))


def largest_region(shape: Column) -> Column:
    return F.element_at(F.sort_array(F.transform(shape, lambda r: F.struct(F.abs(signed_area(r)).alias("area"), r.alias("ring"))), asc=False), 1)["ring"]


def orientation(r: Column) -> Column:
    """1 counter-clockwise, -1 otherwise (degenerate rings too)."""
    turn = _sum(by_side(r, lambda a, b: (b["x"] - a["x"]) * (b["y"] + a["y"])))
    return F.when(turn < 0, 1).otherwise(-1)


def reverse_ring(r: Column) -> Column:
    return F.reverse(r)


def with_orientation(r: Column, direction: int = 1) -> Column:
    return let(r, lambda v: F.when(orientation(v) == direction, v).otherwise(F.reverse(v)))


def translate(r: Column, dx, dy) -> Column:
    return F.transform(r, lambda p: point(p["x"] + dx, p["y"] + dy))


def scale(r: Column, factor) -> Column:
    return F.transform(r, lambda p: point(p["x"] * factor, p["y"] * factor))


def rotate(r: Column, angle, cx=0.0, cy=0.0) -> Column:
    """Turned by ``angle`` radians around (cx, cy)."""
    angle, cx, cy = F.lit(angle), F.lit(cx), F.lit(cy)
    c, s = F.cos(angle), F.sin(angle)
    return F.transform(r, lambda p: point(cx + (p["x"] - cx) * c - (p["y"] - cy) * s, cy + (p["x"] - cx) * s + (p["y"] - cy) * c))


def bounds(r: Column) -> Column:
    values = lambda v: F.struct(F.transform(v, lambda p: p["x"]).alias("xs"), F.transform(v, lambda p: p["y"]).alias("ys"))
    ends = lambda c: F.struct(F.array_min(c["xs"]).alias("x0"), F.array_min(c["ys"]).alias("y0"), F.array_max(c["xs"]).alias("x1"), F.array_max(c["ys"]).alias("y1"))
    return let(let(r, values), ends)


def localise(r: Column) -> Column:
    """The ring with its bounds' lower left corner at the origin."""
    return let(r, lambda v: let(bounds(v), lambda b: translate(v, -b["x0"], -b["y0"])))


def centroid(r: Column) -> Column:
    cross = by_side(r, lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))

    def middle(cs: Column) -> Column:
        area6 = _sum(F.transform(cs, lambda t: t["c"])) / 2 * 6
        return let(area6, lambda a: point(_sum(F.transform(cs, lambda t: t["c"] * t["x"])) / a, _sum(F.transform(cs, lambda t: t["c"] * t["y"])) / a))

    return let(cross, middle)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def side_lengths(r: Column) -> Column:
    """Side i goes from vertex i to the next."""
    return by_side(r, distance)


def perimeter(r: Column) -> Column:
    return _sum(side_lengths(r))


def _turn(value: Column) -> Column:
    """An angle in [0, 2 pi)."""
    return F.pmod(value, F.lit(2 * math.pi))


def direction(a: Column, b: Column) -> Column:
    return _turn(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def line_angle(l: Column) -> Column:  # noqa: E741
    return direction(F.get(l, F.lit(0)), F.get(l, F.lit(1)))


def outer_angles(r: Column) -> Column:
    """The direction of each side."""
    return by_side(r, direction)


def inner_angles(r: Column) -> Column:
    """The angle inside a counter-clockwise ring at the start of each side."""

    def angles(v: Column) -> Column:
        n = F.size(v)
        own = lambda i: F.get(v, F.pmod(i, n))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: _turn(direction(own(i), own(i + n - 1)) - direction(own(i), own(i + 1))))

    return let(r, angles)


def diagonals(r: Column) -> Column:
    """The matrix of distances between vertices."""
    return let(r, lambda v: F.transform(v, lambda a: F.transform(v, lambda b: distance(a, b))))


def point_distances(a: Column, b: Column) -> Column:
    return let(b, lambda v: F.transform(a, lambda p: F.transform(v, lambda q: distance(p, q))))


def min_vertex_distance(a: Column, b: Column) -> Column:
    """The least distance between vertices of two rings, with their places (from 1)."""
    pairs = lambda v: F.flatten(F.transform(a, lambda p, i: F.transform(v, lambda q, j: F.struct(distance(p, q).alias("distance"), (i + 1).alias("i"), (j + 1).alias("j")))))
    return F.array_min(let(b, pairs))


def sides(r: Column) -> Column:
    return by_side(r, line)


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def is_convex(r: Column) -> Column:

    def turns(v: Column) -> Column:
        n = F.size(v)
        own = lambda i: F.get(v, F.pmod(i, n))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.signum(_cross(own(i), own(i + 1), own(i + 2))))

    return let(let(r, turns), lambda ts: F.forall(ts, lambda t: t >= 0) | F.forall(ts, lambda t: t <= 0))


def sub_shape(shape: Column, first: int, count: int = 1) -> Column:
    return F.slice(shape, first, count)


def vertex(shape: Column, region: int, place: int) -> Column:
    return F.element_at(F.element_at(shape, region), place)


def vertex_count(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(0), lambda a, r: a + F.size(r))


def replace_vertex(r: Column, place, new: Column) -> Column:
    return F.transform(r, lambda p, i: F.when(i == F.lit(place) - 1, new).otherwise(p))


def point_line_distance(p: Column, l: Column) -> Column:  # noqa: E741
    """To the infinite line."""
    a, b = F.get(l, F.lit(0)), F.get(l, F.lit(1))
    return F.abs(_cross(a, b, p)) / distance(a, b)


def halfspace_sign(p: Column, l: Column) -> Column:  # noqa: E741
    """1 left of the line, -1 right of it, 0 if the line has no length."""
    a, b = F.get(l, F.lit(0)), F.get(l, F.lit(1))
    return F.when(distance(a, b) == 0, 0).when(_cross(a, b, p) >= 0, 1).otherwise(-1)


def mid_point(l: Column) -> Column:  # noqa: E741
    return along(l, 0.5)


def along(l: Column, alpha) -> Column:  # noqa: E741
    a, b = F.get(l, F.lit(0)), F.get(l, F.lit(1))
    return point(a["x"] + (b["x"] - a["x"]) * alpha, a["y"] + (b["y"] - a["y"]) * alpha)


def line_line_distance(l1: Column, l2: Column) -> Column:
    """Signed distance of l2's middle from the line of l1."""
    given = F.struct(mid_point(l2).alias("p"), l1.alias("l"))
    return let(given, lambda v: point_line_distance(v["p"], v["l"]) * halfspace_sign(v["p"], v["l"]))


def parallel_line(l: Column, dist) -> Column:  # noqa: E741
    """Moved by ``dist`` to the left of its direction."""
    ends = F.struct(F.get(l, F.lit(0)).alias("a"), F.get(l, F.lit(1)).alias("b"), F.lit(dist).cast("double").alias("dist"))

    def shift(v: Column) -> Column:
        a, b = v["a"], v["b"]
        by = lambda n: F.struct(v.alias("v"), (-(b["y"] - a["y"]) / n * v["dist"]).alias("dx"), ((b["x"] - a["x"]) / n * v["dist"]).alias("dy"))
        return let(distance(a, b), by)

    moved = lambda s: line(point(s["v"]["a"]["x"] + s["dx"], s["v"]["a"]["y"] + s["dy"]), point(s["v"]["b"]["x"] + s["dx"], s["v"]["b"]["y"] + s["dy"]))
    return let(let(ends, shift), moved)


def line_from(p: Column, angle, length) -> Column:
    angle = F.lit(angle)
    return line(p, point(p["x"] + F.cos(angle) * length, p["y"] + F.sin(angle) * length))


def reverse_line(l: Column) -> Column:  # noqa: E741
    return F.reverse(l)


def line_length(l: Column) -> Column:  # noqa: E741
    return distance(F.get(l, F.lit(0)), F.get(l, F.lit(1)))


def extend_line(l: Column, dist) -> Column:  # noqa: E741
    """Longer by ``dist`` at both ends."""
    a, b = F.get(l, F.lit(0)), F.get(l, F.lit(1))
    n = distance(a, b)
    dx, dy = (b["x"] - a["x"]) / n * dist, (b["y"] - a["y"]) / n * dist
    return line(point(a["x"] - dx, a["y"] - dy), point(b["x"] + dx, b["y"] + dy))


def intersect_segments(l1: Column, l2: Column, tolerance: float = 1e-3) -> Column:
    """The crossing point of two segments, or null; ends may miss by ``tolerance``."""
    a, b, c, d = F.get(l1, F.lit(0)), F.get(l1, F.lit(1)), F.get(l2, F.lit(0)), F.get(l2, F.lit(1))
    rx, ry, sx, sy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    den = rx * sy - ry * sx
    t = ((c["x"] - a["x"]) * sy - (c["y"] - a["y"]) * sx) / F.nullif(den, F.lit(0.0))
    u = ((c["x"] - a["x"]) * ry - (c["y"] - a["y"]) * rx) / F.nullif(den, F.lit(0.0))
    near = lambda v, n: v.between(-tolerance / n, 1 + tolerance / n)
    return F.when(near(t, F.greatest(distance(a, b), F.lit(1e-12))) & near(u, F.greatest(distance(c, d), F.lit(1e-12))), point(a["x"] + t * rx, a["y"] + t * ry))


def project_point(p: Column, l: Column) -> Column:  # noqa: E741
    """The nearest point of a segment."""
    a, b = F.get(l, F.lit(0)), F.get(l, F.lit(1))
    n2 = (b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])
    t = ((p["x"] - a["x"]) * (b["x"] - a["x"]) + (p["y"] - a["y"]) * (b["y"] - a["y"])) / F.nullif(n2, F.lit(0.0))
    return along(l, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0)))))


def perpendicular_line(p: Column, l: Column) -> Column:  # noqa: E741
    return line(p, project_point(p, l))


def is_parallel(l1: Column, l2: Column) -> Column:
    """Within PARALLEL radians, in either direction."""
    gap = F.pmod(line_angle(l1) - line_angle(l2), F.lit(math.pi))
    return F.least(gap, F.lit(math.pi) - gap) <= PARALLEL


def distance_between_lines(l1: Column, l2: Column, apart: float = 10000.0) -> Column:
    """Of parallel lines; ``apart`` of others."""
    return F.when(is_parallel(l1, l2), point_line_distance(mid_point(l2), l1)).otherwise(apart)


def angle_between(l1: Column, l2: Column) -> Column:
    a, b, c, d = F.get(l1, F.lit(0)), F.get(l1, F.lit(1)), F.get(l2, F.lit(0)), F.get(l2, F.lit(1))
    dot = (b["x"] - a["x"]) * (d["x"] - c["x"]) + (b["y"] - a["y"]) * (d["y"] - c["y"])
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (distance(a, b) * distance(c, d)))))


def bisector(l1: Column, l2: Column) -> Column:
    """The direction half way between two lines', as a unit vector."""
    a, b = line_angle(l1), line_angle(l2)
    x, y = F.cos(a) + F.cos(b), F.sin(a) + F.sin(b)
    n = F.sqrt(x * x + y * y)
    return point(x / n, y / n)


def line_box(l: Column, width) -> Column:  # noqa: E741
    """A rectangle of ``width`` around a segment."""
    left, right = parallel_line(l, F.lit(width) / 2), parallel_line(l, F.lit(width) / -2)
    return F.array(F.get(right, F.lit(0)), F.get(right, F.lit(1)), F.get(left, F.lit(1)), F.get(left, F.lit(0)))


def shadow_shift(r: Column, height, towards: str) -> Column:
    """A ring's shadow at one of three hours: "p" west, "o" east, else south; the shifts per height are fixed values."""
    per = {"p": (-1 / 0.49, 0.0), "o": (1 / 0.49, 0.0)}.get(towards, (0.0, -1 / 1.54))
    return translate(r, F.lit(height) * per[0], F.lit(height) * per[1])


def contains_point(r: Column, p: Column) -> Column:
    """By the even-odd rule."""

    def crossings(q: Column) -> Column:
        left = lambda a, b: q["x"] < (b["x"] - a["x"]) * (q["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return by_side(r, lambda a, b: F.when(((a["y"] > q["y"]) != (b["y"] > q["y"])) & left(a, b), 1).otherwise(0))

    return F.aggregate(let(p, crossings), F.lit(0), lambda a, v: a + v) % 2 == 1


def in_shape(shape: Column, p: Column) -> Column:
    """By the even-odd rule over all rings."""
    return F.aggregate(shape, F.lit(0), lambda a, r: a + contains_point(r, p).cast("int")) % 2 == 1


def segment_distance(l1: Column, l2: Column) -> Column:
    """Of two segments; 0 where they cross or touch."""
    a, b, c, d = F.get(l1, F.lit(0)), F.get(l1, F.lit(1)), F.get(l2, F.lit(0)), F.get(l2, F.lit(1))
    crossing = (_cross(a, b, c) * _cross(a, b, d) < 0) & (_cross(c, d, a) * _cross(c, d, b) < 0)
    gap = lambda p, l: let(project_point(p, l), lambda q: distance(p, q))  # noqa: E731, E741
    return F.when(crossing, 0.0).otherwise(F.least(gap(a, l2), gap(b, l2), gap(c, l1), gap(d, l1)))


def shape_distance(a: Column, b: Column) -> Column:
    """The least distance of two shapes' points; 0 where they meet or one holds the other. Null if either is null or empty."""
    first = lambda s: F.get(F.get(s, F.lit(0)), F.lit(0))
    all_sides = lambda s: F.flatten(F.transform(s, sides))
    gaps = let(all_sides(b), lambda others: F.array_min(F.transform(all_sides(a), lambda l1: F.array_min(F.transform(others, lambda l2: segment_distance(l1, l2))))))
    return F.when(in_shape(a, first(b)) | in_shape(b, first(a)), 0.0).otherwise(gaps)


def meets_box(l: Column, x: Column, y: Column, half: Column) -> Column:  # noqa: E741
    """Whether a segment meets the square around (x, y) with sides of twice ``half``."""
    a, b = F.get(l, F.lit(0)), F.get(l, F.lit(1))
    dx, dy = (b["x"] - a["x"]) / 2, (b["y"] - a["y"]) / 2
    mx, my = x - (a["x"] + b["x"]) / 2, y - (a["y"] + b["y"]) / 2
    return (F.abs(mx) <= half + F.abs(dx)) & (F.abs(my) <= half + F.abs(dy)) & (F.abs(dx * my - dy * mx) <= half * (F.abs(dx) + F.abs(dy)))


def from_wkt(text: Column) -> Column:
    """The outer rings of a (multi)polygon's or the points of a line's text, open, without heights."""
    outer = F.regexp_extract_all(text, F.lit(r"(?:^[A-Za-z ]*\(+|\(\()([^()]*)\)"), 1)
    points = lambda t: F.transform(F.split(F.trim(t), r"\s*,\s*"), lambda c: point(F.element_at(F.split(c, r"\s+"), 1).cast("double"), F.element_at(F.split(c, r"\s+"), 2).cast("double")))
    closed = lambda r: (F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1))
    return F.transform(outer, lambda t: F.when(closed(points(t)), F.slice(points(t), 1, F.size(points(t)) - 1)).otherwise(points(t)))


def lines_from_wkt(text: Column) -> Column:
    """The lines of a (multi)line's text as arrays of points, without heights; closed ones keep their last point."""
    points = lambda t: F.transform(F.split(F.trim(t), r"\s*,\s*"), lambda c: point(F.element_at(F.split(c, r"\s+"), 1).cast("double"), F.element_at(F.split(c, r"\s+"), 2).cast("double")))
    return F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), 1), points)


def to_wkt(r: Column) -> Column:
    texts = F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(texts, ", "), F.lit("))"))


# UTM on the GRS80 ellipsoid. The grids' datum is taken as equal to WGS 84: an
# error of metres at most.
_A, _F, _K0 = 6378137.0, 1 / 298.257222101, 0.9996
_E2 = _F * (2 - _F)
_EP2 = _E2 / (1 - _E2)


def utm_to_degrees(p: Column, zone: int = 19, south: bool = True) -> Column:
    """(x, y) = (longitude, latitude), by the series of the inverse projection."""
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    m = (p["y"] - (1e7 if south else 0.0)) / _K0
    mu = m / (_A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(mu * 2) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(mu * 4) + (151 * e1**3 / 96) * F.sin(mu * 6) + (1097 * e1**4 / 512) * F.sin(mu * 8)
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    c1, t1 = c * c * _EP2, t * t
    w = F.lit(1.0) - s * s * _E2
    n1, r1 = F.lit(_A) / F.sqrt(w), F.lit(_A * (1 - _E2)) / (w * F.sqrt(w))
    d = (p["x"] - 500000.0) / (n1 * _K0)
    d2 = d * d
    lat = phi - n1 * t / r1 * (d2 / 2 - (t1 * 3 + c1 * 10 - c1 * c1 * 4 - 9 * _EP2 + 5) * d2 * d2 / 24 + (t1 * 90 + c1 * 298 + t1 * t1 * 45 - 252 * _EP2 - c1 * c1 * 3 + 61) * d2 * d2 * d2 / 720)
    lon = (d - (t1 * 2 + c1 + 1) * d2 * d / 6 + (F.lit(5.0) - c1 * 2 + t1 * 28 - c1 * c1 * 3 + 8 * _EP2 + t1 * t1 * 24) * d2 * d2 * d / 120) / c
    return point(F.degrees(lon) + (zone * 6 - 183), F.degrees(lat))


def degrees_to_utm(p: Column, zone: int = 19, south: bool = True) -> Column:
    phi, lam = F.radians(p["y"]), F.radians(p["x"] - (zone * 6 - 183))
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    n = F.lit(_A) / F.sqrt(F.lit(1.0) - s * s * _E2)
    t1, c1, a = t * t, c * c * _EP2, lam * c
    a2 = a * a
    m = (phi * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256) - F.sin(phi * 2) * (3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024) + F.sin(phi * 4) * (15 * _E2**2 / 256 + 45 * _E2**3 / 1024) - F.sin(phi * 6) * (35 * _E2**3 / 3072)) * _A
    x = n * _K0 * (a + (F.lit(1.0) - t1 + c1) * a2 * a / 6 + (F.lit(5.0) - t1 * 18 + t1 * t1 + c1 * 72 - 58 * _EP2) * a2 * a2 * a / 120) + 500000.0
    y = (m + n * t * (a2 / 2 + (F.lit(5.0) - t1 + c1 * 9 + c1 * c1 * 4) * a2 * a2 / 24 + (F.lit(61.0) - t1 * 58 + t1 * t1 + c1 * 600 - 330 * _EP2) * a2 * a2 * a2 / 720)) * _K0
    return point(x, y + (1e7 if south else 0.0))


def reproject(r: Column, dx=0.0, dy=0.0, zone: int = 19) -> Column:
    """A ring from its local origin back to the grid, then to degrees."""
    return F.transform(translate(r, dx, dy), lambda p: utm_to_degrees(p, zone))
