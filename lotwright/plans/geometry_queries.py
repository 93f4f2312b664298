"""Queries of the geometry expressions over boxes made from parts, each with its SQL in closed form."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.numbers import q6, q6_sql
from ..operators import zoning
from .reading import reader

QUERIES, SQL = {}, {}

BOX_SQL = "(SELECT p_partkey AS k, p_size AS s, CAST((p_partkey % 100) * 10 AS DOUBLE) AS x, CAST((p_partkey // 100 % 100) * 10 AS DOUBLE) AS y, CAST(1 + p_size AS DOUBLE) AS w, CAST(1 + p_size % 7 AS DOUBLE) AS h FROM part)"


def boxes(t):
    """k, s, x, y, w, h: a box for each part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return t("part").select(key.alias("k"), size.alias("s"), ((key % 100) * 10).cast("double").alias("x"), (F.floor(key / 100) % 100 * 10).cast("double").alias("y"), (size + 1).cast("double").alias("w"), (size % 7 + 1).cast("double").alias("h"))


def query(**columns):
    """Registers a function of the boxes; ``columns`` are the SQL of its result's numbers, besides k."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(boxes(reader(spark, sf_dir)))
        SQL[f.__name__] = f"SELECT k, {', '.join(f'{v} AS {c}' for c, v in columns.items())} FROM {BOX_SQL}"
        return f

    return put


class _Columns:
    """The boxes' columns and shapes made from them: a right trapezoid, a triangle, two segments and a hole."""

    def __getattr__(self, name):
        return F.col(name)

    @property
    def box(self):
        return g.box(self.x, self.y, self.w, self.h)

    @property
    def trapezoid(self):
        return g.ring(g.point(self.x, self.y), g.point(self.x + self.w, self.y), g.point(self.x + self.w + 1, self.y + self.h), g.point(self.x, self.y + self.h))

    @property
    def triangle(self):
        return g.ring(g.point(self.x, self.y), g.point(self.x + self.w, self.y), g.point(self.x, self.y + self.h))

    @property
    def line(self):
        return g.line(g.point(0, 0), g.point(self.w - 25.5, self.h - 3.5))

    @property
    def across(self):
        return g.line(g.point(self.x, self.y + self.h), g.point(self.x + self.w, self.y))

    @property
    def diagonal(self):
        return g.line(g.point(self.x, self.y), g.point(self.x + self.w, self.y + self.h))

    @property
    def hole(self):
        return g.reverse_ring(g.box(self.x + self.w / 4, self.y + self.h / 4, self.w / 2, self.h / 2))


c = _Columns()
_N = "sqrt((w - 25.5) * (w - 25.5) + (h - 3.5) * (h - 3.5))"
q = q6_sql


@query(n="4", total=q("4 * x + 2 * w + 4 * y + 2 * h"))
def wkt_parse(b):
    number = lambda c: c.cast("string")
    corner = lambda x, y: F.concat_ws(" ", number(x), number(y), F.lit("0"))
    text = F.concat(F.lit("MULTIPOLYGON Z (((" ), F.concat_ws(", ", corner(c.x, c.y), corner(c.x + c.w, c.y), corner(c.x + c.w, c.y + c.h), corner(c.x, c.y + c.h), corner(c.x, c.y)), F.lit(")))"))
    b = b.withColumn("shape", g.from_wkt(text))
    first = F.element_at("shape", 1)
    return b.select("k", F.size(first).alias("n"), q6(F.aggregate(first, F.lit(0.0), lambda a, p: a + p["x"] + p["y"])).alias("total"))


@query(area=q("h * (2 * w + 1) / 2"))
def polygon_area(b):
    return b.select("k", q6(g.polygon_area(F.array(c.trapezoid))).alias("area"))


@query(net=q("w * h * 0.75"), gross=q("w * h * 1.25"))
def polygon_signed_area(b):
    shape = F.array(c.box, c.hole)
    return b.select("k", q6(g.shape_area(shape)).alias("net"), q6(g.polygon_area(shape)).alias("gross"))


@query(direction="CASE WHEN s % 2 = 0 THEN -1 ELSE 1 END")
def orientation(b):
    return b.select("k", g.orientation(F.when(c.s % 2 == 0, g.reverse_ring(c.triangle)).otherwise(c.triangle)).alias("direction"))


@query(area=q("w * h / 2"))
def set_orientation(b):
    return b.select("k", q6(g.signed_area(g.with_orientation(F.when(c.s % 2 == 0, g.reverse_ring(c.triangle)).otherwise(c.triangle)))).alias("area"))


@query(x2=q("x + w * cos(s * 0.1) - h * sin(s * 0.1)"), y2=q("y + w * sin(s * 0.1) + h * cos(s * 0.1)"))
def box_rotate(b):
    p = F.element_at(g.rotate(c.box, c.s * 0.1, c.x, c.y), 3)
    return b.select("k", q6(p["x"]).alias("x2"), q6(p["y"]).alias("y2"))


@query(sx=q("2 * w"), sy=q("2 * h"))
def translate_local(b):
    r = g.localise(c.box)
    return b.select("k", q6(F.aggregate(r, F.lit(0.0), lambda a, p: a + p["x"])).alias("sx"), q6(F.aggregate(r, F.lit(0.0), lambda a, p: a + p["y"])).alias("sy"))


@query(cx=q("x + w / 3"), cy=q("y + h / 3"))
def centroid(b):
    return b.select("k", q6(g.centroid(c.triangle)["x"]).alias("cx"), q6(g.centroid(c.triangle)["y"]).alias("cy"))


@query(a=q("w"), b=q("sqrt(1 + h * h)"), c=q("w + 1"), d=q("h"), around=q("w + sqrt(1 + h * h) + w + 1 + h"))
def side_lengths(b):
    s = g.side_lengths(c.trapezoid)
    return b.select("k", *[q6(F.element_at(s, i + 1)).alias(n) for i, n in enumerate("abcd")], q6(g.perimeter(c.trapezoid)).alias("around"))


@query(a=q("pi() / 2"), b=q("pi() / 2 + atan(1 / h)"), c=q("atan(h)"), d=q("pi() / 2"))
def inner_angles(b):
    s = g.inner_angles(c.trapezoid)
    return b.select("k", *[q6(F.element_at(s, i + 1)).alias(n) for i, n in enumerate("abcd")])


@query(b=q("atan(h)"), c=q("pi()"), d=q("3 * pi() / 2"))
def outer_angles(b):
    s = g.outer_angles(c.trapezoid)
    return b.select("k", *[q6(F.element_at(s, i + 2)).alias(n) for i, n in enumerate("bcd")])


@query(angle=q("CASE WHEN atan2(h - 3.5, w - 25.5) < 0 THEN atan2(h - 3.5, w - 25.5) + 2 * pi() ELSE atan2(h - 3.5, w - 25.5) END"))
def line_angle(b):
    return b.select("k", q6(g.line_angle(c.line)).alias("angle"))


@query(longest=q("greatest(sqrt((w + 1) * (w + 1) + h * h), sqrt(w * w + h * h))"))
def vertex_distances(b):
    return b.select("k", q6(F.array_max(F.flatten(g.diagonals(c.trapezoid)))).alias("longest"))


@query(distance=q("sqrt((60 - w) * (60 - w) + 4.0)"), i="2", j="4")
def min_vertex_distance(b):
    d = g.min_vertex_distance(c.box, g.box(c.x + 60, c.y - 3, F.lit(5.0), F.lit(1.0)))
    return b.select("k", q6(d["distance"]).alias("distance"), d["i"].alias("i"), d["j"].alias("j"))


@query(convex="s % 2 = 0")
def convexity(b):
    dent = g.ring(g.point(c.x, c.y), g.point(c.x + c.w, c.y), g.point(c.x + c.w / 4, c.y + c.h / 4), g.point(c.x, c.y + c.h))
    return b.select("k", g.is_convex(F.when(c.s % 2 == 0, c.trapezoid).otherwise(dent)).alias("convex"))


@query(n="CAST(8 AS INTEGER)", x2=q("x + w + 5"))
def vertices_replaced(b):
    r = g.replace_vertex(c.box, 2, g.point(c.x + c.w + 5, c.y))
    return b.select("k", g.vertex_count(F.array(c.box, r)).alias("n"), q6(g.vertex(F.array(c.box, r), 2, 2)["x"]).alias("x2"))


_CROSS = "abs((w - 25.5) * 10 - (h - 3.5) * 7)"


@query(distance=q(f"{_CROSS} / {_N}"))
def point_line_dist(b):
    return b.select("k", q6(g.point_line_distance(g.point(7, 10), c.line)).alias("distance"))


@query(side="CASE WHEN (w - 25.5) * 10 - (h - 3.5) * 7 >= 0 THEN 1 ELSE -1 END")
def halfspace_sign(b):
    return b.select("k", g.halfspace_sign(g.point(7, 10), c.line).alias("side"))


@query(px=q("x + w / 2"), py=q("y + h / 2"))
def segment_intersection(b):
    p = g.intersect_segments(c.across, c.diagonal)
    return b.select("k", q6(p["x"]).alias("px"), q6(p["y"]).alias("py"))


@query(n="CAST(2 AS INTEGER)")
def polygon_crossings(b):
    """Sides of the box that a line through its middle crosses."""
    through = g.line(g.point(c.x - 1, c.y + c.h / 2), g.point(c.x + c.w + 1, c.y + c.h / 2))
    hits = F.filter(F.transform(g.sides(c.box), lambda s: g.intersect_segments(s, through)), lambda p: p.isNotNull())
    return b.select("k", F.size(hits).alias("n"))


@query(x0=q(f"0 - (w - 25.5) / {_N} * 3"), y1=q(f"h - 3.5 + (h - 3.5) / {_N} * 3"), length=q(f"{_N} + 6"))
def extend_line(b):
    l = g.extend_line(c.line, 3.0)  # noqa: E741
    return b.select("k", q6(F.element_at(l, 1)["x"]).alias("x0"), q6(F.element_at(l, 2)["y"]).alias("y1"), q6(g.line_length(l)).alias("length"))


_T = f"greatest(0.0, least(1.0, ((w - 25.5) * 7 + (h - 3.5) * 10) / ({_N} * {_N})))"


@query(px=q(f"{_T} * (w - 25.5)"), py=q(f"{_T} * (h - 3.5)"))
def project_point(b):
    p = g.project_point(g.point(7, 10), c.line)
    return b.select("k", q6(p["x"]).alias("px"), q6(p["y"]).alias("py"))


@query(parallel="s % 3 = 0", apart=q("CASE WHEN s % 3 = 0 THEN h ELSE 10000.0 END"))
def parallel_test(b):
    low = g.line(g.point(c.x, c.y), g.point(c.x + c.w, c.y))
    high = g.line(g.point(c.x + c.w, c.y + c.h), g.point(c.x, F.when(c.s % 3 == 0, c.y + c.h).otherwise(c.y + c.h + c.w)))
    return b.select("k", g.is_parallel(low, high).alias("parallel"), q6(g.distance_between_lines(low, high)).alias("apart"))


@query(x0=q("x - h / 0.49"), x1=q("x + h / 0.49"), y2=q("y - h / 1.54"))
def shadow_shift(b):
    first = lambda r: F.element_at(r, 1)
    return b.select("k", q6(first(g.shadow_shift(c.box, c.h, "p"))["x"]).alias("x0"), q6(first(g.shadow_shift(c.box, c.h, "o"))["x"]).alias("x1"), q6(first(g.shadow_shift(c.box, c.h, "s"))["y"]).alias("y2"))


@query(area=q(f"{_N} * 2.5"))
def line_box(b):
    return b.select("k", q6(g.signed_area(g.line_box(c.line, 2.5))).alias("area"))


@query(dx=q(f"-(h - 3.5) / {_N} * 4"), gap=q("CAST(4 AS DOUBLE)"))
def parallel_line(b):
    l = g.parallel_line(c.line, 4.0)  # noqa: E741
    return b.select("k", q6(F.element_at(l, 1)["x"]).alias("dx"), q6(g.line_line_distance(c.line, l)).alias("gap"))


@query(angle=q("acos(w / sqrt(w * w + h * h))"), bx=q("cos(atan2(h, w) / 2)"), mx=q("x + w * 0.25"))
def line_helpers(b):
    flat = g.line(g.point(c.x, c.y), g.point(c.x + c.w, c.y))
    return b.select("k", q6(g.angle_between(flat, c.diagonal)).alias("angle"), q6(g.bisector(flat, c.diagonal)["x"]).alias("bx"), q6(g.along(flat, 0.25)["x"]).alias("mx"))


@query(x1=q("x + cos(s * 0.2) * w"), back=q("x"))
def line_from_angle(b):
    l = g.line_from(g.point(c.x, c.y), c.s * 0.2, c.w)  # noqa: E741
    return b.select("k", q6(F.element_at(l, 2)["x"]).alias("x1"), q6(F.element_at(g.reverse_line(l), 2)["x"]).alias("back"))


@query(inside="10 < w AND 2.5 < h")
def point_in_ring(b):
    return b.select("k", g.contains_point(c.box, g.point(c.x + 10, c.y + 2.5)).alias("inside"))


@query(area=q("9 * w * h"), moved=q("x + y + 3"))
def vector_algebra(b):
    return b.select("k", q6(g.signed_area(g.scale(c.box, 3.0))).alias("area"), q6(F.element_at(g.translate(c.box, 1.0, 2.0), 1)["x"] + F.element_at(g.translate(c.box, 1.0, 2.0), 1)["y"]).alias("moved"))


@query(largest=q("greatest(w * h, 40.0)"), total=q("w * h + 40"))
def region_areas(b):
    shape = F.array(c.box, g.box(c.x, c.y + 500, 10, 4))
    return b.select("k", q6(g.signed_area(g.largest_region(shape))).alias("largest"), q6(F.aggregate(g.region_areas(shape), F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query(text="concat('POLYGON ((', x, ' ', y, ', ', x + w, ' ', y, ', ', x + w, ' ', y + h, ', ', x, ' ', y + h, ', ', x, ' ', y, '))')")
def wkt_write(b):
    return b.select("k", g.to_wkt(c.box).alias("text"))


def _utm_sql() -> tuple[str, str]:
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    e2 = f * (2 - f)
    ep2, e1 = e2 / (1 - e2), (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = f"((y * 100 + 6200000 - 1e7) / {k0!r} / {a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)!r})"
    phi = f"({mu} + {3 * e1 / 2 - 27 * e1**3 / 32!r} * sin({mu} * 2) + {21 * e1**2 / 16 - 55 * e1**4 / 32!r} * sin({mu} * 4) + {151 * e1**3 / 96!r} * sin({mu} * 6) + {1097 * e1**4 / 512!r} * sin({mu} * 8))"
    inner = f"SELECT k, x, {phi} AS phi FROM {BOX_SQL}"
    second = f"SELECT k, phi, tan(phi) AS t, cos(phi) AS c, {ep2!r} * cos(phi) * cos(phi) AS c1, 1 - {e2!r} * sin(phi) * sin(phi) AS v, x FROM ({inner})"
    third = f"SELECT *, {a!r} / sqrt(v) AS n1, {a * (1 - e2)!r} / (v * sqrt(v)) AS r1, (x * 100 + 300000 - 500000.0) / ({a!r} / sqrt(v) * {k0!r}) AS d FROM ({second})"
    lat = f"degrees(phi - n1 * t / r1 * (d*d/2 - (5 + 3*t*t + 10*c1 - 4*c1*c1 - {9 * ep2!r}) * d*d*d*d/24 + (61 + 90*t*t + 298*c1 + 45*t*t*t*t - {252 * ep2!r} - 3*c1*c1) * d*d*d*d*d*d/720))"
    lon = f"degrees((d - (1 + 2*t*t + c1) * d*d*d/6 + (5 - 2*c1 + 28*t*t - 3*c1*c1 + {8 * ep2!r} + 24*t*t*t*t) * d*d*d*d*d/120) / c) - 69"
    return f"SELECT k, {q(lon)} AS lon, {q(lat)} AS lat FROM ({third})", third


def utm_to_wgs84(b):
    p = g.utm_to_degrees(g.point(c.x * 100 + 300000, c.y * 100 + 6200000))
    return b.select("k", q6(p["x"]).alias("lon"), q6(p["y"]).alias("lat"))


QUERIES["utm_to_wgs84"] = lambda spark, sf_dir: utm_to_wgs84(boxes(reader(spark, sf_dir)))
SQL["utm_to_wgs84"] = _utm_sql()[0]


@query(dx=q("CAST(0 AS DOUBLE)"), dy=q("CAST(0 AS DOUBLE)"))
def utm_round_trip(b):
    grid = g.point(c.x * 100 + 300000, c.y * 100 + 6200000)
    b = b.withColumn("degrees", g.utm_to_degrees(grid))
    back = g.degrees_to_utm(F.col("degrees"))
    millimetres = lambda a, c: (F.floor(F.abs(a - c) * 1000 + 0.5) / 1e6).cast("double")
    return b.select("k", millimetres(back["x"], grid["x"]).alias("dx"), millimetres(back["y"], grid["y"]).alias("dy"))


@query(x0=q("x + 2 + 0.5 * (s % 4)"))
def slice_interpolation(b):
    slices = F.array(*[F.struct(F.lit(float(z)).alias("height"), g.box(c.x + z, c.y, c.w, c.h).alias("ring")) for z in (0, 2, 4)])
    return b.select("k", q6(F.element_at(zoning.slice_at(slices, (c.s % 4) * 0.5 + 2), 1)["x"]).alias("x0"))


@query(radius=q("least(140.0, (s % 12) * 2.65 * 2.7474774194546216)"), dwellings=q("s * 10 / 4.0 * w * h * 100 / 10000.0"), far=q("CASE WHEN s % 3 = 0 THEN w * h ELSE (s % 3) * 0.5 * w * h END"), gross=q("(w + 5) * h / (w * h) * (w * h + 1)"))
def zoning_limits(b):
    return b.select(
        "k",
        q6(zoning.context_radius(c.s % 12, F.lit(2.65))).alias("radius"),
        q6(zoning.max_dwellings(c.s * 10, c.w * c.h * 100)).alias("dwellings"),
        q6(zoning.limit_or((c.s % 3) * 0.5, c.w * c.h, c.w * c.h)).alias("far"),
        q6(zoning.gross_area((c.w + 5) * c.h, c.w * c.h, c.w * c.h + 1)).alias("gross"),
    )


@query(factor="CASE WHEN s % 2 = 0 THEN 1.3 ELSE 1.0 END::DOUBLE")
def fusion_bonus(b):
    lots = F.when(c.s % 2 == 0, F.array(F.col("k"), F.col("k") + 1)).otherwise(F.array(F.col("k")))
    return b.select("k", zoning.fusion_factor(lots).cast("double").alias("factor"))
