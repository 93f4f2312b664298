"""Clipping, buffers and hulls of rings as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g
from .geometry import let


def half_planes(r: Column, lines: Column) -> Column:
    """The part of a ring to the left of all lines of an array; empty if there is none.

    One line after another: ``r`` may be of any form, but parts that fall asunder
    stay joined by pieces along the lines, which have no area.
    """

    def half(ring: Column, side: Column) -> Column:
        p, q = F.get(side, F.lit(0)), F.get(side, F.lit(1))
        way = F.struct(p["x"].alias("x"), p["y"].alias("y"), (q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy"))
        # Corners with how far left of the line they lie.
        marked = let(way, lambda w: F.transform(ring, lambda v: F.struct(v.alias("p"), (w["dx"] * (v["y"] - w["y"]) - w["dy"] * (v["x"] - w["x"])).alias("left"))))

        def step(a: Column, b: Column) -> Column:
            at = lambda k: g.point(a["p"]["x"] + (b["p"]["x"] - a["p"]["x"]) * k, a["p"]["y"] + (b["p"]["y"] - a["p"]["y"]) * k)
            x = let(a["left"] / (a["left"] - b["left"]), at)
            own = F.array(a["p"])
            return F.when((a["left"] >= 0) & (b["left"] >= 0) | (a["left"] == 0), own).when(a["left"] > 0, F.concat(own, F.array(x))).when(b["left"] > 0, F.array(x)).otherwise(F.slice(own, 1, 0))

        return let(marked, lambda m: F.flatten(F.zip_with(m, g.following(m), step)))

    return F.aggregate(lines, r, half)


def convex_clip(r: Column, clip: Column) -> Column:
    """The part of a ring in a convex counter-clockwise one."""
    return half_planes(r, g.sides(clip))


def moved_sides(r: Column, dists: Column) -> Column:
    """The lines of a counter-clockwise ring's sides, each moved out by its own distance."""
    return F.zip_with(g.sides(r), dists, lambda side, d: g.parallel_line(side, -d))


def convex_offset(r: Column, dists: Column) -> Column:
    """A convex counter-clockwise ring with each side moved out (in, if negative) by its own distance, corners mitred.

    Sides that vanish go; nothing left is an empty ring. Sharp corners end at
    eight times the greatest distance from the ring's bounds.
    """

    def around(b: Column, far: Column) -> Column:
        low, size = F.struct((b["x0"] - far).alias("x"), (b["y0"] - far).alias("y")), F.struct((b["x1"] - b["x0"] + far * 2).alias("x"), (b["y1"] - b["y0"] + far * 2).alias("y"))
        return let(F.struct(low.alias("low"), size.alias("size")), lambda v: g.box(v["low"]["x"], v["low"]["y"], v["size"]["x"], v["size"]["y"]))

    def offset(v: Column) -> Column:
        far = F.greatest(F.array_max(F.transform(v["dists"], F.abs)) * 8, F.lit(1.0))
        return half_planes(let(g.bounds(v["r"]), lambda b: let(far, lambda f: around(b, f))), moved_sides(v["r"], v["dists"]))

    return let(F.struct(r.alias("r"), dists.alias("dists")), offset)


def convex_inset(r: Column, within: Column, dist: Column) -> Column:
    """The part of ``r`` that is at least ``dist`` inside the sides of a convex counter-clockwise ring."""
    return half_planes(r, let(dist, lambda d: F.transform(g.sides(within), lambda side: g.parallel_line(side, d))))


def convex_shrink(r: Column, ratio: Column, rounds: int = 48) -> Column:
    """A convex counter-clockwise ring moved in until its area is ``ratio`` of what it was, by ``rounds`` halvings."""
    given = F.struct(r.alias("r"), g.bounds(r).alias("b"), (g.signed_area(r) * ratio).alias("area"))

    def found(x: Column) -> Column:
        b = x["b"]
        start = F.struct(F.lit(0.0).alias("low"), (F.least(b["x1"] - b["x0"], b["y1"] - b["y0"]) / 2).alias("high"))

        def halve(s: Column, _: Column) -> Column:
            def choose(m: Column) -> Column:
                more = let(convex_inset(x["r"], x["r"], m), g.signed_area) > x["area"]
                return F.struct(F.when(more, m).otherwise(s["low"]).alias("low"), F.when(more, s["high"]).otherwise(m).alias("high"))

            return let((s["low"] + s["high"]) / 2, choose)

        return convex_inset(x["r"], x["r"], F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)["low"])

    return let(given, found)


def convex_buffer(r: Column, dist, segments: int = 8) -> Column:
    """The round buffer of a convex counter-clockwise ring: sides move out by ``dist``, corners get ``segments`` chords a quarter."""
    dist = F.lit(dist)

    def corners(ring: Column) -> Column:
        n = F.size(ring)
        own = lambda i: F.get(ring, F.pmod(i, n))

        def corner(i: Column) -> Column:
            before, after = g.direction(own(i + n - 1), own(i)), g.direction(own(i), own(i + 1))
            return let(F.struct(before.alias("before"), F.pmod(after - before, F.lit(2 * math.pi)).alias("turn"), own(i).alias("p")), arc)

        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), corner))

    def arc(v: Column) -> Column:
        steps = F.greatest(F.ceil(v["turn"] / (math.pi / 2 / segments) - 1e-9), F.lit(1)).cast("int")
        at = lambda k: v["before"] - math.pi / 2 + v["turn"] * k / steps
        return F.transform(F.sequence(F.lit(0), steps), lambda k: let(at(k), lambda w: g.point(v["p"]["x"] + dist * F.cos(w), v["p"]["y"] + dist * F.sin(w))))

    return let(r, corners)


def _span(low: Column, high: Column) -> Column:
    return F.struct(low.alias("low"), high.alias("high"))


def spans_near(l: Column, r: Column, dist) -> Column:  # noqa: E741
    """The stretches (low, high; lengths from the segment's start) of a segment at most ``dist`` from a ring of any form or in it, in order and apart."""
    dist = F.lit(float(dist)) if not isinstance(dist, Column) else dist

    def framed(v: Column) -> Column:
        a, b, size = v["a"], v["b"], v["size"]
        frame = F.struct(a["x"].alias("x"), a["y"].alias("y"), ((b["x"] - a["x"]) / size).alias("ux"), ((b["y"] - a["y"]) / size).alias("uy"), size.alias("size"), dist.alias("dist"))
        return F.when(size > 0, let(frame, lambda s: _spans(s, r)))

    ends = let(l, lambda v: F.struct(F.get(v, F.lit(0)).alias("a"), F.get(v, F.lit(1)).alias("b")))
    return let(let(ends, lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"), g.distance(v["a"], v["b"]).alias("size"))), framed)


def _spans(s: Column, r: Column) -> Column:
    dist, size = s["dist"], s["size"]
    # The ring in the segment's frame: t along it, h aside.
    there = F.transform(r, lambda p: F.struct(((p["x"] - s["x"]) * s["ux"] + (p["y"] - s["y"]) * s["uy"]).alias("t"), ((p["y"] - s["y"]) * s["ux"] - (p["x"] - s["x"]) * s["uy"]).alias("h")))

    def disc(p: Column) -> Column:
        half = F.sqrt(dist * dist - p["h"] * p["h"])
        return F.when(F.abs(p["h"]) <= dist, _span(p["t"] - half, p["t"] + half))

    def between(start: Column, per: Column, low: Column, high: Column) -> list[Column]:
        """From and to where start + per * t lies between two values."""
        ends = [(low - start) / per, (high - start) / per]
        within = (start >= low) & (start <= high)
        return [F.when(F.abs(per) > 1e-12, f(*ends)).when(within, sign * math.inf).otherwise(-sign * math.inf) for f, sign in ((F.least, -1), (F.greatest, 1))]

    def strip(p: Column, q: Column) -> Column:
        size = F.sqrt((q["t"] - p["t"]) * (q["t"] - p["t"]) + (q["h"] - p["h"]) * (q["h"] - p["h"]))
        side = lambda m: F.struct(m.alias("m"), ((q["t"] - p["t"]) / m).alias("wx"), ((q["h"] - p["h"]) / m).alias("wy"), p["t"].alias("t"), p["h"].alias("h"))

        def cut(w: Column) -> Column:
            ahead = between(-w["t"] * w["wx"] - w["h"] * w["wy"], w["wx"], F.lit(0.0), w["m"])
            across = between(w["t"] * w["wy"] - w["h"] * w["wx"], -w["wy"], -dist, dist)
            return _span(F.greatest(ahead[0], across[0]), F.least(ahead[1], across[1]))

        return let(size, lambda m: F.when(m > 0, let(side(m), cut)))

    def crossing(p: Column, q: Column) -> Column:
        return F.when(p["h"] * q["h"] <= 0, p["t"] + (q["t"] - p["t"]) * p["h"] / F.nullif(p["h"] - q["h"], F.lit(0.0)))

    def held(c: Column) -> Column:
        cuts = F.filter(F.zip_with(c, g.following(c), crossing), lambda t: t.isNotNull() & (t > 0) & (t < size))
        marks = F.array_sort(F.concat(F.array(F.lit(0.0), size), cuts))
        flat = F.transform(c, lambda p: g.point(p["t"], p["h"]))
        within = lambda f, m: F.zip_with(m, F.slice(m, 2, F.size(m)), lambda low, high: F.when(high.isNotNull() & g.contains_point(f, g.point((low + high) / 2, 0.0)), _span(low, high)))
        inside = let(flat, lambda f: let(marks, lambda m: within(f, m)))
        found = F.concat(F.transform(c, disc), F.zip_with(c, g.following(c), strip), inside)
        found = F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: _span(F.greatest(x["low"], F.lit(0.0)), F.least(x["high"], size)))
        return F.aggregate(F.array_sort(F.filter(found, lambda x: x["high"] > x["low"])), F.slice(F.array(_span(F.lit(0.0), F.lit(0.0))), 1, 0), _merge)

    return let(there, held)


def _merge(done: Column, s: Column) -> Column:
    last = F.get(done, F.size(done) - 1)
    joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(_span(last["low"], F.greatest(last["high"], s["high"]))))
    return F.when((F.size(done) > 0) & (s["low"] <= last["high"] + 1e-9), joined).otherwise(F.concat(done, F.array(s)))


def pieces(l: Column, spans: Column) -> Column:  # noqa: E741
    """The lines of a segment's stretches."""
    size = g.line_length(l)
    return F.transform(spans, lambda s: g.line(g.along(l, s["low"] / size), g.along(l, s["high"] / size)))


def hull(points: Column) -> Column:
    """The convex hull of an array of points, counter-clockwise from the lowest of the leftmost, without points on its sides.

    The points are put in order once; each chain drops what a new point leaves
    inside. Fewer than three corners give the points themselves.
    """
    given = F.array_sort(F.array_distinct(F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())))

    def add(chain: Column, p: Column) -> Column:
        turns = lambda q, i: (i == 0) | (g._cross(F.get(chain, F.greatest(i - 1, F.lit(0))), q, p) > 0)
        return F.concat(F.filter(chain, turns), F.array(p))

    chain = lambda ps: F.aggregate(ps, F.slice(ps, 1, 0), add)
    inner = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    whole = lambda ps: F.concat(let(chain(ps), inner), let(chain(F.reverse(ps)), inner))
    return let(given, lambda ps: F.when(F.size(ps) < 3, ps).otherwise(whole(ps)))


def _triangles(shape: Column) -> Column:
    """Triangles (counter-clockwise, with a sign) from each ring's first corner: signed, they add up to the shape, whatever its form."""

    def fan(r: Column) -> Column:
        def one(k: Column) -> Column:
            t = F.array(F.get(r, F.lit(0)), F.get(r, k), F.get(r, k + 1))
            area = g.signed_area(t)
            return F.struct(F.when(area < 0, F.reverse(t)).otherwise(t).alias("t"), F.signum(area).alias("sign"))

        return F.when(F.size(r) > 2, F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 2, F.lit(1))), one))

    return F.filter(F.flatten(F.filter(F.transform(shape, fan), lambda x: x.isNotNull())), lambda x: x["sign"] != 0)


def common_area(a: Column, b: Column) -> Column:
    """The area that two shapes share. Their rings don't cross themselves or each other; outer ones run counter-clockwise, holes clockwise."""

    def met(x: Column, others: Column) -> Column:
        return F.aggregate(others, F.lit(0.0), lambda s, y: s + let(convex_clip(x["t"], y["t"]), g.signed_area) * x["sign"] * y["sign"])

    return let(_triangles(b), lambda others: F.aggregate(_triangles(a), F.lit(0.0), lambda s, x: s + met(x, others)))


def union_area(a: Column, b: Column) -> Column:
    return g.shape_area(a) + g.shape_area(b) - common_area(a, b)


def difference_area(a: Column, b: Column) -> Column:
    return g.shape_area(a) - common_area(a, b)


def is_within(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Whether less than ``tolerance`` of a's area lies outside b."""
    return difference_area(a, b) < tolerance


def holds(a: Column, b: Column) -> Column:
    """Whether any region of a holds any region of b."""
    return F.exists(a, lambda ra: F.exists(b, lambda rb: is_within(F.array(rb), F.array(ra))))


def drop_collinear(r: Column, tolerance: float = 1e-3) -> Column:
    """Without corners that change the area by less than ``tolerance`` of it, each tested against those still kept."""

    def step(s: Column, _: Column) -> Column:
        ring, k = s["r"], s["k"]
        n = F.size(ring)
        corner = F.array(F.get(ring, F.pmod(k - 1, n)), F.get(ring, k), F.get(ring, F.pmod(k + 1, n)))
        flat = let(corner, lambda t: F.abs(g.signed_area(t))) <= F.greatest(F.abs(g.signed_area(ring)), F.lit(1e-12)) * tolerance
        less = F.struct(F.filter(ring, lambda p, i: i != k).alias("r"), F.greatest(k - 1, F.lit(0)).alias("k"))
        return F.when((n <= 3) | (k >= n), s).when(flat, less).otherwise(F.struct(ring.alias("r"), (k + 1).alias("k")))

    # Every step drops a corner and goes back one at most, or goes on by one.
    return F.aggregate(F.sequence(F.lit(1), F.size(r) * 3), F.struct(r.alias("r"), F.lit(0).alias("k")), step, lambda s: s["r"])


def self_crossings(r: Column) -> Column:
    """How many pairs of a ring's sides cross that aren't neighbours."""

    def count(lines: Column) -> Column:
        n = F.size(lines)
        apart = lambda i, j: (j > i + 1) & ~((i == 0) & (j == n - 1))
        crosses = lambda x, y: g.segment_distance(x, y) == 0
        return F.aggregate(F.flatten(F.transform(lines, lambda x, i: F.transform(lines, lambda y, j: F.when(apart(i, j) & crosses(x, y), 1).otherwise(0)))), F.lit(0), lambda s, v: s + v)

    return let(g.sides(r), count)


def unique_regions(shape: Column, tolerance: float = 1.0) -> Column:
    """Without regions that a later one equals: areas and difference under ``tolerance``."""

    def repeated(r: Column, i: Column) -> Column:
        same = lambda q: (F.abs(F.abs(g.signed_area(r)) - F.abs(g.signed_area(q))) < tolerance) & (difference_area(F.array(r), F.array(q)) < tolerance)
        return F.exists(F.slice(shape, i + 2, F.size(shape)), same)

    return F.filter(shape, lambda r, i: ~repeated(r, i))


def drop_contained(shape: Column) -> Column:
    """Without regions inside another one; of equal ones the last stays."""
    larger = lambda q, j, r, i: (F.abs(g.signed_area(q)) > F.abs(g.signed_area(r)) + 1e-9) | ((F.abs(F.abs(g.signed_area(q)) - F.abs(g.signed_area(r))) <= 1e-9) & (j > i))
    inside = lambda r, i: F.exists(F.transform(shape, lambda q, j: F.when(i != j, larger(q, j, r, i) & is_within(F.array(r), F.array(q))).otherwise(False)), lambda x: x)
    return F.filter(shape, lambda r, i: ~inside(r, i))


def simplify(r: Column, tolerance: float = 0.05) -> Column:
    """Douglas-Peucker from the first corner and the one farthest from it; counter-clockwise. Rings that would vanish stay as they are."""

    def thin(closed: Column) -> Column:
        farthest = F.array_max(F.transform(closed, lambda p, i: F.struct(g.distance(p, F.get(closed, F.lit(0))).alias("d"), (-i).alias("i"))))
        span = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
        start = let(-farthest["i"], lambda k: F.struct(F.array(span(F.lit(0), k), span(k, F.size(closed) - 1)).alias("open"), F.array(F.lit(0), k.cast("int")).alias("kept")))

        def step(s: Column, _: Column) -> Column:
            last = F.get(s["open"], F.size(s["open"]) - 1)
            rest = F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))

            def split(x: Column) -> Column:
                line = g.line(F.get(closed, x["i"]), F.get(closed, x["j"]))
                gap = lambda k: let(F.get(closed, k), lambda p: let(g.project_point(p, line), lambda q: g.distance(p, q)))
                best = F.array_max(F.transform(F.sequence(x["i"] + 1, F.greatest(x["j"] - 1, x["i"] + 1)), lambda k: F.struct(gap(k).alias("d"), (-k).alias("k"))))

                def at(b: Column) -> Column:
                    k = -b["k"]
                    more = F.struct(F.concat(rest, F.array(span(x["i"], k), span(k, x["j"]))).alias("open"), F.concat(s["kept"], F.array(k)).alias("kept"))
                    return F.when((x["j"] - x["i"] > 1) & (b["d"] > tolerance), more).otherwise(F.struct(rest.alias("open"), s["kept"].alias("kept")))

                return let(best, at)

            return F.when(F.size(s["open"]) == 0, s).otherwise(let(last, split))

        kept = F.aggregate(F.sequence(F.lit(1), F.size(closed) * 2 + 2), start, step, lambda s: F.array_distinct(F.array_sort(F.filter(s["kept"], lambda k: k < F.size(closed) - 1))))
        return F.transform(kept, lambda k: F.get(closed, k))

    return let(let(F.concat(r, F.slice(r, 1, 1)), thin), lambda t: g.with_orientation(F.when(F.size(t) >= 3, t).otherwise(r)))


def best_rectangle(r: Column, width, steps: int = 90, reach: float = 1000.0) -> Column:
    """The angle in [0, pi) and length of the longest rectangle of ``width`` through the middle of the corners inside a ring of any form, of ``steps`` angles; ties go to the smallest."""
    return let(r, lambda v: _best_rectangle(v, F.lit(width), steps, reach))


def _best_rectangle(r: Column, width: Column, steps: int, reach: float) -> Column:
    mean = lambda c: F.aggregate(r, F.lit(0.0), lambda s, p: s + p[c]) / F.size(r)
    middle = g.point(mean("x"), mean("y"))

    def end(base: Column, ux: Column, uy: Column) -> Column:
        """How far one goes from a point inside."""
        spans = spans_near(g.line(base, g.point(base["x"] + ux * reach, base["y"] + uy * reach)), r, 0.0)
        return let(spans, lambda s: F.when((F.size(s) > 0) & (F.get(s, F.lit(0))["low"] < 1e-6), F.get(s, F.lit(0))["high"]).otherwise(0.0))

    def along(m: Column, a: Column) -> Column:
        offsets = F.array(*[F.lit(k / 4 - 0.5) for k in range(5)])
        turned = F.struct(F.cos(a).alias("cos"), F.sin(a).alias("sin"))
        base = lambda u, k: g.point(m["x"] - u["sin"] * width * k, m["y"] + u["cos"] * width * k)
        ends = lambda u, w: F.array_min(F.transform(offsets, lambda k: let(base(u, k), lambda p: end(p, u["cos"] * w, u["sin"] * w))))
        return let(turned, lambda u: F.struct((ends(u, 1) + ends(u, -1)).alias("length"), (-a).alias("back"), a.alias("angle")))

    found = let(middle, lambda m: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: let(k * (math.pi / steps), lambda a: along(m, a)))))
    return let(found, lambda x: F.struct(x["angle"].alias("angle"), x["length"].alias("length")))


def ring_from_lines(lines: Column, reach: float = 1.0) -> Column:
    """The ring whose sides lie on consecutive lines: corners where neighbours meet, or between them where that is far off."""
    before = F.concat(F.slice(lines, -1, 1), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))))

    def corner(p: Column, q: Column) -> Column:
        a, b, c, d = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(q, F.lit(0)), F.get(q, F.lit(1))
        den = (b["x"] - a["x"]) * (d["y"] - c["y"]) - (b["y"] - a["y"]) * (d["x"] - c["x"])
        t = ((c["x"] - a["x"]) * (d["y"] - c["y"]) - (c["y"] - a["y"]) * (d["x"] - c["x"])) / F.nullif(den, F.lit(0.0))
        met = F.when(F.abs(den) > 1e-12, g.point(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t)).otherwise(b)
        between = g.point((b["x"] + c["x"]) / 2, (b["y"] + c["y"]) / 2)
        return let(met, lambda m: F.when(g.distance(m, b) <= reach + g.distance(a, b), m).otherwise(between))

    return F.zip_with(before, lines, corner)


def prism_faces(slices: Column, near: float = 5.0) -> Column:
    """The faces (arrays of x, y, z) between consecutive slices of an array of (height, ring): parallel sides at most ``near`` apart are joined, the top closed."""
    high = lambda p, z: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.alias("z"))

    def between(low: Column, up: Column) -> Column:
        def face(side: Column) -> Column:
            a, b = F.get(side, F.lit(0)), F.get(side, F.lit(1))
            dx, dy, n = b["x"] - a["x"], b["y"] - a["y"], g.line_length(side)

            def one(other: Column) -> Column:
                c, d = F.get(other, F.lit(0)), F.get(other, F.lit(1))
                mx, my = (c["x"] + d["x"]) / 2 - a["x"], (c["y"] + d["y"]) / 2 - a["y"]
                turn = F.abs(dx * (d["y"] - c["y"]) - dy * (d["x"] - c["x"])) / (n * g.line_length(other))
                gap = F.abs(dx * my - dy * mx) / n
                return F.when((turn < g.PARALLEL) & (gap <= near), F.struct(gap.alias("gap"), other.alias("other")))

            best = F.array_min(F.filter(F.transform(g.sides(up["ring"]), one), lambda x: x.isNotNull()))
            quad = lambda x: F.array(high(a, low["height"]), high(b, low["height"]), high(F.get(x["other"], F.lit(1)), up["height"]), high(F.get(x["other"], F.lit(0)), up["height"]))
            return let(best, lambda x: F.when(x.isNotNull(), quad(x)))

        return F.filter(F.transform(g.sides(low["ring"]), face), lambda f: f.isNotNull())

    pairs = F.zip_with(slices, F.slice(slices, 2, F.size(slices)), lambda a, b: F.when(b.isNotNull(), between(a, b)))
    top = let(F.get(slices, F.size(slices) - 1), lambda t: F.transform(t["ring"], lambda p: high(p, t["height"])))
    return F.concat(F.flatten(F.filter(pairs, lambda x: x.isNotNull())), F.array(top))
