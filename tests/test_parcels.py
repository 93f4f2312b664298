"""Borders, outlines, joins on cells, streets and hulls against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwright.functions import clipping as c
from lotwright.functions import geometry as g
from lotwright.operators import borders, dissolve, hulls, kernel, overlay, spatial_join, streets


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_loops(df, python=False):
    text = plan(df)
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert python or "Python" not in text and "Pandas" not in text and "Arrow" not in text


def parted(rng, n, w=100.0, h=70.0):
    """A rectangle cut into boxes (x0, y0, x1, y1), on tenths of a metre."""
    boxes = [(0.0, 0.0, w, h)]
    while len(boxes) < n:
        x0, y0, x1, y1 = boxes.pop(max(range(len(boxes)), key=lambda k: (boxes[k][2] - boxes[k][0]) * (boxes[k][3] - boxes[k][1])))
        if x1 - x0 > y1 - y0:
            m = round(rng.uniform(x0 + 1, x1 - 1), 1)
            boxes += [(x0, y0, m, y1), (m, y0, x1, y1)]
        else:
            m = round(rng.uniform(y0 + 1, y1 - 1), 1)
            boxes += [(x0, y0, x1, m), (x0, m, x1, y1)]
    return boxes


def placed(box, angle, east=0.0, north=0.0, clockwise=False):
    x0, y0, x1, y1 = box
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    ring = [(east + x * math.cos(angle) - y * math.sin(angle), north + x * math.sin(angle) + y * math.cos(angle)) for x, y in ring]
    return [ring[::-1] if clockwise else ring]


def common(a, b):
    if a[2] == b[0] or b[2] == a[0]:
        return max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    if a[3] == b[1] or b[3] == a[1]:
        return max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    return 0.0


def test_shared_borders_of_parted_blocks(spark):
    rng, rows, want = random.Random(3), [], {}
    for block, angle in enumerate([0.0, math.pi / 2, 0.3, 1.57, -0.7, math.pi / 2 - 1e-4, 2.9, math.atan2(3, 4)]):
        boxes = parted(rng, 14)
        rows += [(block, k, placed(b, angle, 350_000.0 + 500 * block, 6_300_000.0, clockwise=k % 3 == 0)) for k, b in enumerate(boxes)]
        want |= {(block, i, j): common(boxes[i], boxes[j]) for i in range(14) for j in range(i + 1, 14) if common(boxes[i], boxes[j]) > 1e-6}
    rows += [(0, 50, None), (None, 51, rows[0][2]), (None, 52, rows[1][2])]
    found = borders.shared_borders(spark.createDataFrame(rows, f"block int, k int, shape {g.SHAPE}"), "k", "block", "shape")
    no_loops(found)
    got = {(r.block, r.a, r.b): r.shared for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_shared_borders_within_tolerance(spark):
    boxes = [(0, 0, 10, 10), (10.03, 2, 20, 14), (-10, 0, -0.08, 10), (0, 0, 10, 10), (3, 10.0, 4, 12), (12, 14, 13, 15)]
    rows = [(1, k, placed(b, 0.5)) for k, b in enumerate(boxes)]
    found = borders.shared_borders(spark.createDataFrame(rows, f"block int, k int, shape {g.SHAPE}"), "k", "block", "shape")
    # Equal parcels have no border between them; 8 cm are too far.
    assert sorted((r.a, r.b, round(r.shared, 3)) for r in found.collect()) == [(0, 1, 8.0), (0, 4, 1.0), (1, 3, 8.0), (1, 5, 1.0), (3, 4, 1.0)]


def test_outlines_of_parted_blocks(spark):
    rng, rows, want = random.Random(4), [], {}
    for block, angle in enumerate([0.0, 0.4, 2.0]):
        boxes = parted(rng, 12)
        rows += [(block, k, placed(b, angle, 1000.0 * block)) for k, b in enumerate([*boxes, boxes[0]])]
        want[block] = (7000.0, 340.0, 1, 0, 4)
    found = dissolve.measures(dissolve.rings(spark.createDataFrame(rows, f"block int, k int, shape {g.SHAPE}"), ["block"], "shape"), ["block"])
    for r in found.collect():
        area, perimeter, rings, holes, corners = want[r.block]
        # Corners lie on a grid of 1 cm.
        assert r.area == pytest.approx(area, abs=2) and r.perimeter == pytest.approx(perimeter, abs=0.1)
        assert (r.rings, r.holes, r.corners) == (rings, holes, corners)


def flood(cells):
    """Regions of cells that share sides."""
    left, n = set(cells), 0
    while left:
        n, wave = n + 1, [left.pop()]
        while wave:
            x, y = wave.pop()
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in left:
                    left.remove(p)
                    wave.append(p)
    return n


def test_outline_of_one_large_group_with_holes(spark):
    rng = random.Random(5)
    cells = {(x, y) for x in range(40) for y in range(40) if rng.random() < 0.7}
    rows = [(placed((5 * x, 5 * y, 5 * x + 5, 5 * y + 5), math.atan2(4, 3)),) for x, y in cells]
    one = spark.createDataFrame(rows, f"shape {g.SHAPE}").withColumn("g", F.lit(1))
    points = dissolve.rings(one, ["g"], "shape")
    r = dissolve.measures(points, ["g"]).first()
    sides = sum((x + dx, y + dy) not in cells for x, y in cells for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    around = [sum(((x + dx, y + dy) in cells) << k for k, (dx, dy) in enumerate(((0, 0), (-1, 0), (-1, -1), (0, -1)))) for x in range(41) for y in range(41)]
    turns = sum({1: 1, 3: -1}.get(bin(a).count("1"), 2 * (a in (5, 10))) for a in around)
    outer = flood(cells)
    assert r.area == pytest.approx(25.0 * len(cells)) and r.perimeter == pytest.approx(5.0 * sides)
    assert (r.rings, r.holes) == (2 * outer - turns // 4, outer - turns // 4)
    # Every ring is numbered without gaps, each point follows the one before.
    by = {}
    for p in points.collect():
        by.setdefault(tuple(p.ring), []).append((p.place, (p.ax, p.ay), (p.bx, p.by)))
    for ring in by.values():
        ring.sort()
        assert [p[0] for p in ring] == list(range(len(ring)))
        assert all(a[2] == b[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def test_shapes_of_groups(spark):
    rows = [(None, [[(0, 0), (4, 0), (4, 2), (0, 2)]]), (None, [[(4, 1), (6, 1), (6, 3), (4, 3)]]), (2, [[(0, 0), (1, 0), (1, 1), (0, 1)]]), (3, None)]
    rows = [(k, s and [[(float(x), float(y)) for x, y in r] for r in s]) for k, s in rows]
    df = spark.createDataFrame(rows, f"g int, shape {g.SHAPE}").where("g is null or g <> 3").fillna(-1, ["g"])
    got = {r.g: [[(p.x, p.y) for p in ring] for ring in r.shape] for r in dissolve.shapes(dissolve.rings(df, ["g"], "shape"), ["g"]).collect()}
    assert got == {2: [[(0, 0), (1, 0), (1, 1), (0, 1)]], -1: [[(0, 0), (4, 0), (4, 1), (6, 1), (6, 3), (4, 3), (4, 2), (0, 2)]]}


def test_bounds_of_all_sizes(spark):
    rng = random.Random(6)

    def some(n):
        out = []
        for k in range(n):
            size = 10 ** rng.uniform(-1, 4.5)
            x, y = rng.uniform(-30_000, 30_000), rng.uniform(-3000, 3000)
            out.append((k, x, y, x + size * rng.random(), y + size * rng.random()))
        return out

    left, right = some(150), some(150)
    frames = [spark.createDataFrame(rows, f"{s}k int, {s}x0 double, {s}y0 double, {s}x1 double, {s}y1 double") for s, rows in (("a", left), ("b", right))]
    at = lambda s: F.struct(*[F.col(f"{s}{n}").alias(n) for n in ("x0", "y0", "x1", "y1")])
    for within in (0.0, 25.0):
        found = spatial_join.bounds_join(*frames, at("a"), at("b"), within=within)
        no_loops(found)
        got = [(r.ak, r.bk) for r in found.collect()]
        want = [(a[0], b[0]) for a in left for b in right if a[1] - within <= b[3] and b[1] <= a[3] + within and a[2] - within <= b[4] and b[2] <= a[4] + within]
        assert sorted(got) == sorted(want) and len(want) > 100


def star(rng, x, y, r, n=24):
    return [(x + k * math.cos(2 * math.pi * i / n), y + k * math.sin(2 * math.pi * i / n)) for i, k in enumerate(r * rng.uniform(0.4, 1) for _ in range(n))]


def inside(ring, p):
    return sum((ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


def test_points_in_rings_of_all_sizes(spark):
    rng = random.Random(7)
    rings = [star(rng, rng.uniform(0, 9000), rng.uniform(0, 9000), r) for r in (3000, 800, 120, 9, 0.7) for _ in range(4)]
    points = [(rng.uniform(-500, 9500), rng.uniform(-500, 9500)) for _ in range(1500)] + [(r[0][0] - 0.01, r[0][1]) for r in rings] + [rings[0][5]] * 300 + [(None, None)]
    left = spark.createDataFrame(list(enumerate(rings)), f"k int, ring {g.RING}")
    right = spark.createDataFrame([(i, p) for i, p in enumerate(points)], f"i int, p {g.POINT}")
    want = sorted((k, i) for k, r in enumerate(rings) for i, p in enumerate(points) if p[0] is not None and inside(r, p))
    for heavy in (200_000, 10):
        found = spatial_join.contains_points(left, right, "ring", "p", g.bounds(F.col("ring")), heavy)
        no_loops(found)
        assert sorted((r.k, r.i) for r in found.collect()) == want
    cover = spatial_join.covering(left, "ring", g.bounds(F.col("ring")))
    counts = [r["count"] for r in cover.groupBy("k").count().collect()]
    assert max(counts) < 600 and len(counts) == len(rings) and cover.where("_whole").count() > 50


def test_distances_of_shapes(spark):
    u = [(0, 0), (9, 0), (9, 9), (6, 9), (6, 2), (3, 2), (3, 9), (0, 9)]
    cases = [([(4, 4), (5, 4), (5, 5), (4, 5)], 1.0), ([(1, 1), (2, 1), (2, 2), (1, 2)], 0.0), ([(-5, -5), (20, -5), (20, 20), (-5, 20)], 0.0), ([(12, 13), (14, 13), (14, 15), (12, 15)], 5.0), ([(-1, 4), (1, 4), (1, 5), (-1, 5)], 0.0), ([(9, 3), (10, 3), (10, 4)], 0.0)]
    rows = [([[(float(x), float(y)) for x, y in u]], [[(float(x), float(y)) for x, y in r]], d) for r, d in cases]
    df = spark.createDataFrame(rows, f"a {g.SHAPE}, b {g.SHAPE}, d double")
    got = df.select(g.shape_distance(F.col("a"), F.col("b")).alias("got"), g.shape_distance(F.col("b"), F.col("a")).alias("back"), "d").collect()
    assert all(r.got == pytest.approx(r.d) and r.back == pytest.approx(r.d) for r in got)


def test_streets_near_shapes_of_any_form(spark):
    rng = random.Random(8)
    u = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (6.0, 9.0), (6.0, 2.0), (3.0, 2.0), (3.0, 9.0), (0.0, 9.0)]
    lines = [[(rng.uniform(-6, 14), rng.uniform(-6, 14)) for _ in range(rng.choice([1, 2, 2, 3]))] for _ in range(25)] + [[(4.5, -5.0), (4.5, 300.0)], [(1.0, 1.0), (1.0, 1.0)]]
    roads = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], f"s int, line {g.RING}")
    lots = spark.createDataFrame([(1, [u])], f"k int, shape {g.SHAPE}")

    def gap(p):
        if inside(u, p):
            return 0.0
        out = []
        for a, b in zip(u, u[1:] + u[:1], strict=True):
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
            out.append(math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy))
        return min(out)

    for dist in (0.0, 0.7):
        found = streets.in_context(roads, lots, "s", "line", "k", "shape", dist, stretch=7.0)
        no_loops(found)
        got = {r.street: r for r in found.collect()}
        for k, line in enumerate(lines):
            want = 0.0
            for a, b in zip(line, line[1:], strict=False):
                n, size = 3000, math.dist(a, b)
                want += size / n * sum(gap((a[0] + (b[0] - a[0]) * (i + 0.5) / n, a[1] + (b[1] - a[1]) * (i + 0.5) / n)) <= dist for i in range(n))
            assert (got[k].length if k in got else 0.0) == pytest.approx(want, abs=0.15 if k == 25 else 0.05)
            if k in got:
                pieces = [[(p.x, p.y) for p in x] for x in got[k].pieces]
                assert sum(math.dist(*p) for p in pieces) == pytest.approx(got[k].length)
                assert all(gap(((p[0][0] + p[1][0]) / 2, (p[0][1] + p[1][1]) / 2)) <= dist + 1e-6 for p in pieces)


def chain(points):
    points = sorted(set(points))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1]) if len(points) > 2 else points


def test_hulls_of_groups(spark):
    rng = random.Random(9)
    groups = {
        1: [(float(rng.randrange(30)), float(rng.randrange(30))) for _ in range(1200)],
        2: [(math.cos(k), math.sin(k)) for k in range(150)],
        3: [(1.0, 1.0)] * 400,
        4: [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)],
        5: [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (2.0, 0.0), (2.0, 2.0)],
    }
    rows = [(k, p) for k, ps in groups.items() for p in ps] + [(1, None), (6, None)]
    found = hulls.group_hulls(spark.createDataFrame(rows, f"k int, p {g.POINT}"), ["k"], "p", part=40)
    got = {r.k: [(p.x, p.y) for p in r.hull] for r in found.collect()}
    assert got.keys() == groups.keys()
    assert all(got[k] == chain(ps) for k, ps in groups.items() if k != 4)
    assert set(got[4]) >= {(0.0, 0.0), (2.0, 2.0)}


def test_offsets_of_convex_rings(spark):
    hexagon = [(5 * math.cos(k * math.pi / 3), 5 * math.sin(k * math.pi / 3)) for k in range(6)]
    df = spark.createDataFrame([(hexagon,)], f"r {g.RING}")
    r, area, side = F.col("r"), 1.5 * math.sqrt(3) * 25, 5.0
    same = lambda d: F.array_repeat(F.lit(d), 6)
    grown = lambda d: 1.5 * math.sqrt(3) * (5 + d * 2 / math.sqrt(3)) ** 2
    got = df.select(
        *[g.signed_area(x) for x in (c.convex_offset(r, same(1.0)), c.convex_offset(r, same(-1.0)), c.convex_offset(r, same(-4.0)), c.convex_offset(r, same(-5.0)), c.convex_shrink(r, F.lit(0.3)), c.convex_buffer(r, 1.0), c.convex_clip(g.box(0, -9, 20, 18), r))],
        g.signed_area(c.convex_offset(r, F.array(*[F.lit(d) for d in (-2.0, 0.0, 0.0, 0.0, 0.0, 0.0)]))),
    ).first()
    chords = 6 * 6 * 0.5 * math.sin(math.pi / 18)
    strip = 5.0 * 2 + 2 * 2 / math.sqrt(3)
    assert list(got) == pytest.approx([grown(1), grown(-1), grown(-4), 0.0, area * 0.3, area + 6 * side + chords, area / 2, area - strip])


def test_overlays_of_any_form(spark):
    rng, rows = random.Random(11), []
    for k in range(18):
        a, b = [star(rng, 0, 0, 50, rng.randint(5, 14))], [star(rng, rng.uniform(-30, 30), rng.uniform(-30, 30), rng.choice([8, 40]), rng.randint(4, 12))]
        if k % 5 == 0:
            # A hole, and sides that both shapes share.
            b = [[(-20.0, -20.0), (25.0, -20.0), (25.0, 22.0), (-20.0, 22.0)], [(-5.0, -5.0), (-5.0, 6.0), (7.0, 6.0), (7.0, -5.0)]]
        if k % 6 == 1:
            b = a
        if k % 6 == 2:
            a, b = [[(0.0, 0.0), (30.0, 0.0), (30.0, 20.0), (0.0, 20.0)]], [[(10.0, 20.0), (20.0, 20.0), (20.0, 30.0), (10.0, 30.0)]]
        if k % 6 == 3:
            b = [[(x + 500.0, y) for x, y in a[0]]]
        rows.append((k, a, b))
    df = spark.createDataFrame(rows, f"k int, a {g.SHAPE}, b {g.SHAPE}")
    a, b = F.col("a"), F.col("b")
    areas = {r.k: r for r in df.select("k", c.common_area(a, b).alias("intersection"), c.union_area(a, b).alias("union"), c.difference_area(a, b).alias("difference")).collect()}
    plain = {"intersection": kernel.intersection, "union": lambda x, y: kernel.union([x, y]), "difference": kernel.difference}
    for kind, f in plain.items():
        found = overlay.rings(df, ["k"], "a", "b", kind)
        got = {r.k: r for r in dissolve.measures(found, ["k"]).collect()}
        for k, x, y in rows:
            want = f(*[[np.array(r) for r in s] for s in (x, y)])
            area = sum(kernel.ring_area(r) for r in want)
            # Both work on a grid of 1 cm; the Column's area doesn't.
            assert areas[k][kind] == pytest.approx(area, abs=2)
            assert (got[k].area if k in got else 0.0) == pytest.approx(area, abs=2)
            assert (got[k].rings if k in got else 0) == len(want)
    with pytest.raises(ValueError, match="unknown kind"):
        overlay.overlay(df, ["k"], "a", "b", "xor")


def test_tests_of_regions(spark):
    square, inner, far = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)], [(20.0, 0.0), (21.0, 0.0), (21.0, 1.0)]
    df = spark.createDataFrame([([square, inner, square, far],)], f"s {g.SHAPE}")
    r = df.select(c.unique_regions(F.col("s")).alias("u"), c.drop_contained(F.col("s")).alias("d"), c.holds(F.slice("s", 1, 1), F.slice("s", 2, 1)).alias("h"), c.holds(F.slice("s", 2, 1), F.slice("s", 1, 1)).alias("n"), c.self_crossings(F.get("s", F.lit(0))).alias("x")).first()
    back = lambda s: [[(p.x, p.y) for p in ring] for ring in s]
    assert back(r.u) == [inner, square, far] and back(r.d) == [square, far]
    assert (r.h, r.n, r.x) == (True, False, 0)
    rng = random.Random(12)
    rings = [[(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(rng.randint(3, 9))] for _ in range(20)]
    thin = spark.createDataFrame([(r,) for r in rings], f"r {g.RING}").select("r", c.drop_collinear(F.col("r")).alias("t")).collect()
    assert all([(p.x, p.y) for p in x.t] == [tuple(p) for p in kernel.drop_collinear(np.array([(p.x, p.y) for p in x.r]))] for x in thin)


def test_unions_of_groups_that_overlap(spark):
    rng, rows, want = random.Random(13), [], {}
    for place in range(4):
        stars = [star(rng, rng.uniform(-60, 60), rng.uniform(-60, 60), rng.uniform(5, 40), rng.randint(4, 9)) for _ in range(9)]
        stars += [stars[0], [(200.0, 0.0), (210.0, 0.0), (210.0, 10.0), (200.0, 10.0)], [(210.0, 2.0), (215.0, 2.0), (215.0, 10.0), (210.0, 10.0)]]
        rows += [(place, [r[::-1] if k % 2 else r]) for k, r in enumerate(stars)]
        want[place] = kernel.union([[np.array(r)] for r in stars])
    found = overlay.merged(spark.createDataFrame([*rows, (None, rows[0][1]), (1, None)], f"k int, s {g.SHAPE}"), ["k"], "s")
    got = {r.k: r for r in dissolve.measures(dissolve.points_of(found, ["k"]), ["k"]).collect()}
    assert got.keys() == want.keys()
    for k, rings in want.items():
        assert got[k].area == pytest.approx(sum(kernel.ring_area(r) for r in rings), abs=4)
        assert got[k].rings - got[k].holes == sum(kernel.ring_area(r) > 0 for r in rings)


def test_simplified_rings_rectangles_and_faces(spark):
    rng = random.Random(14)
    rings = [[(float(x), float(y)) for x, y in [(0, 0), (5, 0.01), (10, 0), (10, 10), (0, 10)]]] + [star(rng, 0, 0, 20, rng.randint(6, 16)) for _ in range(12)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], f"k int, r {g.RING}")
    for tolerance in (0.05, 3.0):
        for x in df.select("k", c.simplify(F.col("r"), tolerance).alias("t")).collect():
            want = kernel.simplify(np.array(rings[x.k]), tolerance)
            got = np.array([(p.x, p.y) for p in x.t])
            assert len(got) == len(want) and {tuple(p) for p in got} == {tuple(p) for p in want}
    boxes = spark.createDataFrame([([(0.0, 0.0), (40.0, 0.0), (40.0, 10.0), (0.0, 10.0)],), ([(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (12.0, 8.0), (0.0, 20.0)],)], f"r {g.RING}")
    for x in boxes.select("r", c.best_rectangle(F.col("r"), 2.0).alias("b")).collect():
        ring = np.array([(p.x, p.y) for p in x.r])
        angle, length = kernel.best_angle([ring], ring.mean(axis=0), 2.0)
        assert x.b.length == pytest.approx(length, abs=1e-6)
    lines = spark.createDataFrame([([[(0.0, -1.0), (4.0, -1.0)], [(4.5, 0.0), (4.5, 3.0)], [(4.0, 3.5), (0.0, 3.5)], [(-0.5, 3.0), (-0.5, 0.0)]],)], f"l {g.SHAPE}")
    assert lines.select(g.signed_area(c.ring_from_lines(F.col("l")))).first()[0] == pytest.approx(5 * 4.5)
    level = lambda z, s: F.struct(F.lit(z).alias("height"), g.box(s, s, 10 - 2 * s, 10 - 2 * s).alias("ring"))
    faces = spark.range(1).select(c.prism_faces(F.array(level(0.0, 0.0), level(3.0, 1.0), level(6.0, 7.0 / 2))).alias("f"), c.prism_faces(F.array(level(0.0, 0.0))).alias("one")).first()
    assert [len(f) for f in faces.f] == [4] * 9 and len(faces.one) == 1
    assert {(p.x, p.y, p.z) for p in faces.f[0]} == {(0, 0, 0), (10, 0, 0), (9, 1, 3), (1, 1, 3)}


def test_sides_that_face_streets(spark):
    from lotwright.operators import zoning

    boxes = {1: (0, 0, 20, 20), 2: (20, 0, 40, 20), 3: (0, 34, 40, 60), 4: (-3, 0, 0, 20), 5: (0, -12, 40, -2)}
    rows = [(k, placed([float(v) for v in b], 0.0)[0]) for k, b in boxes.items()]
    found = zoning.side_streets(spark.createDataFrame(rows, f"k int, ring {g.RING}"), "k", "ring", 25.0)
    got = {(r.key, r.side): r.width for r in found.where("key in (1, 2, 3)").collect()}
    # Between 1, 2 and 3 lies a street of 14; the one of 2 below is taken to be 10 at least; nothing limits the rest.
    assert got == {(1, 0): 10.0, (1, 2): 14.0, (2, 0): 10.0, (2, 1): 25.0, (2, 2): 14.0, (3, 0): 14.0, (3, 1): 25.0, (3, 2): 25.0, (3, 3): 25.0}


def test_shadows_of_slices(spark):
    from lotwright.operators import zoning

    slices = [(k, 0.49 * h, [(float(x), float(y)) for x, y in ((0, 0), (10, 0), (10, 6), (0, 6))]) for k in (1, 2) for h in range(11)]
    ground = [[(-9.0, -5.0), (-5.0, -5.0), (-5.0, 20.0), (-9.0, 20.0)]]
    df = spark.createDataFrame([(*s, ground) for s in slices], f"k int, z double, r {g.RING}, ground {g.SHAPE}")
    assert {r.k: r.area for r in zoning.slices_shadow(df, ["k"], "r", "z", "p").collect()} == pytest.approx({1: 120.0, 2: 120.0})
    assert {r.k: r.area for r in zoning.slices_shadow(df, ["k"], "r", "z", "p", "ground").collect()} == pytest.approx({1: 96.0, 2: 96.0})


def test_rings_of_small_groups_are_followed_in_tasks(spark, monkeypatch):
    """The same rings as by rounds, and no files of rounds but the links' and the large groups'."""
    square = lambda x, y, n=10.0: [[(x, y), (x + n, y), (x + n, y + n), (x, y + n)]]
    rows = [(f"b{k}" if k else None, square(10.0 * i, 10.0 * j)) for k in range(4) for i in range(3) for j in range(3) if (i, j) != (1, 1)] + [("far", square(0.0, 0.0)), ("far", square(40.0, 0.0))]
    own = spark.createDataFrame(rows, f"block string, shape {g.SHAPE}")
    kept = []
    keep = dissolve.keep
    monkeypatch.setattr(dissolve, "keep", lambda df: kept.append(1) or keep(df))
    found = lambda: sorted(map(str, dissolve.rings(own, ["block"], "shape").collect()))
    monkeypatch.setattr(dissolve, "BATCH", 5)
    in_tasks = found()
    assert len(kept) == 2
    monkeypatch.setattr(dissolve, "SMALL", 9)
    monkeypatch.setattr(dissolve, "FEW", 2)
    assert found() == in_tasks and len(in_tasks) == 3 * 16 + 8
    assert len(kept) > 4
