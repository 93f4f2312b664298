"""Work on shapes that is done for many rows at once, against the same in Column expressions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwright.functions import clipping as c
from lotwright.functions import geometry as g
from lotwright.operators import side_by_side, streets, zoning


def _rings(seed, n):
    """Rings of three to eight corners around the origin, not all convex."""
    rng = random.Random(seed)
    return [[(rng.uniform(2, 9) * math.cos(2 * math.pi * k / m), rng.uniform(2, 9) * math.sin(2 * math.pi * k / m)) for k in range(m)] for m in (rng.randint(3, 8) for _ in range(n))]


def _flat(rings):
    return np.array([p[0] for r in rings for p in r]), np.array([p[1] for r in rings for p in r]), np.array([len(r) for r in rings])


def test_half_planes_as_columns_have_them(spark):
    rings = [*_rings(1, 40), []]
    lines = [[((i - 20) / 4.0, -3.0), (1.0, (i % 7) - 3.0)] for i in range(41)]
    df = spark.createDataFrame([(i, r, x) for i, (r, x) in enumerate(zip(rings, lines, strict=True))], f"i int, r {g.RING}, l {g.RING}")
    want = {x.i: [(p.x, p.y) for p in x.h] for x in df.select("i", c.half_planes(F.col("r"), F.array("l")).alias("h")).collect()}
    px, py = (np.array([x[0][k] for x in lines]) for k in (0, 1))
    dx, dy = (np.array([x[1][k] - x[0][k] for x in lines]) for k in (0, 1))
    x, y, n = side_by_side.half_plane(*_flat(rings), px, py, dx, dy)
    ends = np.cumsum(n)
    assert [[*zip(x[e - k : e], y[e - k : e], strict=True)] for e, k in zip(ends, n, strict=True)] == [want[i] for i in range(41)]


def test_areas_within_depths(spark):
    rings = [[(t, abs(h)) for t, h in r] for r in _rings(2, 30)]
    convex = [[(0.0, 0.0), (9.0, 0.0), (9.0, 4.0), (3.0, 7.0)], [(1.0, 2.0), (4.0, 2.0), (4.0, 5.0)]]
    depths = np.array([0.0, 0.5, 2.0, 3.0, 6.0, 20.0])
    got = side_by_side.areas_within(*_flat(convex), depths)
    df = spark.createDataFrame([(k, r) for k, r in enumerate(convex)], f"k int, r {g.RING}")
    for n, d in enumerate(depths):
        line = g.line(g.point(1.0, float(d)), g.point(0.0, float(d)))
        for x in df.select("k", F.abs(g.signed_area(c.half_planes(F.col("r"), F.array(line)))).alias("a")).collect():
            assert got[x.k, n] == pytest.approx(x.a, abs=1e-9)
    assert side_by_side.areas_within(*_flat(rings), np.array([20.0])).shape == (30, 1)


@pytest.mark.parametrize("dist", [0.0, 0.7, 3.0])
def test_streets_in_bulk_are_the_same(spark, dist):
    """Rings of several numbers of corners, streets through, along and beside them, points and nulls; pieces too."""
    rng = random.Random(3)
    lines = [[(rng.uniform(-12, 12), rng.uniform(-12, 12)) for _ in range(rng.choice([1, 2, 3]))] for _ in range(40)] + [[(0.0, -50.0), (0.0, 50.0)], [(1.0, 1.0), (1.0, 1.0)], None]
    lots = spark.createDataFrame([(k, [r]) for k, r in enumerate(_rings(4, 12))] + [(90, None), (91, []), (92, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]])], f"k int, shape {g.SHAPE}")
    roads = spark.createDataFrame([(f"s{k}", x) for k, x in enumerate(lines)], f"s string, line {g.RING}")
    # Small batches, of which some have nothing near.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    plain, bulk = ({(r.parcel, r.street): r for r in streets.in_context(roads, lots, "s", "line", "k", "shape", dist, 7.0, bulk=b).collect()} for b in (False, True))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plain.keys() == bulk.keys() and len(bulk) > 100
    for k, r in plain.items():
        assert bulk[k].length == pytest.approx(r.length, abs=1e-9)
        ends = [[v for x in row.pieces for p in x for v in (p.x, p.y)] for row in (r, bulk[k])]
        assert ends[0] == pytest.approx(ends[1], abs=1e-9)


def test_street_sides_gather_no_lists(spark):
    """What covers a side is added up as numbers: a list of clipped rings for each side is what took the time."""
    rows = [(k, [(k * 20.0, 0.0), (k * 20.0 + 20, 0.0), (k * 20.0 + 20, 20.0), (k * 20.0, 20.0)]) for k in range(50)]
    found = zoning.side_streets(spark.createDataFrame(rows, f"k int, ring {g.RING}"), "k", "ring", 20.0, step=2.0)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text and "NestedLoop" not in text
    got = {(r.key, r.side): r.width for r in found.collect()}
    assert got == {(k, s): 20.0 for k in range(50) for s in range(4) if s in (0, 2) or (k, s) in ((0, 3), (49, 1))}


def test_street_sides_of_odd_rows(spark):
    """Null and empty rings and sides without length have no street; a triangle's are bounded by its neighbours' lines."""
    rows = [(1, None), (2, []), (3, [(0.0, 0.0), (0.0, 0.0), (10.0, 0.0), (0.0, 10.0)])]
    found = zoning.side_streets(spark.createDataFrame(rows, f"k int, ring {g.RING}"), "k", "ring", 20.0)
    assert {(r.key, r.side): r.width for r in found.collect()} == {(3, 1): 20.0, (3, 2): 20.0, (3, 3): 20.0}
