"""Outlines of small groups in tasks: the same as by the joins, without their exchanges, also far from the origin."""

import numpy as np
import pytest

from lotwright.functions import geometry as g
from lotwright.operators import dissolve, outlines, overlay
from lotwright.plans import catalogue

DIR = "/root/testdata/sf0.001"


def _rows(df, keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def _same(one, two, keys):
    a, b = _rows(one, keys), _rows(two, keys)
    assert a.keys() == b.keys() and a
    for k, r in a.items():
        assert (r.rings, r.holes, r.corners) == (b[k].rings, b[k].holes, b[k].corners), k
        assert (r.area, r.perimeter) == pytest.approx((b[k].area, b[k].perimeter), abs=1e-6), k


def _turned(ring, x0=0.0, y0=0.0):
    return [(x0 + (3 * x - 4 * y) / 5, y0 + (4 * x + 3 * y) / 5) for x, y in ring]


def _box(x, y, w, h):
    return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]


def _tiles():
    """Turned squares with gaps, some cut in two, some turned over or double, null keys and shapes, holes within shapes."""
    rng, rows = np.random.default_rng(3), []
    for group in range(30):
        for x in range(5):
            for y in range(5):
                kind = rng.integers(0, 6)
                parts = [] if kind == 0 else [_box(x * 5, y * 5, 5, 5)] if kind < 4 else [_box(x * 5, y * 5, 2, 5), _box(x * 5 + 2, y * 5, 3, 5)]
                for ring in parts:
                    ring = _turned(ring)
                    rows += [(group, str(group % 2), [ring[::-1] if kind == 2 else ring])] * (2 if kind == 3 else 1)
    frame = [_turned(_box(0, 0, 30, 30)), _turned(_box(5, 5, 10, 10))[::-1]]
    return [*rows, (100, "a", frame), (None, "a", frame), (101, None, frame), (102, "a", None), (103, "a", [])]


def test_dissolved_in_tasks_as_by_joins(spark):
    df = spark.createDataFrame(_tiles(), f"k int, side string, s {g.SHAPE}")
    keys = ["k", "side"]
    _same(dissolve.measured(df, keys, "s"), dissolve.measures(dissolve.rings(df, keys, "s"), keys), keys)


def test_larger_groups_go_by_the_joins(spark, monkeypatch):
    monkeypatch.setattr(outlines, "SMALL", 60)
    df = spark.createDataFrame(_tiles()[:200], f"k int, side string, s {g.SHAPE}")
    found = dissolve.measured(df, ["k"], "s")
    assert "Union" in found._jdf.queryExecution().toString()
    _same(found, dissolve.measures(dissolve.rings(df, ["k"], "s"), ["k"]), ["k"])


def _random(rng):
    """A triangle, a box or a notched ring on whole numbers and halves, maybe turned over."""
    x, y = rng.integers(0, 20, 2) / 2
    w, h = rng.integers(2, 12, 2) / 2 + 0.5
    ring = [_box(x, y, w, h), [(x, y), (x + w, y + 0.5), (x + 1, y + h)], [(x, y), (x + w, y), (x + w, y + h), (x + w / 2, y + h / 3), (x, y + h)]][rng.integers(0, 3)]
    ring = [(float(a), float(b)) for a, b in ring]
    return ring[::-1] if rng.integers(0, 3) == 0 else ring


def test_unions_in_tasks_as_by_joins(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), [_random(rng)]) for k in range(25) for _ in range(k % 9 + 1)]
    df = spark.createDataFrame([*rows, *rows[:40], (None, rows[0][1]), (1, None)], f"k int, s {g.SHAPE}")
    _same(overlay.merged_measures(df, ["k"], "s"), dissolve.measures(dissolve.points_of(overlay.merged(df, ["k"], "s"), ["k"]), ["k"]), ["k"])


@pytest.mark.parametrize("small", [20_000, 7])
def test_overlays_in_tasks_as_by_joins(spark, monkeypatch, small):
    monkeypatch.setattr(outlines, "SMALL", small)
    rng = np.random.default_rng(7)
    hole = [_box(0, 0, 9, 9), _box(3, 3, 3, 3)[::-1]]
    rows = [(k, [_random(rng)], [_random(rng)]) for k in range(40)] + [(90, hole, [_box(2, 2, 5, 2)]), (91, [_box(0, 0, 1, 1)], [_box(5, 5, 1, 1)]), (92, None, [_box(0, 0, 1, 1)]), (93, [_box(0, 0, 2, 2)], [_box(0, 0, 2, 2)]), (None, hole, hole)]
    df = spark.createDataFrame(rows, f"k int, a {g.SHAPE}, b {g.SHAPE}")
    kinds = ["union", "intersection", "difference"]
    found = overlay.measured(df, ["k"], "a", "b", kinds)
    assert found.count() == len(rows) - 1
    for kind in kinds:
        one = found.where(f"{kind} IS NOT NULL").select("k", f"{kind}.*")
        _same(one, dissolve.measures(overlay.rings(df, ["k"], "a", "b", kind), ["k"]), ["k"])


def test_areas_far_from_the_origin(spark):
    """At 100,000 km products of whole centimetres are larger than 64 bits hold."""
    df = spark.createDataFrame([(1, [_turned(_box(0, 0, 30, 20), 1e8, 1.4e8)])], f"k int, s {g.SHAPE}")
    for found in (dissolve.measured(df, ["k"], "s"), dissolve.measures(dissolve.rings(df, ["k"], "s"), ["k"])):
        r = found.first()
        assert (r.area, r.perimeter, r.rings, r.holes, r.corners) == (pytest.approx(600, abs=1e-6), pytest.approx(100, abs=1e-6), 1, 0, 4)


@pytest.mark.parametrize("name", ["box_union_area", "envelope_shadows", "row_outlines", "cell_outlines", "regions_of_lots"])
def test_queries_do_without_joins(spark, name):
    """Their groups are small: sides, pieces and rings are not exchanged."""
    plan = catalogue.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_forks_are_overlaid_once(spark):
    plan = catalogue.queries()["fork_overlays"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "MapInArrow" in plan
