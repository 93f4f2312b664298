"""Street sides tile by tile: one exchange, and the same wherever tiles are cut."""

import numpy as np
import pytest

from lotwright.functions import geometry as g
from lotwright.operators import zoning
from lotwright.plans import catalogue


def _found(spark, dx, dy):
    rng, rows = np.random.default_rng(2), []
    for k in range(60):
        x, y, w, h = k % 10 * 40, k // 10 * 45, int(rng.integers(8, 36)), int(rng.integers(8, 30))
        rows.append((k, x, y, w, h))
    # One as long as several tiles' reach, beside the others.
    rows += [(100, -10, -700, 30, 1500), (101, 25, -60, 400, 40)]
    rows = [(k, [(float(a + dx), float(b + dy)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]) for k, x, y, w, h in rows]
    found = zoning.side_streets(spark.createDataFrame([*rows, (200, None)], f"k int, ring {g.RING}"), "k", "ring", 20.0, step=2.0)
    return sorted(map(tuple, found.collect()))


def test_the_same_wherever_tiles_are_cut(spark):
    one = _found(spark, 300, 900)
    assert len(one) > 150 and {100, 101} <= {r[0] for r in one} and len({r[2] for r in one}) > 3
    for dx, dy in ((2048 - 190, 4096 - 100), (-130, -140)):
        assert _found(spark, dx, dy) == one


def test_one_exchange_by_tiles(spark):
    """Neither a join nor sums of areas are exchanged."""
    plan = catalogue.queries()["sides_on_streets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(_level") == 1


def test_reaches_hold_what_lies_in_front():
    """Bounds grown by the radius where no corner is sharp; a triangle's reach goes further."""
    x, y, sizes = np.array([0.0, 3, 2.2, -0.8, 0, 10, 0]), np.array([0.0, 4, 4.6, 0.6, 0, 0, 2]), np.array([4, 3])
    quick, exact = zoning._reaches(x, y, sizes, 5.0), zoning._exact_reaches(x, y, sizes, 5.0)
    assert (quick[:2] <= exact[:2] + 1e-9).all() and (quick[2:] >= exact[2:] - 1e-9).all()
    assert quick[:, 0] == pytest.approx([-5.8, -5, 8, 9.6], abs=1e-4) and quick[2, 1] > 15.1
