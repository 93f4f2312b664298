"""Optimisation operators against stored values and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwright.functions import geometry as g
from lotwright.operators import capacity, economics, geo_udf, graph, kernel, zoning
from tests import plain

TYPES = {"util": [40, 60, 80, 110], "interior": [36, 54, 72, 99], "terrace": [8, 12, 16, 22], "parking": [1, 1, 1, 2], "storage": [1, 1, 1, 1], "price": [3600, 5100, 6600, 8800]}
PROJECT = {"land": 1500.0, "base": 600.0, "max_coverage": 750.0, "floors": 7, "max_units": 60, "common_share": 0.2, "return": 1.2, "far": 1.0}


def test_best_mix():
    b = plain.best_mix(TYPES, PROJECT)
    assert b["per_floor"] == [0, 2, 5, 0] and b["mix"] == [0, 12, 30, 0]
    assert b["price"] == pytest.approx(15.2772597442)
    assert b["sales"] / plain.total_cost(b, b["price"]) == pytest.approx(1.2)
    assert (b["util"], b["common"], b["parking"]) == (3120, 768, 42)


def test_best_mix_equals_enumeration():
    types = {k: np.array(v, float) for k, v in TYPES.items()}
    project = PROJECT | {"floors": 4, "max_units": 18}
    best = max(
        (f["price"] for c in itertools.product(range(7), repeat=4) if (f := plain.evaluate(3.0 * np.array(c), types, project))["price"] >= 0 and plain.allowed(3 * np.array(c), types, project, f)),
        default=None,
    )
    got = plain.best_mix(TYPES, project)
    assert (got is None and best is None) or got["price"] == pytest.approx(best)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([[1, 1, 0], [0, 1, 1]], [2]),
        ([[1, 1, 0, 0], [0, 1, 1, 0], [0, 1, 0, 1], [1, 1, 1, 0], [1, 1, 0, 1], [0, 1, 1, 1]], [2]),
        ([[1, 1, 1, 0], [0, 1, 1, 1], [1, 1, 1, 1]], [2, 3]),
        ([[1, 1, 0, 0], [0, 1, 1, 0], [1, 1, 1, 0], [1, 1, 0, 1], [0, 1, 1, 1], [1, 1, 1, 1]], [2]),
        ([[1, 1, 0, 0], [0, 0, 1, 1]], [1, 2, 3, 4]),
        ([[1, 0], [0, 1]], [1, 2]),
    ],
)
def test_strategic_lots(rows, want):
    found = plain.strategic([sum(b << k for k, b in enumerate(r)) for r in rows], len(rows[0]))
    assert [k + 1 for k in range(len(rows[0])) if found >> k & 1] == want


def test_pricing():
    c = np.array([[1, 1, 0], [0, 1, 1]])
    market = np.array([68495.1977872724, 76735.6739262459, 57523.6746797915])
    area, value = np.array([1675, 1800, 1424.0]), np.array([145230.87171351828, 134259.34860603738])
    assert plain.lot_values(c, area, value) == pytest.approx([70003.36981875, 75098.13353862, 59300.65521557])
    limits = plain.bounds(c.astype(float), market, area, value, 0.1, 0.2)
    first = plain.expected_utility(*plain.start(limits), c.astype(float), market, limits)
    assert first == pytest.approx(-41.6309453904)
    assert plain.optimise(c, market, area, value)[2] >= first
    assert (plain.marginal_lot_values(c, market, area, value) >= -1e-6).all()


def test_node_sets():
    block = {1: {2, 3}, 2: {1, 3}, 3: {1, 2}, 4: {5, 6}, 5: {4, 7}, 7: {5, 6}, 6: {4, 7}}
    assert len(graph.path_sets(block, 99)) == 20 == len(graph.connected_sets(block, 99))
    star = {1: {2, 3, 4}, 2: {1}, 3: {1}, 4: {1}}
    assert len(graph.path_sets(star, 99)) == 10 and len(graph.connected_sets(star, 99)) == 11
    assert len(graph.path_sets(star, 2)) == 7


@pytest.mark.parametrize("template", capacity.TEMPLATES)
def test_footprints_stay_in_their_limits(template):
    low, high = capacity.limits(template, (1, 5), np.array([[0, 0], [50, 50.0]]), 7.0, 60.0, (8.0, 20.0))
    wings = capacity.footprint(template, (low + high) / 2, 7.0)
    assert len(low) == len(high) and (low <= high).all()
    assert kernel.union_area([[w] for w in wings]) > 0
    assert max(capacity.width_places(template)) < len(low)


def test_search_is_feasible_and_repeatable(spark):
    from pyspark.sql import functions as F

    from lotwright.functions import geometry as g

    rows = spark.range(4).select((F.col("id") + 1).alias("key"), F.array(g.box(0, 0, F.col("id") * 5 + 30, 30)).alias("build"), F.lit(4).alias("max_floors"), F.lit(12.0).alias("max_height"), F.lit(900.0).alias("max_coverage"), F.lit(9000.0).alias("max_built"))
    a, b = (capacity.best_building(rows.repartition(n), steps=60, restarts=1, refine=60).orderBy("key").collect() for n in (1, 4))
    assert a == b
    assert all(r.status in (capacity.DONE, capacity.LOW, capacity.INFEASIBLE) for r in a)
    assert all(r.residual ** 1.1 <= 1e-3 for r in a if r.status == capacity.DONE)


def test_shadow_and_streets():
    square = [np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)]
    assert kernel.area(zoning.building_shadow(square, 4.9, "p")) == pytest.approx(200)
    assert kernel.area(zoning.envelope_shadow([(0.0, square), (4.9, square)], "o")) == pytest.approx(200)
    north = [np.array([[0, 10.0], [10, 10], [10, 40], [0, 40]])]
    found = zoning.streets(square, north, 20.0)
    assert found["sides"] == [0, 1, 3] and all(w >= 10 for w in found["widths"])
    assert kernel.area(found["gross"]) > 100
    assert len(zoning.prism_faces([(0.0, square[0]), (3.0, square[0])])) == 5
    assert plain.disabled_parking(45) == 2 and math.isclose(plain.disabled_parking(600), 6.0)


def test_unconnected_parts_are_priced_apart():
    rng = np.random.default_rng(2)
    one, two = np.array([[1, 1, 0], [0, 1, 1]]), np.array([[1, 1], [1, 0]])
    c = np.zeros((4, 6), int)
    c[:2, :3], c[2:, 3:5] = one, two
    market, area, value = rng.uniform(50, 70, 6), rng.uniform(10, 20, 6), np.array([150.0, 140.0, 160.0, 90.0])
    lots, combos, utility = plain.optimise(c, market, area, value)
    a = plain.optimise(one, market[:3], area[:3], value[:2])
    b = plain.optimise(two, market[3:5], area[3:5], value[2:])
    assert utility == pytest.approx(a[2] + b[2]) and lots[5] == market[5]
    assert lots[:5] == pytest.approx(np.concatenate([a[0], b[0]])) and combos == pytest.approx(np.concatenate([a[1], b[1]]))
    assert [(r.tolist(), k.tolist()) for r, k in plain.blocks_of(c)] == [([0, 1], [0, 1, 2]), ([2, 3], [3, 4])]
    # A lot of one part takes nothing from the other.
    whole = plain.marginal_lot_values(c, market, area, value)
    assert whole[:3] == pytest.approx(plain.marginal_lot_values(one, market[:3], area[:3], value[:2]), abs=1e-6) and whole[5] == pytest.approx(0)


def test_bids_against_a_grid():
    c, market, area, value = np.array([[1, 1]]), np.array([60.0, 50.0]), np.array([10.0, 10.0]), np.array([150.0])
    lots, combos, utility = plain.optimise(c, market, area, value)
    limits = plain.bounds(c.astype(float), market, area, value, 0.1, 0.2)
    own = plain.lot_values(c, area, value)
    mid = plain.start(limits)
    axes = [np.linspace(min(a, m), max(b, m), 25) for a, b, m in zip([*market, value[0] * 0.8], [*own, value[0] * 1.2], [*mid[0], *mid[1]], strict=True)]
    best = max(plain.expected_utility(np.array([x, y]), np.array([z]), c.astype(float), market, limits) for x in axes[0] for y in axes[1] for z in axes[2])
    assert utility >= best - 1e-6 * abs(best)


def test_components_raise_where_they_do_not_settle(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "u bigint, v bigint")
    with pytest.raises(RuntimeError):
        graph.components(path, rounds=1)
    assert graph.components(path).where("component = 0").count() == 41


def test_shapes_with_rings_of_different_sizes(spark):
    wkt = spark.createDataFrame([("POLYGON((0 0,4 0,4 4,0 4,0 0))", "POLYGON((10 0,14 0,10 4,10 0))")], "a string, b string")
    shapes = wkt.select(F.concat(g.from_wkt(F.col("a")), g.from_wkt(F.col("b"))).alias("s"))
    row = shapes.select(g.shape_area(geo_udf.union(F.col("s"), F.col("s"))).alias("area"), g.shape_area(geo_udf.hull(F.col("s"))).alias("hull")).first()
    assert row.area == pytest.approx(24) and row.hull > 24
    kept = geo_udf.dissolve(shapes.withColumn("k", F.lit(1)), ["k"], "s").select(g.shape_area(F.col("s"))).first()[0]
    assert kept == pytest.approx(24)
