"""Node sets, strategic lots, mixes, numbering and changes of partitions against plain counts and the definitions."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwright.operators import capacity, economics, graph, locations, lots, numbering, pricing, relational
from lotwright.plans import pipeline
from lotwright.sources import tables
from tests import plain
from tests.test_decisions import PROJECT, TYPES


def sets_of(df):
    return sorted((r.g, tuple(r.nodes)) for r in df.collect())


def test_node_sets_of_stars_and_rings(spark):
    star, ring = [(1, 1, k) for k in (2, 3, 4)], [(2, 1, 2), (2, 2, 3), (2, 1, 3), (2, 4, 5), (2, 5, 7), (2, 6, 7), (2, 4, 6)]
    edges = spark.createDataFrame(star + ring + [(2, 1, 1), (2, 2, 1)], "g int, u int, v int")
    count = lambda *a, **k: {r.g: r["count"] for r in graph.node_sets(edges, "g", *a, **k).groupBy("g").count().collect()}
    assert count(7) == {1: 10, 2: 20} and count(7, "connected") == {1: 11, 2: 20}
    # At most two vertices: four of a star alone and three pairs.
    assert count(2)[1] == 7
    for mode in ("paths", "connected"):
        assert sets_of(graph.node_sets(edges, "g", 4, mode)) == sets_of(graph.node_sets_by_graph(edges, "g", 4, mode))
    paths = graph.simple_paths(edges, "g", 3)
    assert paths.where("g = 1").count() == 4 + 6 + 6
    with pytest.raises(ValueError, match="unknown mode"):
        graph.node_sets(edges, "g", 3, "walks")


def test_node_sets_where_paths_are_millions(spark):
    """Of 16 vertices that all meet there are 6,340,000 paths of six; sets by their number."""
    edges = spark.createDataFrame([(1, a, b) for a in range(16) for b in range(a)], "g int, u int, v int")
    found = graph.node_sets(edges, "g", 6)
    assert {r.n: r["count"] for r in found.groupBy(F.size("nodes").alias("n")).count().collect()} == {k: math.comb(16, k) for k in range(1, 7)}


def test_node_sets_by_weight(spark):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(9), 2))) for _ in range(14)})
    weight = {k: rng.randint(1, 9) for k in range(9) if k != 4}
    edges = spark.createDataFrame([(1, *p) for p in pairs], "g int, u int, v int")
    weights = spark.createDataFrame([(1, k, float(w)) for k, w in weight.items()], "g int, vertex int, weight double")
    for mode in ("paths", "connected"):
        every = [s for _, s in sets_of(graph.node_sets_by_graph(edges.where("u <> 4 and v <> 4"), "g", 5, mode))]
        got = [s for _, s in sets_of(graph.node_sets(edges, "g", 5, mode, weights, 15.0)) if len(s) > 1]
        assert got == [s for s in every if len(s) > 1 and sum(weight[k] for k in s) <= 15]


def definition(combos, every):
    """The smallest set by trying all, ties to the smallest number."""
    for size in range(len(every) + 1):
        fit = []
        for s in itertools.combinations(range(len(every)), size):
            chosen = {every[k] for k in s}
            outside = set(every) - chosen
            if all(c & chosen for c in combos) and all(any(k not in c and chosen <= c for c in combos) for k in outside):
                fit.append(sum(1 << k for k in s))
        if fit:
            return [every[k] for k in range(len(every)) if min(fit) >> k & 1]


def test_strategic_lots_by_definition(spark):
    rng, rows, want = random.Random(6), [], {}
    for place in range(40):
        combos = [set(rng.sample(range(6), rng.randint(1, 5))) for _ in range(rng.randint(1, 6))]
        good = [rng.random() < 0.8 for _ in combos]
        rows += [(place, k, 10 + lot, rng.choice([1, 2]) if g else rng.choice([0, -1, None])) for k, (c, g) in enumerate(zip(combos, good, strict=True)) for lot in c]
        every = sorted(set.union(*combos))
        chosen = [c for c, g in zip(combos, good, strict=True) if g]
        want[place] = [10 + k for k in definition(chosen, every)] if chosen else [lots.NO_SOLUTION]
    # The three kinds of locations without a choice, repeated rows and no location.
    rows += [(90, 1, None, 0), (91, 1, None, 1), (92, 1, 5, 0), (None, 1, 5, 1), rows[0]]
    want |= {90: [lots.NO_COMBOS], 91: [], 92: [lots.NO_SOLUTION]}
    found = lots.strategic_lots(spark.createDataFrame(rows, "location int, combo int, lot int, sign int"))
    assert {r.location: list(r.lots) for r in found.collect()} == want


def test_strategic_lots_of_matrices(spark):
    cases = [
        (["110", "011"], [2]),
        (["1100", "0110", "0101", "1110", "1101", "0111"], [2]),
        (["1110", "0111", "1111"], [2, 3]),
        (["1100", "0110", "1110", "1101", "0111", "1111"], [2]),
        (["1100", "0011"], [1, 2, 3, 4]),
        (["10", "01"], [1, 2]),
    ]
    rows = [(k, c, lot + 1, 1) for k, (m, _) in enumerate(cases) for c, row in enumerate(m) for lot, on in enumerate(row) if on == "1"]
    # Locations of 40 and of 130 lots: chains whose combos all hold the middle.
    for k, n in ((40, 40), (41, 130)):
        rows += [(k, c, lot, 1) for c in range(n // 2) for lot in range(c, c + n // 2 + 1)]
    found = {r.location: list(r.lots) for r in lots.strategic_lots(spark.createDataFrame(rows, "location int, combo int, lot int, sign int")).collect()}
    assert [found[k] for k in range(len(cases))] == [w for _, w in cases]
    assert found[40] == [19, 20] and found[41] == [64, 65]


def test_best_prices_equal_the_recursion(spark):
    rng = random.Random(4)
    rows = [(k, 1200.0 + 100 * k, 300.0 + 60 * (k % 6), 750.0, float(rng.randint(1, 7)), float(rng.randint(5, 70)), rng.choice([0.1, 0.2]), rng.choice([1.05, 1.2, 3.0]), rng.choice([-1.0, 1.0])) for k in range(14)]
    names = ["land", "base", "max_coverage", "floors", "max_units", "common_share", "return", "far"]
    types = TYPES | {"util": [40, 60, 80, 150]}
    got = {r.key: r for r in economics.best_prices(spark.createDataFrame(rows, ["key", *names]), "key", types).collect()}
    assert len(got) == len(rows)
    for row in rows:
        project = dict(zip(names, row[1:], strict=True)) | {"floors": int(row[4])}
        want = plain.best_mix({k: np.array(v, float) for k, v in types.items()}, project)
        r = got[row[0]]
        assert r.feasible == (want is not None)
        if want:
            assert r.price == pytest.approx(want["price"]) and r.sales == pytest.approx(want["sales"]) and list(r.mix) == want["mix"]
            assert (r.util, r.common, r.parking) == pytest.approx((want["util"], want["common"], want["parking"]))
    assert sum(r.feasible for r in got.values()) > 3
    one = spark.createDataFrame([(1, *[float(PROJECT[n]) for n in names])], ["key", *names])
    r = economics.best_prices(one, "key", TYPES).first()
    assert list(r.per_floor) == [0, 2, 5, 0] and r.price == pytest.approx(15.2772597442, abs=1e-9)


def test_costs_of_a_table(spark):
    row = economics.cost_row(spark.createDataFrame([("slab_above", 30.0), ("unknown", 1.0)], economics.COSTS)).first().costs
    assert row.slab_above == 30.0 and row.slab_below == economics.UNIT_COSTS["slab_below"]


def test_numbers_without_gaps(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]) if k % 3 else 2, k, rng.random()) for k in range(900)]
    df = spark.createDataFrame(rows, "a int, b int, c double").repartition(7)
    found = numbering.numbered(df, ["a", "b"], "n", 5)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.a, r.b) for r in found.orderBy("n").collect()] == [r[:2] for r in order]
    assert [r.n for r in found.orderBy("n").collect()] == list(range(5, 905))
    assert numbering.numbered(df.limit(0), ["a"]).collect() == []
    down = relational.every_kth(df, None, [F.desc("b")], 100)
    assert sorted((r["rank"], r.b) for r in down.collect()) == [(k, 900 - k) for k in range(100, 901, 100)]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_partitions_that_are_met_are_written(spark, tmp_path):
    path = str(tmp_path / "combos")
    rows = [(k, capacity.PENDING if k % 4 < 2 else capacity.ECONOMIC, k % 4) for k in range(40)] + [(99, capacity.PENDING, None)]
    spark.createDataFrame(rows, "combo int, status int, part int").write.partitionBy("part").parquet(path)
    before = files(path)
    outcomes = spark.createDataFrame([(k, ["done", "error", "infeasible", "low", "what"][k // 4 % 5]) for k in range(36)] + [(0, "done"), (99, "done")], "combo int, outcome string")
    assert pipeline.settle(spark, path, ["part"], "volumetric", outcomes) == 3
    after = files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert same == {f for f in before if "part=2" in f or "part=3" in f}
    want = {r[0]: r[1] for r in rows}
    names = [capacity.DONE, capacity.ERROR, capacity.INFEASIBLE, capacity.LOW, capacity.PENDING]
    want |= {k: names[k // 4 % 5] for k in range(36) if k % 4 < 2} | {99: capacity.DONE}
    assert {r.combo: r.status for r in spark.read.parquet(path).collect()} == want
    # Runs look for their own status only; a run that finds none touches nothing.
    every = spark.createDataFrame([(k, "done" if k % 8 else "error") for k in range(100)], "combo int, outcome string")
    pipeline.settle(spark, path, ["part"], "provisional", every)
    pipeline.settle(spark, path, ["part"], "economic", every)
    for status, ok, bad in ((capacity.DONE, capacity.PROVISIONAL, capacity.PROVISIONAL_ERROR), (capacity.PROVISIONAL, capacity.ECONOMIC, capacity.ECONOMIC_ERROR)):
        want = {k: (ok if k % 8 else bad) if s == status else s for k, s in want.items()}
    assert {r.combo: r.status for r in spark.read.parquet(path).collect()} == want
    assert tables.modify_partitions(spark, path, ["part"], lambda rows: rows, F.col("combo") > 1000) == 0
    pipeline.reset(spark, path, ["part"])
    assert {r.status for r in spark.read.parquet(path).collect()} == {capacity.PENDING}


def test_outlines_of_locations(spark):
    from lotwright.functions import geometry as g

    boxes = {1: (0, 0, 10, 10), 2: (10, 0, 20, 10), 3: (0, 10, 10, 20), 4: (20, 10, 30, 20)}
    parcels = spark.createDataFrame([(k, [[(float(x), float(y)) for x, y in ((a, b), (c, b), (c, d), (a, d))]]) for k, (a, b, c, d) in boxes.items()], f"lot int, shape {g.SHAPE}")
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 1), (2, 2), (2, 4)], "location int, lot int")
    got = {r.location: [[(p.x, p.y) for p in ring] for ring in r.shape] for r in locations.location_outlines(members, parcels).collect()}
    assert got[1] == [[(0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20)]]
    # Lots that meet in a corner are two regions.
    assert sorted(len(r) for r in got[2]) == [4, 4]
    found = locations.regions(members.join(parcels, "lot"), ["location"], "shape").collect()
    assert {r.location: (r.regions, r.one_region, round(r.area, 6)) for r in found} == {1: (1, True, 300.0), 2: (2, False, 200.0)}


def test_utilities_equal_the_matrix_form(spark):
    rng, rows, want, marginal = random.Random(8), [], {}, {}
    for place in range(8):
        n = rng.randint(2, 5)
        market, area = [rng.uniform(50, 90) for _ in range(n)], [rng.uniform(10, 20) for _ in range(n)]
        combos = sorted({tuple(sorted(rng.sample(range(n), rng.randint(1, 2)))) for _ in range(rng.randint(1, 4))})
        value = [rng.uniform(90, 200) for _ in combos]
        # Combos have the same numbers at every location, lots too.
        rows += [(place, k, lot, market[lot], area[lot], value[k]) for k, cs in enumerate(combos) for lot in cs]
        used = sorted({lot for cs in combos for lot in cs})
        c = np.array([[int(lot in cs) for lot in used] for cs in combos])
        m, a, v = np.array([market[k] for k in used]), np.array([area[k] for k in used]), np.array(value)
        want[place] = plain.start_utility(c, m, a, v)
        for j, lot in enumerate(used):
            left = c[:, j] == 0
            still = c[left].sum(axis=0) > 0
            rest = plain.start_utility(c[left][:, still], m[still], a[still], v[left]) if left.any() else 0.0
            marginal[place, lot] = want[place] - rest
    df = spark.createDataFrame(rows, "location bigint, combo bigint, lot bigint, market double, area double, combo_value double")
    assert {r.location: r.utility for r in pricing.utilities(df, ["location"]).collect()} == pytest.approx(want)
    assert {(r.location, r.lot): r.value for r in pricing.marginal_utilities(df).collect()} == pytest.approx(marginal)
    one = df.where("location = 0")
    bids = one.select("location", "lot", F.col("market").alias("price")).distinct()
    lots_, combos_ = pricing.price_limits(one, ["location"])
    prices = combos_.select("location", "combo", F.col("low").alias("price"))
    got = pricing.utilities(one, ["location"], bids, prices).first().utility
    own = [r for r in rows if r[0] == 0]
    used, names = sorted({r[2] for r in own}), sorted({r[1] for r in own})
    c = np.array([[int(any(r[1] == k and r[2] == lot for r in own)) for lot in used] for k in names])
    m, a, v = (np.array([next(r[i] for r in own if r[j] == x) for x in xs]) for i, j, xs in ((3, 2, used), (4, 2, used), (5, 1, names)))
    total = 0.0
    for rr, cc in plain.blocks_of(c):
        part = c[np.ix_(rr, cc)].astype(float)
        limits = plain.bounds(part, m[cc], a[cc], v[rr], 0.1, 0.2)
        total += plain.expected_utility(m[cc], limits[2], part, m[cc], limits)
    assert got == pytest.approx(total)


def test_bids_are_as_good_as_the_search(spark):
    rng, rows, want = random.Random(9), [], {}
    for place in range(10):
        n = rng.randint(1, 6)
        market, area = [rng.uniform(50, 90) for _ in range(n)], [rng.uniform(10, 20) for _ in range(n)]
        combos = sorted({tuple(sorted(rng.sample(range(n), rng.randint(1, min(n, 3))))) for _ in range(rng.randint(1, 5))})
        value = [sum(market[k] for k in cs) * rng.uniform(0.8, 1.5) for cs in combos]
        rows += [(place, k, lot, market[lot], area[lot], value[k]) for k, cs in enumerate(combos) for lot in cs]
        used = sorted({lot for cs in combos for lot in cs})
        c = np.array([[int(lot in cs) for lot in used] for cs in combos])
        args = np.array([market[k] for k in used]), np.array([area[k] for k in used]), np.array(value)
        want[place] = (c, *args, used, plain.optimise(c, *args)[2], plain.start_utility(c, *args))
    df = spark.createDataFrame(rows, "location bigint, combo bigint, lot bigint, market double, area double, combo_value double")
    for r in pricing.optimal_bids(df).collect():
        c, m, a, v, used, best, first = want[r.location]
        assert list(r.lots) == used and r.start_utility == pytest.approx(first)
        assert r.utility >= best - 1e-4 * max(1.0, abs(best)) and r.utility >= r.start_utility - 1e-9
        # What is told is what the bids and prices earn.
        total = 0.0
        for rr, cc in plain.blocks_of(c):
            part = c[np.ix_(rr, cc)].astype(float)
            limits = plain.bounds(part, m[cc], a[cc], v[rr], 0.1, 0.2)
            total += plain.expected_utility(np.array(r.bids)[cc], np.array(r.prices)[rr], part, m[cc], limits)
        assert r.utility == pytest.approx(total)


def test_marginal_bids_and_parking(spark):
    c = np.array([[1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 0, 1]])
    args = np.array([60.0, 75.0, 50.0, 80.0]), np.array([10.0, 12.0, 9.0, 14.0]), np.array([150.0, 140.0, 90.0])
    rows = [(5, k, lot, *(float(x[lot]) for x in args[:2]), float(args[2][k])) for k, lot in zip(*np.nonzero(c), strict=True)]
    rows = [(a, int(b), int(d), *rest) for a, b, d, *rest in rows]
    df = spark.createDataFrame(rows, "location bigint, combo bigint, lot bigint, market double, area double, combo_value double")
    want = plain.marginal_lot_values(c, *args)
    got = {r.lot: r.value for r in pricing.marginal_values(df).collect()}
    assert [got[k] for k in range(4)] == pytest.approx(want.tolist(), abs=1e-3)
    spaces = spark.range(1).select(*[economics.disabled_spaces(F.lit(n)) for n in (20, 45, 500, 600)]).first()
    assert list(spaces) == pytest.approx([plain.disabled_parking(n) for n in (20, 45, 500, 600)])
