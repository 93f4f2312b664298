"""Queries of the spatial, graph, zoning and decision operators, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.numbers import q6, q6_sql
from ..operators import borders, capacity, dissolve, economics, graph, locations, lots, overlay, pricing, spatial_join, zoning
from ..operators.rounds import dealt, spread, tasks_for
from ..sources import export
from . import pipeline
from .geometry_queries import BOX_SQL, boxes
from .reading import reader

QUERIES, SQL = {}, {}
q = q6_sql


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(reader(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _bounds(prefix: str = ""):
    x, y, w, h = (F.col(f"{prefix}{c}") for c in "xywh")
    return F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def _side(b, prefix: str):
    """The boxes with other column names and their shape."""
    b = b.select(*[F.col(c).alias(f"{prefix}{c}") for c in "kxywh"])
    x, y, w, h = (F.col(f"{prefix}{c}") for c in "xywh")
    return b.withColumn(f"{prefix}shape", F.array(g.box(x, y, w, h)))


def _stacks(t):
    """The boxes, copies of one place and size in stacks."""
    return spatial_join.stacked(boxes(t).select(*"kxywh"), "k")


_MEET = "a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h"


@query(f"SELECT a.k AS a, b.k AS b FROM {BOX_SQL} a JOIN {BOX_SQL} b ON a.k < b.k AND {_MEET}")
def box_intersects_join(t):
    b = _stacks(t)
    pairs = spatial_join.bounds_join(_side(b, "a"), _side(b, "b"), _bounds("a"), _bounds("b"))
    return spatial_join.unstacked(pairs.select(F.col("ak").alias("a"), F.col("bk").alias("b")), "a", "b").where("a < b")


@query(f"SELECT a.k AS a, count(*) AS n FROM {BOX_SQL} a JOIN {BOX_SQL} b ON {_MEET} GROUP BY a.k")
def parcels_per_block(t):
    """Each different box is counted against all others, times their copies."""
    b = boxes(t)
    some = b.groupBy(*"xywh").agg(F.count(F.lit(1)).alias("k"))
    met = spatial_join.bounds_join(_side(some, "a"), _side(some, "b"), _bounds("a"), _bounds("b")).groupBy(*[F.col(f"a{c}").alias(c) for c in "xywh"]).agg(F.sum("bk").alias("n"))
    return b.join(met.hint("merge"), [*"xywh"]).select(F.col("k").alias("a"), "n")


@query(f"""
WITH p AS (SELECT event_id, CAST(event_id * 37 % 1000 AS DOUBLE) + 0.5 AS px, CAST(event_id * 91 % 1000 AS DOUBLE) + 0.25 AS py FROM events)
SELECT DISTINCT k FROM {BOX_SQL} a JOIN p ON px > x AND px < x + w AND py > y AND py < y + h
""")
def box_contains_points(t):
    key = F.col("event_id")
    points = t("events").select(g.point((key * 37 % 1000) + 0.5, (key * 91 % 1000) + 0.25).alias("p")).distinct()
    b = boxes(t)
    rings = b.select(*"xywh").distinct().withColumn("ring", g.box(*[F.col(c) for c in "xywh"]))
    found = spatial_join.contains_points(rings, points, "ring", "p", _bounds()).select(*"xywh").distinct()
    return b.join(found.hint("merge"), [*"xywh"]).select("k").distinct()


_SUPPLIER = "(SELECT s_suppkey AS j, CAST(s_suppkey * 53 % 1000 AS DOUBLE) AS u, CAST(s_suppkey * 29 % 1000 AS DOUBLE) AS v FROM supplier)"


@query(f"""
SELECT j, k FROM {_SUPPLIER} s JOIN {BOX_SQL} b
ON power(greatest(0, x - u - 4, u - x - w), 2) + power(greatest(0, y - v - 4, v - y - h), 2) <= 225
""")
def dwithin_join(t):
    key = F.col("s_suppkey")
    targets = t("supplier").select(key.alias("j"), F.array(g.box((key * 53 % 1000).cast("double"), (key * 29 % 1000).cast("double"), 4, 4)).alias("target"))
    around = g.bounds(F.element_at("target", 1))
    pairs = spatial_join.dwithin(spatial_join.stacked(targets, "j"), _side(_stacks(t), ""), "target", "shape", around, _bounds(), 15.0)
    return spatial_join.unstacked(pairs.select("j", "k"), "j", "k")


_OVER = "least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)"
_UP = "least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)"


@query(f"SELECT a.k AS a, b.k AS b, {q(f'({_OVER}) * ({_UP})')} AS common, {q(f'a.w * a.h + b.w * b.h - ({_OVER}) * ({_UP})')} AS whole FROM {BOX_SQL} a JOIN {BOX_SQL} b ON a.k < b.k AND {_OVER} > 0 AND {_UP} > 0")
def clip_area(t):
    """Each two different boxes are clipped once, whatever their order and copies."""
    own = _stacks(t)
    sides = [_side(own, n).withColumns({f"{n}area": g.signed_area(F.get(f"{n}shape", F.lit(0))), f"{n}first": F.array_min(f"{n}k")}) for n in "ab"]
    pairs = spatial_join.bounds_join(*sides, _bounds("a"), _bounds("b"))
    order = [F.struct(*[f"{n}{c}" for c in ("y", "w", "h", "first")]) for n in "ab"]
    once = pairs.where((F.col("ax") < F.col("bx")) | (F.col("ax") == F.col("bx")) & (order[0] <= order[1]))
    rings = once.select(F.col("ak").alias("a"), F.col("bk").alias("b"), (F.col("aarea") + F.col("barea")).alias("both"), (F.col("afirst") == F.col("bfirst")).alias("same"), F.get("ashape", F.lit(0)).alias("ra"), F.get("bshape", F.lit(0)).alias("rb"))
    out = spatial_join.with_common_area(rings, "ra", "rb").where("common > 0")
    found = out.select("a", "b", q6("common").alias("common"), q6(F.col("both") - F.col("common")).alias("whole"), "same")
    return spatial_join.unstacked_once(found, "a", "b", F.col("same")).select("a", "b", "common", "whole")


@query("SELECT a.p_partkey // 50 AS block, a.p_partkey AS a, b.p_partkey AS b, CAST(10.0 AS DOUBLE) AS shared FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND b.p_partkey // 50 = a.p_partkey // 50")
def shared_border(t):
    key = F.col("p_partkey")
    parcels = t("part").select(key.alias("parcel"), F.floor(key / 50).alias("block"), F.array(g.box((key % 100) * 10, F.floor(key / 100) % 100 * 10, 10, 10)).alias("shape"))
    found = borders.shared_borders(parcels, "parcel", "block", "shape")
    return found.select("block", "a", "b", q6("shared").alias("shared"))


@query(f"""
WITH b AS (SELECT p_brand, x, x + w AS e FROM {BOX_SQL} JOIN part ON k = p_partkey),
m AS (SELECT *, max(e) OVER (PARTITION BY p_brand ORDER BY x, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
SELECT p_brand, {q("sum(greatest(0, e - greatest(x, coalesce(before, x))))")} AS area FROM m GROUP BY p_brand
""")
def box_union_area(t):
    rows = t("part").select("p_brand", F.array(g.box((F.col("p_partkey") % 100) * 10, 0, F.col("p_size") + 1, 1)).alias("shape"))
    found = overlay.merged_measures(rows, ["p_brand"], "shape")
    return found.select("p_brand", q6("area").alias("area"))


@query("SELECT p_partkey AS combo, CASE WHEN p_partkey = 0 THEN 0 ELSE (p_partkey - 1) // 7 * 7 + 1 END AS location FROM part")
def location_components(t):
    key = F.col("p_partkey")
    members = t("part").select(key.alias("combo"), F.explode(F.when(key % 7 == 0, F.array(key)).otherwise(F.array(key, key + 1))).alias("lot"))
    return locations.locations(members)


_EDGES = "(SELECT a.n_regionkey AS r, a.n_nationkey AS u, b.n_nationkey AS v FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND b.n_nationkey - a.n_nationkey <= 10)"
_PATHS = f"""
WITH RECURSIVE e AS (SELECT r, u, v FROM {_EDGES} UNION ALL SELECT r, v, u FROM {_EDGES}),
p AS (SELECT DISTINCT r, u AS last, [u] AS path FROM e UNION ALL SELECT p.r, e.v, list_append(p.path, e.v) FROM p JOIN e ON p.r = e.r AND p.last = e.u WHERE len(p.path) < 5 AND NOT list_contains(p.path, e.v))
"""


def _edges(t):
    a = t("nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("u"))
    b = t("nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("v"))
    return a.join(b, "r").where("u < v AND v - u <= 10").select("r", "u", "v")


def _text(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


@query(_PATHS + "SELECT r, array_to_string(path, ',') AS path FROM p")
def simple_paths(t):
    return graph.simple_paths(_edges(t), "r", 5).select("r", _text("path").alias("path"))


@query(_PATHS + "SELECT DISTINCT r, array_to_string(list_sort(path), ',') AS nodes FROM p")
def node_combis(t):
    return graph.node_sets(_edges(t), "r", 5).select("r", _text("nodes").alias("nodes"))


@query(_PATHS + "SELECT DISTINCT r, array_to_string(list_sort(path), ',') AS nodes FROM p")
def node_combis_by_block(t):
    return graph.node_sets_by_graph(_edges(t), "r", 5).select("r", _text("nodes").alias("nodes"))


@query(_PATHS + "SELECT path[1]::BIGINT AS vertex, min(last)::BIGINT AS component FROM p GROUP BY path[1]")
def components(t):
    return graph.components(_edges(t))


@query(f"SELECT u, array_to_string(list_sort(list(v)), ',') AS neighbours FROM (SELECT u, v FROM {_EDGES} UNION ALL SELECT v, u FROM {_EDGES}) GROUP BY u")
def neighbours(t):
    return graph.neighbours(_edges(t).select("u", "v")).select("u", _text("neighbours").alias("neighbours"))


@query(f"SELECT r, u, v FROM {_EDGES} WHERE u IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 60) AND v IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 60)")
def induced_subgraph(t):
    return graph.induced_subgraph(_edges(t), t("supplier").where("s_suppkey <= 60"), "s_nationkey")


@query(f"SELECT r, u, v FROM {_EDGES} WHERE u <> 7 AND v <> 7")
def drop_node(t):
    return graph.drop_node(_edges(t), 7)


@query(f"SELECT r, u, v FROM {_EDGES} WHERE v - u BETWEEN 6 AND 10")
def property_filter(t):
    return graph.filter_property(_edges(t).withColumn("gap", F.col("v") - F.col("u")), "gap", 6, 10).drop("gap")


@query("SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS u, greatest(a.l_suppkey, b.l_suppkey) AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey")
def combos_adjacency(t):
    lines = t("lineitem")
    return graph.adjacency_from_combos(lines, "l_orderkey", "l_suppkey", tasks_for(lines.count(), lines.sparkSession))


@query("SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)")
def combos_with_lot(t):
    return graph.combos_with_node(t("lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey", 7)


@query("""
WITH p AS (SELECT p_partkey // 20 AS block, p_partkey AS k, 500.0 + p_partkey % 7 * 300 AS area FROM part),
r AS (SELECT a.block, a.k AS s, b.k AS e FROM p a JOIN p b ON a.block = b.block AND b.k BETWEEN a.k AND a.k + 3)
SELECT r.block, array_to_string(list(k ORDER BY k), ',') AS lots, sum(area) AS area, CAST(count(*) AS INTEGER) AS lot_count, max(area) AS max_lot, min(area) AS min_lot
FROM r JOIN p ON p.block = r.block AND k BETWEEN s AND e GROUP BY r.block, s, e HAVING sum(area) BETWEEN 1200 AND 4000
""")
def lot_combinations(t):
    key = F.col("p_partkey")
    parcels = t("part").select(F.floor(key / 20).alias("block"), key.alias("parcel"), (key % 7 * 300 + 500.0).alias("area"))
    nxt = parcels.select("block", F.col("parcel").alias("b"))
    borders = parcels.select("block", F.col("parcel").alias("a")).join(nxt, "block").where("b = a + 1").withColumn("shared", F.lit(20.0))
    found = locations.combinations(parcels, borders, (400, 3000), (1200, 4000), 4, 18)
    return found.select("block", _text("lots").alias("lots"), "area", "lot_count", "max_lot", "min_lot")


@query(f"SELECT k, {q('(w + 16) * (h + 13)')} AS area FROM {BOX_SQL}")
def setback_area(t):
    b = boxes(t)
    ring = g.box(F.col("x"), F.col("y"), F.col("w") + 20, F.col("h") + 20)
    build = zoning.convex_setback(ring, F.array(F.lit(0)), F.lit(5.0), F.lit(2.0))
    return b.select("k", q6(g.signed_area(build)).alias("area"))


@query(f"""
SELECT k, {q('z')} AS slice_height, {q('(w + 20 - 2 * (z / 2.5)) * (h + 20 - 2 * (z / 2.5))')} AS area
FROM {BOX_SQL}, (SELECT range * 0.1 * 2.5 AS z FROM range(0, 501) UNION ALL SELECT 24.9) s WHERE z <= 24.9
""")
def envelope_slices(t):
    """Slices every 0.1 of the slope's base up to the full height; those of copies of one box are worked out once."""
    b = spread(_stacks(t))
    ring = g.box(F.col("x"), F.col("y"), F.col("w") + 20, F.col("h") + 20)
    b = b.select("k", ring.alias("gross"), ring.alias("build"), F.lit(2.5).alias("slope"), F.lit(24.9).alias("height"))
    found = zoning.convex_envelope(b, "gross", "build", "slope", "height").select("k", q6("slice_height").alias("slice_height"), q6(g.signed_area(F.col("slice"))).alias("area"))
    return spatial_join.unstacked(found, "k")


@query(f"SELECT k, {q('(w + 15.4) * h')} AS west, {q('(h + 4.9) * w')} AS south FROM {BOX_SQL}")
def shadow_area(t):
    b = boxes(t)
    ring = g.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    west, south = (g.signed_area(zoning.convex_shadow(ring, F.lit(7.546), k)) for k in ("p", "s"))
    return b.select("k", q6(west).alias("west"), q6(south).alias("south"))


@query("""
WITH p AS (SELECT p_partkey AS k, CAST(p_size % 8 AS INTEGER) AS f, social, template FROM part, (VALUES ('I', 0), ('L', 1)) v(template, social))
SELECT k, template, CASE WHEN social = 1 AND f IN (3, 4, 5) THEN 4 ELSE f END AS max_floors, CASE WHEN social = 1 AND f IN (3, 4, 5) THEN 125.0 ELSE 100.0 END::DOUBLE AS density, CASE WHEN social = 1 AND f IN (3, 4, 5) THEN -1.0 ELSE 2.0 END::DOUBLE AS far FROM p
""")
def social_plan(t):
    parts = t("part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 8).cast("int").alias("max_floors"), F.lit(100.0).alias("density"), F.lit(30.0).alias("max_height"), F.lit(2.0).alias("far"), F.lit(0.5).alias("coverage"))
    plan = parts.sparkSession.createDataFrame([("I", 0), ("L", 1)], "template string, social int")
    return zoning.with_social_plan(parts, plan).select("k", "template", "max_floors", "density", "far")


_LOTS = "(SELECT o_custkey AS location, o_orderkey AS combo, l_partkey AS lot FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"""
WITH m AS (SELECT DISTINCT * FROM {_LOTS}), l AS (SELECT DISTINCT location, lot, (lot % 10 + 1) / 12.0 AS p FROM m), c AS (SELECT DISTINCT location, combo FROM m)
SELECT c.location, c.combo, {q("product(CASE WHEN m.lot IS NULL THEN 1 - p ELSE p END) * 1e6")} AS probability
FROM c JOIN l ON c.location = l.location LEFT JOIN m ON m.location = c.location AND m.combo = c.combo AND m.lot = l.lot GROUP BY ALL
""")
def purchase_prob(t):
    lines = t("lineitem")
    tasks = tasks_for(lines.count(), lines.sparkSession)
    lines, orders = dealt(lines.select("l_orderkey", "l_partkey"), tasks, "l_orderkey"), dealt(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), tasks, "l_orderkey")
    members = lines.join(orders, "l_orderkey").select(F.col("o_custkey").alias("location"), F.col("l_orderkey").alias("combo"), F.col("l_partkey").alias("lot"))
    members = dealt(members, tasks, "location", "lot").distinct()
    own = members.select("location", "lot").distinct().withColumn("p", (F.col("lot") % 10 + 1) / 12.0)
    return pricing.purchase_probability(members, own, tasks).select("location", "combo", q6(F.col("probability") * 1e6).alias("probability"))


def _market(t):
    """Suppliers as lots, four a location, combos of neighbours: (location, combo, lot, market, area, combo_value)."""
    key = F.col("s_suppkey")
    lots_ = t("supplier").select(key.alias("lot"), F.floor(key / 4).alias("location"), (key % 9 * 1000 + 60000.0).alias("market"), (key % 5 * 100 + 1400.0).alias("area"))
    first = lots_.where(F.col("lot") % 4 < 3).select("location", F.col("lot").alias("combo"))
    each = first.select("location", "combo", F.explode(F.array(F.col("combo"), F.col("combo") + 1)).alias("lot"))
    return each.join(lots_.drop("location"), "lot").withColumn("combo_value", F.col("combo") % 7 * 2000 + 130000.0)


_MARKET = """
l AS (SELECT s_suppkey AS lot, s_suppkey // 4 AS location, 60000.0 + s_suppkey % 9 * 1000 AS market, 1400.0 + s_suppkey % 5 * 100 AS area FROM supplier),
c AS (SELECT location, lot AS combo, 130000.0 + lot % 7 * 2000 AS v FROM l WHERE lot % 4 < 3),
m AS (SELECT c.*, l.lot, market, area FROM c JOIN l ON l.location = c.location AND l.lot IN (combo, combo + 1)),
ca AS (SELECT combo, sum(area) AS a FROM m GROUP BY combo),
lv AS (SELECT lot, any_value(m.location) AS location, max(market) AS market, sum(v) / sum(a) * max(area) AS value FROM m JOIN ca USING (combo) GROUP BY lot),
p AS (SELECT *, (least(market, value) * 0.9 + greatest(market, value) * 1.1) / 2 AS price FROM lv),
n AS (SELECT location, count(*) AS lots FROM lv GROUP BY location),
u AS (SELECT m.location, m.combo, (max(v) - sum(price)) * 0.5 + sum(p.market - price) * 0.5 AS gain FROM m JOIN p USING (lot) GROUP BY m.location, m.combo)
"""


@query(f"WITH {_MARKET} SELECT u.location, {q('sum(gain * power(0.5, lots))')} AS utility FROM u JOIN n ON n.location = u.location GROUP BY u.location")
def expected_utility_mid(t):
    return pricing.utilities(_market(t), ["location"]).select("location", q6("utility").alias("utility"))


_WITHOUT = _MARKET.replace("m AS (SELECT c.*, l.lot, market, area FROM c JOIN l ON l.location = c.location AND l.lot IN (combo, combo + 1))", """m AS (SELECT c.location * 4 + w AS location, combo, v, l.lot, market, area FROM c JOIN l ON l.location = c.location AND l.lot IN (combo, combo + 1), range(0, 4) r(w)
  WHERE c.location * 4 + w NOT IN (combo, combo + 1))""").replace("ca AS (SELECT combo, sum(area) AS a FROM m GROUP BY combo)", "ca AS (SELECT location, combo, sum(area) AS a FROM m GROUP BY location, combo)").replace("JOIN ca USING (combo) GROUP BY lot)", "JOIN ca USING (location, combo) GROUP BY m.location, lot)").replace("lv AS (SELECT lot, any_value(m.location) AS location,", "lv AS (SELECT lot, m.location,").replace("JOIN p USING (lot)", "JOIN p USING (location, lot)")


@query(f"""
WITH every AS (WITH {_MARKET} SELECT u.location, sum(gain * power(0.5, lots)) AS utility FROM u JOIN n ON n.location = u.location GROUP BY u.location),
left_over AS (WITH {_WITHOUT} SELECT u.location AS lot, sum(gain * power(0.5, lots)) AS utility FROM u JOIN n ON n.location = u.location GROUP BY u.location)
SELECT s_suppkey // 4 AS location, s_suppkey AS lot, {q('every.utility - coalesce(left_over.utility, 0)')} AS value
FROM supplier JOIN every ON every.location = s_suppkey // 4 LEFT JOIN left_over ON left_over.lot = s_suppkey
""")
def marginal_lot_value_mid(t):
    """What each lot and its combos add to the utility in the middle of the price ranges."""
    found = pricing.marginal_utilities(_market(t))
    return found.select("location", "lot", q6("value").alias("value"))


@query()
def optimal_bids(t):
    return pricing.optimal_bids(_market(t))


@query("SELECT s_suppkey // 4 AS location, CASE WHEN count(*) > 1 THEN concat(min(s_suppkey) + 1, ',', min(s_suppkey) + 2) ELSE concat(min(s_suppkey), ',', min(s_suppkey) + 1, ',', min(s_suppkey) + 2) END AS lots FROM supplier GROUP BY 1")
def strategic_lots(t):
    """Of lots 0-1-2-3 with combos (0,1,2), (1,2,3) the middle ones are needed."""
    key = F.col("s_suppkey")
    base = t("supplier").select(F.floor(key / 4).alias("location"), key.alias("combo")).where(F.col("combo") % 4 < 2)
    members = base.select("location", "combo", F.explode(F.array(*[F.col("combo") + k for k in range(3)])).alias("lot")).withColumn("sign", F.lit(1))
    return lots.strategic_lots(members).select("location", _text("lots").alias("lots"))


@query(f"SELECT p_partkey, {q('(p_retailprice * 100 / 1.2 - p_size * 500) / ((1000 + p_size * 10) * (1 - 0.19 + 0.02 + 0.003))')} AS price FROM part")
def max_land_price_fixed_mix(t):
    price = economics.price_of_mix(F.col("p_retailprice") * 100, F.col("p_size") * 500, F.col("p_size") * 10 + 1000, 1.2)
    return t("part").select("p_partkey", q6(price).alias("price"))


TYPES = {"util": [40, 60, 80, 110], "interior": [36, 54, 72, 99], "terrace": [8, 12, 16, 22], "parking": [1, 1, 1, 2], "storage": [1, 1, 1, 1], "price": [3600, 5100, 6600, 8800]}


def _mix_sql() -> str:
    """All counts a floor by SQL, the closed form written out, and the best of each project."""
    c, t, n = economics.UNIT_COSTS, TYPES, len(TYPES["util"])
    total = lambda name: "(" + " + ".join(f"c{k} * {t[name][k]}" for k in range(n)) + ") * f"
    per_sale = sum(c[x] for x in ("marketing", "management", "legal", "after_sales", "insurance", "presale_insurance", "other_sales", "contingency"))
    need = [f"({t['terrace'][k]} + {t['interior'][k]} + 0.2 * {t['util'][k]}) * f" for k in range(n)]
    text = "WITH p AS (SELECT p_partkey AS key, p_partkey % 10 * 50 + 1300.0 AS land, p_partkey % 7 * 20 + 500.0 AS base, p_partkey % 4 + 4 AS f, p_partkey % 3 - 1.0 AS far FROM part),\n"
    text += "m0 AS (SELECT *, base * f + least(base, 750.0) AS above FROM p)"
    for k in range(n):
        left = " - ".join(["above", *[f"c{i} * {need[i]}" for i in range(k)]])
        units = " - ".join(["60", *[f"c{i} * f" for i in range(k)]])
        text += f",\nm{k + 1} AS (SELECT *, unnest(range(0, CAST(greatest(0, least(floor(({left} + 1e-9) / ({need[k]})), floor(({units} + 1e-9) / f))) AS BIGINT) + 1)) AS c{k} FROM m{k})"
    used = ", ".join(f"CASE WHEN c{k} > 0 THEN {t['util'][k]} END" for k in range(n))
    text += f",\nu AS (SELECT *, {total('util')} AS util, {total('price')} AS sales, {total('parking')} AS spaces, {total('storage')} AS stores, (c0 + c1 + c2 + c3) * f AS units FROM m{n} WHERE coalesce(greatest({used}) <= 2.5 * least({used}) + 1e-9, TRUE))"
    text += f",\nw AS (SELECT *, greatest(spaces, spaces * 1.15 - spaces * 1.15 * 0.5 / 3.0 - spaces * 0.15) AS parking, above - {total('terrace')} - {total('interior')} AS common FROM u)"
    text += ",\nb AS (SELECT *, 30.0 * parking + 5.0 * stores AS below FROM w)"
    rest = f"({c['demolition']} + {c['soil']} + {c['topography']}) * land + ({c['slab_above']} * above + {c['slab_below']} * below + {c['inspection'] * c['duration']}) * {1 + c['financing']} + {c['architecture']} * util + {c['structure'] + c['specialties']} * (above + below) + {c['connections']} * units + ({per_sale} + 0.19 / 1.19) * sales + {c['permits'] + c['sales_room'] + c['accounting'] * c['duration']}"
    text += f",\nr AS (SELECT *, (sales / 1.2 - ({rest})) / (land * {1 - 0.19 + c['commission'] + c['other_land']}) AS price FROM b)"
    text += ",\nx AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY price DESC, c0, c1, c2, c3) AS place FROM r WHERE price >= 0)\n"
    return text + f"SELECT p.key, x.key IS NOT NULL AS feasible, {q('price')} AS price, {q('sales')} AS sales, {q('util')} AS util, {q('common')} AS common, {q('parking')} AS parking, concat(c0, ',', c1, ',', c2, ',', c3) AS per_floor FROM p LEFT JOIN x ON p.key = x.key AND place = 1"


@query(_mix_sql().replace("concat(c0, ',', c1, ',', c2, ',', c3) AS per_floor", "CASE WHEN x.key IS NOT NULL THEN concat(c0, ',', c1, ',', c2, ',', c3) END AS per_floor"))
def max_land_price_opt(t):
    """The best mix of four kinds of units for a project on every part."""
    key = F.col("p_partkey")
    projects = t("part").select(key.alias("key"), (key % 10 * 50 + 1300.0).alias("land"), (key % 7 * 20 + 500.0).alias("base"), F.lit(750.0).alias("max_coverage"), (key % 4 + 5).alias("floors"), F.lit(60.0).alias("max_units"), F.lit(0.2).alias("common_share"), F.lit(1.2).alias("return"), (key % 3 - 1.0).alias("far"))
    found = economics.best_prices(projects, "key", TYPES)
    return found.select("key", "feasible", *[q6(c).alias(c) for c in ("price", "sales", "util", "common", "parking")], _text("per_floor").alias("per_floor"))


@query()
def best_building(t):
    key = F.col("n_nationkey")
    parcels = t("nation").select(key.alias("key"), F.array(g.box(0, 0, key + 20, 40)).alias("build"), (key % 5 + 3).alias("max_floors"), F.lit(20.0).alias("max_height"), F.lit(400.0).alias("max_coverage"), F.lit(3000.0).alias("max_built"))
    return capacity.best_building(parcels, steps=120, restarts=1, refine=120)


_FLOORS = "(SELECT s_suppkey AS key, CAST(unnest(range(1, s_suppkey % 4 + 2)) AS INTEGER) AS floor, s_suppkey FROM supplier)"


@query(f"""
SELECT key, floor, part, {q("(floor - 1) * 2.5 + CASE WHEN part = 'slab' THEN 0 ELSE 0.2 END")} AS bottom, {q("(floor - 1) * 2.5 + CASE WHEN part = 'slab' THEN 0.2 ELSE 2.5 END")} AS top,
  CASE WHEN s_suppkey % 5 - 2 <= 0 THEN '#e36465' WHEN (s_suppkey % 5 - 2) * 0.15 <= 0.2 THEN '#f2ec77' ELSE '#92ba7b' END AS colour
FROM {_FLOORS}, (VALUES ('slab'), ('walls')) v(part)
""")
def geojson_features(t):
    key = F.col("s_suppkey")
    b = t("supplier").select(key.alias("key"), (key % 4 + 1).alias("floors"), F.lit(2.5).alias("height"), g.box(key, 0, 10, 10).alias("base"), g.box(key, 0, 8, 8).alias("first"), ((key % 5 - 2) * 0.15).alias("gap"))
    found = export.building_features(b, "key", "floors", "height", "base", "first", "gap")
    return found.select("key", "floor", "part", q6("bottom").alias("bottom"), q6("top").alias("top"), "colour")


@query()
def geojson_files(t):
    key = F.col("s_suppkey")
    b = t("supplier").select(key.alias("key"), (key % 4 + 1).alias("floors"), F.lit(2.5).alias("height"), g.box(key, 0, 10, 10).alias("base"), g.box(key, 0, 8, 8).alias("first"), ((key % 5 - 2) * 0.15).alias("gap"))
    return pipeline.publish(b)


@query(f"""
WITH b AS (SELECT k, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM {BOX_SQL}),
l AS (SELECT k, ['3dpoly', concat(x, ',', y, ',0'), concat(x + w, ',', y, ',0'), concat(x + w, ',', y + h, ',0'), concat(x, ',', y + h, ',0'), 'c', 'extrude last  3', 'copym last  0,0,0 0,0,3', 'copym last  0,0,0 0,0,6'] AS s FROM b)
SELECT k, CAST(i AS INTEGER) AS place, s[i + 1] AS line FROM l, LATERAL (SELECT unnest(range(0, 9)) AS i)
""")
def scr_lines(t):
    b = boxes(t).withColumn("ring", g.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    return export.script_lines(b, "k", "ring", F.lit(3.0), F.lit(3))
