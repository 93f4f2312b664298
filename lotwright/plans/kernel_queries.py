"""Queries of the polygon kernel, the table lifecycle and the decisions on inputs with answers in closed form.

Squares are turned by the angle of the 3-4-5 triangle, so that their corners and
what they share lie on whole coordinates, on which overlays are exact. Convex
shapes go through Column expressions, others through the polygon kernel.
"""

from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import clipping as c
from ..functions import geometry as g
from ..functions.numbers import q6, q6_sql
from ..operators import capacity, geo_udf, kernel, locations, pricing, spatial_join, zoning
from ..sources import export, tables
from . import pipeline
from .reading import reader

QUERIES, SQL = {}, {}
q = q6_sql
#: Sides of turned squares are 5 n long.
_N = "(s_suppkey % 5 + 2)"


def query(sql: str | None = None, session: bool = False):
    def put(f):
        def run(spark, sf_dir):
            read = reader(spark, sf_dir)
            return f(spark, read) if session else f(read)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def ring(*corners) -> Column:
    return g.ring(*[g.point(x, y) for x, y in corners])


def turned(n: Column, m=0, left=0) -> Column:
    """A turned square of side 5 n, moved by 5 m along its first side and 5 ``left`` along its last."""
    x, y = F.lit(3 * m - 4 * left), F.lit(4 * m + 3 * left)
    return F.array(ring((x, y), (x + 3 * n, y + 4 * n), (x - n, y + 7 * n), (x - 4 * n, y + 3 * n)))


def _squares(t):
    key = F.col("s_suppkey")
    n = (key % 5 + 2).cast("double")
    return t("supplier").select(key.alias("k"), n.alias("n"), turned(n).alias("a"), turned(n, 1).alias("b"), turned(n, 30).alias("far"))


@query(f"SELECT s_suppkey AS k, {q(f'25.0 * ({_N} - 1) * {_N}')} AS shared, {q(f'25.0 * ({_N} + 1) * {_N}')} AS whole, {q(f'25.0 * {_N}')} AS rest FROM supplier")
def turned_overlays(t):
    areas = [f(F.col("a"), F.col("b")) for f in (c.common_area, c.union_area, c.difference_area)]
    return _squares(t).select("k", *[q6(a).alias(name) for a, name in zip(areas, ("shared", "whole", "rest"), strict=True)])


@query(f"SELECT s_suppkey AS k, {q(f'25.0 * {_N} * {_N}')} AS hull FROM supplier")
def hull_of_parts(t):
    """The hull of a turned square's four corners and points in it is the square."""
    n = F.col("n")
    inner = ring((F.lit(0), n), (n * 0.5, n * 2), (-n * 0.5, n * 3))
    return _squares(t).select("k", q6(g.signed_area(c.hull(F.concat(F.get("a", F.lit(0)), inner)))).alias("hull"))


@query(f"SELECT s_suppkey AS k, 4 AS corners, {q(f'25.0 * {_N} * {_N}')} AS area FROM supplier")
def simplified_ring(t):
    """Points within 5 cm of a square's sides go; its corners stay."""
    n = F.col("n")
    rough = F.array(ring((F.lit(0), F.lit(0)), (n * 2.5, F.lit(0.02)), (n * 5, F.lit(0)), (n * 5, n * 5), (n * 2, n * 5 + 0.03), (F.lit(0), n * 5)))
    s = _squares(t).select("k", c.simplify(F.get(rough, F.lit(0))).alias("thin"))
    return s.select("k", F.size("thin").alias("corners"), q6(g.signed_area(F.col("thin"))).alias("area"))


@query("SELECT s_suppkey AS k, 4 AS straight, 6 AS bent FROM supplier")
def collinear_dropped(t):
    """Corners on a side go, those of a ring without such stay."""
    n = F.col("n")
    bent = F.array(ring((F.lit(0), F.lit(0)), (n * 3, n * 4), (n, n * 7), (-n, n * 7), (-n * 4, n * 3), (-n * 3, n)))
    straight = F.array(ring((F.lit(0), F.lit(0)), (n * 1.5, n * 2), (n * 3, n * 4), (-n, n * 7), (-n * 2.5, n * 5), (-n * 4, n * 3)))
    left = lambda r: F.size(c.drop_collinear(F.get(r, F.lit(0))))
    return _squares(t).select("k", left(straight).alias("straight"), left(bent).alias("bent"))


#: A quarter circle of radius 2 in eight chords.
_CORNER = 8 * 2.0 * math.sin(math.pi / 16)


@query(f"SELECT s_suppkey AS k, {q(f'25.0 * {_N} * {_N} + 4 * 5 * {_N} * 2 + {4 * _CORNER!r}')} AS area FROM supplier")
def buffered_square(t):
    """Sides moved out by 2, and eight chords around each corner."""
    area = g.signed_area(c.convex_buffer(F.get("a", F.lit(0)), 2.0))
    return _squares(t).select("k", q6(area).alias("area"))


@query(f"SELECT s_suppkey AS k, {q(f'(5.0 * {_N} + 10) * (5.0 * {_N} + 10)')} AS grown, {q(f'greatest(5.0 * {_N} - 10, 0) * greatest(5.0 * {_N} - 10, 0)')} AS inside FROM supplier")
def offset_square(t):
    moved = lambda d: g.signed_area(c.convex_offset(F.get("a", F.lit(0)), F.array_repeat(F.lit(d), 4)))
    return _squares(t).select("k", q6(moved(5.0)).alias("grown"), q6(moved(-5.0)).alias("inside"))


@query(f"SELECT s_suppkey AS k, {q(f'(5.0 * {_N} + 5) * (5.0 * {_N} + 10)')} AS area FROM supplier")
def offset_by_side(t):
    """Sides moved out by 5, 0, 5 and 5: one direction grows by 10, the other by 5."""
    moved = c.convex_offset(F.get("a", F.lit(0)), F.array(*[F.lit(d) for d in (5.0, 0.0, 5.0, 5.0)]))
    return _squares(t).select("k", q6(g.signed_area(moved)).alias("area"))


@query(f"SELECT s_suppkey AS k, {q(f'25.0 * {_N} * {_N} * 0.64')} AS area, {q(f'0.5 * {_N}')} AS depth FROM supplier")
def shrunk_square(t):
    """A square of 64 % of the area has 80 % of the sides: each moved in by a tenth."""
    inner = c.convex_shrink(F.get("a", F.lit(0)), F.lit(0.64))
    s = _squares(t).withColumn("inner", inner)
    return s.select("k", q6(g.signed_area(F.col("inner"))).alias("area"), q6(g.line_line_distance(F.get(g.sides(F.get("a", F.lit(0))), F.lit(0)), F.get(g.sides(F.col("inner")), F.lit(0)))).alias("depth"))


@query(f"SELECT s_suppkey AS k, TRUE AS holds, FALSE AS reversed, FALSE AS partly FROM supplier")
def turned_contains(t):
    s = _squares(t).withColumn("inner", F.array(c.convex_offset(F.get("a", F.lit(0)), F.array_repeat(F.lit(-2.5), 4))))
    return s.select("k", c.holds(F.col("a"), F.col("inner")).alias("holds"), c.holds(F.col("inner"), F.col("a")).alias("reversed"), c.is_within(F.col("b"), F.col("a")).alias("partly"))


@query(f"SELECT s_suppkey AS k, {q(f'150.0 - 5 * {_N}')} AS far, {q('0.0')} AS meets FROM supplier")
def turned_distance(t):
    s = _squares(t)
    return s.select("k", q6(g.shape_distance(F.col("a"), F.col("far"))).alias("far"), q6(g.shape_distance(F.col("a"), F.col("b"))).alias("meets"))


@query(f"SELECT s_suppkey AS k, {q(f'25.0 * {_N} * {_N} - {_N} * {_N} - 0.01 * 2 * {_N} + {_N} * {_N}')} AS area, 2 AS rings FROM supplier")
def keyholed_ring(t):
    """A square less one in its middle is cut open to one ring by a slit of 0.01; a region beside it is left alone."""
    n = F.col("n")
    outer, hole = F.array(g.box(0, 0, n * 5, n * 5), g.box(n * 6, n * 2, n, n)), F.array(g.box(n * 2, n * 2, n, n))
    cut = geo_udf.keyholed_difference(outer, hole)
    # Squares of one size are cut once for all their copies.
    stacks = spatial_join.stacked(_squares(t).select("k", "n"), "k")
    found = stacks.withColumn("cut", cut)
    return spatial_join.unstacked(found.select("k", q6(g.shape_area(F.col("cut"))).alias("area"), F.size("cut").alias("rings")), "k")


@query("SELECT s_suppkey AS k, 1 AS bow, 0 AS plain FROM supplier")
def self_crossings(t):
    n = F.col("n")
    bow = F.array(ring((F.lit(0), F.lit(0)), (n, n), (n, F.lit(0)), (F.lit(0), n)))
    return _squares(t).select("k", c.self_crossings(F.get(bow, F.lit(0))).alias("bow"), c.self_crossings(F.get("a", F.lit(0))).alias("plain"))


@query(f"SELECT s_suppkey AS k, {q(f'5.0 * {_N}')} AS inside FROM supplier")
def clipped_line(t):
    """A line along the first side's direction, in the middle of the square, is cut to the side's length."""
    n = F.col("n")
    line = ring((n * -2 - 30, n * 1.5 - 40), (n * -2 + 60, n * 1.5 + 80))
    pieces = c.spans_near(line, F.get("a", F.lit(0)), 0.0)
    return _squares(t).select("k", q6(F.aggregate(pieces, F.lit(0.0), lambda acc, p: acc + p["high"] - p["low"])).alias("inside"))


@query("SELECT s_suppkey AS k, 2 AS regions, 1 AS outer_ones FROM supplier")
def region_filters(t):
    """Repeated regions go; regions inside others go."""
    n = F.col("n")
    twice = F.array(g.box(0, 0, n * 5, n * 5), g.box(0, 0, n * 5, n * 5), g.box(n * 9, 0, n, n))
    nested = F.array(g.box(0, 0, n * 5, n * 5), g.box(n, n, n, n))
    return _squares(t).select("k", F.size(c.unique_regions(twice)).alias("regions"), F.size(c.drop_contained(nested)).alias("outer_ones"))


@query("SELECT s_suppkey AS k, s_suppkey - s_suppkey % 3 AS location FROM supplier")
def touching_locations(t):
    """Diamonds of radius 6 in a row, 10 apart, with a gap after every third."""
    k = F.col("s_suppkey")
    x = k * 10 + F.floor(k / 3) * 20
    rings = F.array(ring((x + 6, F.lit(0)), (x, F.lit(6)), (x - 6, F.lit(0)), (x, F.lit(-6))))
    combos = t("supplier").select(k.alias("k"), rings.alias("shape"))
    return locations.spatial_locations(combos, "k", "shape", g.bounds(F.get("shape", F.lit(0))))


_DIAMONDS = "(SELECT p_partkey AS k, CAST(p_partkey * 37 % 500 AS DOUBLE) AS x, CAST(p_partkey * 91 % 500 AS DOUBLE) AS y, CAST(p_partkey % 4 + 1 AS DOUBLE) AS r FROM part)"


def _diamonds(t, side: str):
    k = F.col("p_partkey")
    x, y, r = (k * 37 % 500).cast("double"), (k * 91 % 500).cast("double"), (k % 4 + 1).cast("double")
    return t("part").select(k.alias(f"{side}k"), F.array(ring((x + r, y), (x, y + r), (x - r, y), (x, y - r))).alias(f"{side}shape"))


def _bounds(side: str):
    return g.bounds(F.get(f"{side}shape", F.lit(0)))


@query(f"SELECT a.k AS a, b.k AS b FROM {_DIAMONDS} a JOIN {_DIAMONDS} b ON a.k < b.k AND abs(a.x - b.x) + abs(a.y - b.y) <= a.r + b.r")
def diamond_intersects_join(t):
    sides = [spatial_join.stacked(_diamonds(t, s), f"{s}k") for s in "ab"]
    pairs = spatial_join.intersects(*sides, "ashape", "bshape", _bounds("a"), _bounds("b"))
    return spatial_join.unstacked(pairs.select("ak", "bk"), "ak", "bk").where("ak < bk").select(F.col("ak").alias("a"), F.col("bk").alias("b"))


@query(f"""
SELECT s_suppkey AS k, s_suppkey * 10 + i AS other, {q(f'({_N} * {_N} + 4.0 * {_N} * 2 + {4 * _CORNER!r}) * CASE i WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.25 END')} AS clip
FROM supplier, (VALUES (0), (1), (2)) v(i)
""")
def context_clipped(t):
    """What lies within 2 of a parcel, cut to that: ground that covers it all, half of it and a quarter; a fourth is too far off."""
    k, n = F.col("s_suppkey"), (F.col("s_suppkey") % 5 + 2).cast("double")
    left = t("supplier").select(k.alias("k"), F.array(g.box(k * 200, 0, n, n)).alias("parcel"))
    corner = lambda i, x, y: F.struct((k * 10 + i).alias("other"), F.array(g.box(k * 200 + x, y, 50, 50)).alias("ground"))
    grounds = F.array(corner(0, -20, F.lit(-20)), corner(1, n / 2, F.lit(-20)), corner(2, n / 2, n / 2), corner(3, n + 2.5, F.lit(0)))
    right = t("supplier").select(F.explode(grounds).alias("r")).select("r.*")
    at = lambda s: g.bounds(F.get(s, F.lit(0)))
    met = spatial_join.clipped(left, right, "parcel", "ground", at("parcel"), at("ground"), 2.0)
    return met.select("k", "other", q6(g.shape_area(F.col("clip"))).alias("clip"))


@query(f"SELECT s_suppkey AS k, {q(f'20.0 * {_N} + 20.0 * 2')} AS street_clip FROM supplier")
def street_in_context(t):
    """A straight street through each parcel, cut to the ground within 20 of it."""
    k, n = F.col("s_suppkey"), (F.col("s_suppkey") % 5 + 2).cast("double")
    s = t("supplier").select(k.alias("k"), g.box(0, 0, n * 20, 10).alias("parcel"))
    pieces = c.spans_near(ring((F.lit(-500), F.lit(5)), (F.lit(900), F.lit(5))), F.col("parcel"), 20.0)
    return s.select("k", q6(F.aggregate(pieces, F.lit(0.0), lambda acc, p: acc + p["high"] - p["low"])).alias("street_clip"))


@query(f"SELECT s_suppkey AS k, 9 AS faces, {q(f'25.0 * {_N} * {_N}')} AS top FROM supplier")
def prism_of_slices(t):
    """Three equal slices: four faces between each two, and the top."""
    level = lambda z: F.struct(F.lit(z).alias("height"), F.get("a", F.lit(0)).alias("ring"))
    s = _squares(t).select("k", c.prism_faces(F.array(level(0.0), level(3.0), level(6.0))).alias("f"))
    return s.select("k", F.size("f").alias("faces"), q6(g.signed_area(F.element_at("f", -1))).alias("top"))


@query(f"SELECT s_suppkey AS k, {q(f'(5.0 * {_N} + 20.0) * 5.0 * {_N}')} AS shadow FROM supplier")
def envelope_shadows(t):
    """A prism of height 9.8 and slices less apart than its width: the shadow westwards is 20 longer than the base."""
    n = F.col("n")
    slices = _squares(t).select("k", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: k * 0.49)).alias("height"), g.box(0, 0, n * 5, n * 5).alias("ring"))
    return zoning.slices_shadow(slices, ["k"], "ring", "height", "p").select("k", q6("area").alias("shadow"))


_STRIP = "least((60 - 4 * sin(a)) / abs(cos(a)), CASE WHEN sin(a) > 1e-9 THEN (h - 4 * abs(cos(a))) / sin(a) ELSE 1e9 END)"


@query(f"SELECT k, {q(f'max({_STRIP})')} AS length FROM (SELECT s_suppkey AS k, {_N} * 4 + 6 AS h, range * pi() / 90 AS a FROM supplier, range(0, 90)) GROUP BY k")
def template_rectangle(t):
    """The longest strip of width 4 through the middle of a box of 60 by 4 n + 6, of 90 directions."""
    found = c.best_rectangle(g.box(0, 0, 60, F.col("n") * 4 + 6), 4.0)
    return _squares(t).select("k", q6(found["length"]).alias("length"))


@query()
def best_building_holds(t):
    """The constraints of the best buildings, in a prism and, for odd keys, in a sloping envelope."""
    key = F.col("n_nationkey")
    base = t("nation").select(key.alias("key"), F.array(g.box(0, 0, key + 20, 40)).alias("build"), (key % 5 + 3).alias("max_floors"), F.lit(20.0).alias("max_height"), F.lit(400.0).alias("max_coverage"), F.lit(3000.0).alias("max_built"))
    base = base.withColumn("gross", F.col("build")).withColumn("slope", F.when(F.col("key") % 2 == 1, F.lit(2.75)).cast("double"))
    found = capacity.best_building(base, steps=120, restarts=1, volume_steps=80, refine=120).join(base.select(F.col("key"), "max_floors", "max_height"), "key")
    done = F.col("status") == capacity.DONE
    holds = lambda c: ~done | c
    return found.select(
        "key",
        F.col("status").isin(capacity.DONE, capacity.INFEASIBLE, capacity.LOW).alias("known_status"),
        holds((F.col("floors") <= F.col("max_floors")) & (F.col("floors") * 2.65 <= F.col("max_height"))).alias("floors_fit"),
        holds((F.col("area") > 0) & (F.col("area") <= (F.col("key") + 20) * 40.0) & (F.col("coverage") <= 1)).alias("area_fits"),
        holds(F.col("residual") < 1).alias("inside"),
    )


@query()
def marginal_lot_values(t):
    """The utility of all lots less that without one lot and its combos: lots of each location, and whether all have a value."""
    from .spatial_queries import _market

    found = pricing.marginal_values(_market(t))
    return found.groupBy("location").agg(F.count(F.lit(1)).alias("lots"), F.min(~F.isnan("value") & F.col("value").isNotNull()).alias("bounded"))


@query("SELECT 'created' AS step, TRUE AS there, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'appended', TRUE, (SELECT count(*) FROM nation) UNION ALL SELECT 'copied', TRUE, (SELECT count(*) FROM region) UNION ALL SELECT 'deleted', FALSE, CAST(0 AS BIGINT)", session=True)
def table_lifecycle(spark, t):
    """A table is created, filled, another written from a query, and both deleted."""
    name, rows = f"life_{uuid.uuid4().hex}", []
    note = lambda step, n: rows.append((step, tables.table_exists(spark, n), spark.table(n).count() if tables.table_exists(spark, n) else 0))
    tables.create_table(spark, name, [("n_nationkey", "bigint"), ("n_name", "string")])
    try:
        note("created", name)
        tables.append(t("nation").select("n_nationkey", "n_name"), name)
        note("appended", name)
        tables.materialise(t("region"), f"{name}_copy", replace=True)
        note("copied", f"{name}_copy")
    finally:
        for n in (name, f"{name}_copy"):
            tables.delete_table(spark, n)
    note("deleted", name)
    return spark.createDataFrame(rows, "step string, there boolean, n bigint")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation", session=True)
def csv_round_trip(spark, t):
    """The table written as CSV below the warehouse and read back by its schema."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/csv_{uuid.uuid4().hex}"
    own = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    tables.write_csv(own, path)
    return tables.read_csv(spark, path, "n_nationkey bigint, n_name string, n_regionkey bigint").select(*[F.col(f.name).cast(f.dataType) for f in own.schema.fields])


_TEXT = "SELECT s.s_nationkey, count(*) AS n, max(n.n_name) AS name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_suppkey > 3 GROUP BY s.s_nationkey"


@query(_TEXT, session=True)
def sql_text(spark, t):
    return tables.sql_query(spark, _TEXT, {n: t(n) for n in ("supplier", "nation")})


@query("SELECT s_suppkey AS rol, TRY_CAST(CASE WHEN s_suppkey % 7 = 0 THEN 'n/a' ELSE CAST(s_suppkey * 2 AS VARCHAR) END AS DOUBLE) AS price FROM supplier")
def loaded_valuations(t):
    """A file's text columns under the table's names and types; what is no number becomes null."""
    raw = t("supplier").select(F.col("s_suppkey").cast("string").alias("Rol"), F.when(F.col("s_suppkey") % 7 == 0, "n/a").otherwise((F.col("s_suppkey") * 2).cast("string")).alias("Precio"))
    return tables.typed(raw, {"rol": ("Rol", "bigint"), "price": ("Precio", "double")})


@query(f"SELECT s_suppkey AS k, {q('s_suppkey + 5.0')} AS x, {q('2.5')} AS y, s_suppkey % 5 AS gap, 5 AS points FROM supplier")
def summary_features(t):
    """Locations' outlines with centroid and attributes, read back from their GeoJSON."""
    k = F.col("s_suppkey")
    own = t("supplier").select(k.alias("k"), g.box(k, 0, 10, 5).alias("ring"), (k % 5).alias("gap"))
    found = export.summary_features(own, "k", "ring", ["gap"])
    read = F.from_json("feature", "struct<geometry:struct<coordinates:array<array<array<double>>>>,properties:struct<centroid_x:double,centroid_y:double,gap:bigint>>")
    f = found.select("k", read.alias("f"))
    return f.select("k", q6("f.properties.centroid_x").alias("x"), q6("f.properties.centroid_y").alias("y"), F.col("f.properties.gap").alias("gap"), F.size(F.get("f.geometry.coordinates", F.lit(0))).alias("points"))


_DECIDE = """
WITH m AS (SELECT DISTINCT l_orderkey AS combo, unnest([l_orderkey // 4, l_orderkey // 8 * 2]) AS lot FROM lineitem),
l AS (SELECT combo, lot // 2 * 2 AS location, lot FROM (SELECT DISTINCT * FROM m)),
v AS (SELECT combo, any_value(location) AS location, sum(lot % 11 * 20000 + 10000.0) AS market FROM l GROUP BY combo),
g AS (SELECT location, combo, o_totalprice - market AS gap, (o_totalprice - market) / market AS gap_pct FROM v JOIN orders ON o_orderkey = combo)
"""


@query(f"{_DECIDE} SELECT g.location, combo, {q('gap')} AS gap, {q('gap_pct')} AS gap_pct, signs FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY gap DESC, combo) AS k FROM g) g JOIN (SELECT location, array_to_string(list(CAST(sign(gap) AS INTEGER) ORDER BY combo), ',') AS signs FROM g GROUP BY location) s ON s.location = g.location WHERE k = 1")
def location_decisions(t):
    """Locations, market comparison and best combos of orders on one or two lots each, end to end."""
    order = F.col("l_orderkey")
    members = t("lineitem").select(order.alias("combo"), F.explode(F.array(F.floor(order / 4), F.floor(order / 8) * 2)).alias("lot")).distinct()
    located = pipeline.locate(members)
    costs = t("orders").select(F.col("o_orderkey").alias("combo"), F.col("o_totalprice").alias("cost"))
    prices = members.select("lot").distinct().withColumn("price", F.col("lot") % 11 * 20000 + 10000.0)
    found = pipeline.summarise(pipeline.compare(located, costs, prices))
    return found.select("location", "combo", q6("gap").alias("gap"), q6("gap_pct").alias("gap_pct"), F.array_join(F.transform("signs", lambda s: s.cast("string")), ",").alias("signs"))
