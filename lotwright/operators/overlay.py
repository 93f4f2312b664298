"""Union, intersection and difference of two shapes as rows of sides.

The sides of both are put on a grid and cut where they meet. A piece that only
one shape has is kept or not by whether its middle lies in the other; of pieces
that both have, the directions decide. What is left is linked to rings as in
dissolve, so shapes of any size and form are spread over tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import geometry as g
from . import dissolve, outlines, spatial_join
from .borders import outward, sides
from .rounds import keep, spread_by

_ENDS = ["ax", "ay", "bx", "by"]
KINDS = ("union", "intersection", "difference")


def _sides(pairs: DataFrame, keys: list[str], shape: str, grid: float) -> DataFrame:
    ends = [F.round(F.col(c) / grid).cast("bigint").alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), _ENDS, strict=True)]
    return sides(pairs.select(*keys, F.col(shape).alias("_shape")), keys, "_shape").select(*keys, *ends).where("ax <> bx OR ay <> by").distinct()


def _cells(s: DataFrame, keys: list[str], near: float) -> DataFrame:
    """Sides once for each cell that they come near."""
    return s.withColumn("_c", F.explode(dissolve.cells_along(near))).select(*keys, *_ENDS, F.col("_c.i").alias("_cx"), F.col("_c.j").alias("_cy"))


def _crossing(near: float) -> tuple[Column, list[Column]]:
    """Where a side meets another (oax, ...), put on the grid: the crossing, and the other's ends at most ``near`` from it."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    ox, oy = F.col("obx") - F.col("oax"), F.col("oby") - F.col("oay")
    den = (dx * oy - dy * ox).cast("double")
    t = ((F.col("oax") - F.col("ax")) * oy - (F.col("oay") - F.col("ay")) * ox) / F.nullif(den, F.lit(0.0))
    u = ((F.col("oax") - F.col("ax")) * dy - (F.col("oay") - F.col("ay")) * dx) / F.nullif(den, F.lit(0.0))
    # Both shapes must get the same point: it is worked out along the smaller side.
    own = F.struct(*_ENDS) < F.struct(*[F.col(f"o{c}") for c in _ENDS])
    place = lambda c, d, e: F.round(F.when(own, F.col(f"a{c}") + d * t).otherwise(F.col(f"oa{c}") + e * u)).cast("bigint")
    cross = F.when(t.between(0, 1) & u.between(0, 1), _spot(place("x", dx, ox), place("y", dy, oy)))
    return cross, [F.when(_beside(F.col(x), F.col(y), near), _spot(F.col(x), F.col(y))) for x, y in (("oax", "oay"), ("obx", "oby"))]


def _spot(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _beside(x: Column, y: Column, near: float) -> Column:
    """Whether a point is at most ``near`` from a side's line."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return F.abs((y - F.col("ay")) * dx - (x - F.col("ax")) * dy) <= F.sqrt((dx * dx + dy * dy).cast("double")) * near


def _cut(s: DataFrame, other: DataFrame, keys: list[str], near: float) -> DataFrame:
    """Pieces (keys, l, h, way) of sides between the places where the other shape's sides meet them; way: 1 from l to h, -1 back."""
    there = _cells(other, keys, near).select(*keys, "_cx", "_cy", *[F.col(c).alias(f"o{c}") for c in _ENDS])
    met = _cells(s, keys, near).join(there.hint("merge"), [*keys, "_cx", "_cy"])
    cross, on = _crossing(near)
    return _pieces(s, met.select(*keys, *_ENDS, F.explode(F.array(cross, *on)).alias("p")).where("p IS NOT NULL"), keys)


def _cut_by_all(s: DataFrame, keys: list[str], near: float) -> DataFrame:
    """_cut of a group's sides by each other, of which many may lie on one line.

    Sides of one direction do not cross, so only cells' sides of different
    directions are joined; their ends are joined with sides as points, once for
    however many sides that end there.
    """
    listed = _cells(s, keys, near)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    # Parallel sides have the same quotient, others another one: whole numbers below 2**26 (671 km) are told apart by doubles.
    way = F.when(dx == 0, F.lit(math.inf)).otherwise(dy.cast("double") / dx + 0.0)
    listed = keep(listed.withColumn("_way", way))
    place = [*keys, "_cx", "_cy"]
    ways = listed.select(*place, F.col("_way").alias("_other")).distinct()
    left = listed.join(ways.hint("merge"), place).where("_way <> _other").drop("_way")
    right = listed.select(*place, F.col("_way").alias("_other"), *[F.col(c).alias(f"o{c}") for c in _ENDS])
    cross, _ = _crossing(near)
    # Few bytes become many pairs: dealt by number, as few tasks would else join them.
    n = max(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), s.sparkSession.sparkContext.defaultParallelism)
    left, right = (x.repartition(n, *place, "_other") for x in (left, right))
    crossed = left.join(right.hint("merge"), [*place, "_other"]).select(*keys, *_ENDS, cross.alias("p")).where("p IS NOT NULL")
    ends = s.select(*keys, F.explode(F.array(_spot(F.col("ax"), F.col("ay")), _spot(F.col("bx"), F.col("by")))).alias("p")).distinct()
    ends = ends.withColumn("_cx", F.floor(F.col("p.x") / dissolve.CELL)).withColumn("_cy", F.floor(F.col("p.y") / dissolve.CELL))
    beside = listed.drop("_way").join(ends.hint("merge"), place).where(_beside(F.col("p.x"), F.col("p.y"), near))
    return _pieces(s, crossed.unionByName(beside.select(*keys, *_ENDS, "p")), keys)


def _pieces(s: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces of sides between the cuts (keys, ax, ay, bx, by, p)."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = F.sqrt((dx * dx + dy * dy).cast("double"))
    at = ((F.col("p.x") - F.col("ax")) * dx + (F.col("p.y") - F.col("ay")) * dy) / size
    cuts = cuts.withColumn("at", at).where((F.col("at") > 0) & (F.col("at") < size)).groupBy(*keys, *_ENDS).agg(F.sort_array(F.collect_set(F.struct("at", "p"))).alias("cuts"))
    s = s.join(cuts.hint("merge"), [*keys, *_ENDS], "left")
    ends = [_spot(F.col(f"{c}x"), F.col(f"{c}y")) for c in "ab"]
    inner = F.transform("cuts", lambda c: c["p"])
    points = F.when(F.col("cuts").isNull(), F.array(*ends)).otherwise(F.concat(F.array(ends[0]), inner, F.array(ends[1])))
    # The points are put together once a side, not once for each piece.
    two = lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pieces = s.select(*keys, F.explode(g.let(points, two)).alias("e")).where("e.a <> e.b")
    ahead = F.col("e.a") < F.col("e.b")
    low, high = F.when(ahead, F.col("e.a")).otherwise(F.col("e.b")), F.when(ahead, F.col("e.b")).otherwise(F.col("e.a"))
    return pieces.select(*keys, low.alias("l"), high.alias("h"), F.when(ahead, 1).otherwise(-1).alias("way"))


def merged(parts: DataFrame, keys: list[str], shape: str, grid: float = dissolve.GRID) -> DataFrame:
    """keys and (ax, ay, bx, by): the outline of the union of each group's shapes, which may overlap, in units of ``grid``.

    Sides are cut where any others of the group meet them. A piece belongs to the
    outline if no shape of the group lies to its right, which a join of points
    and rings tells; gaps of less than two units close. For shapes that only touch
    dissolve.outline() does without that join. Each shape has one outer ring and
    no holes; groups with a null key are left out.
    """
    own = parts.select(*keys, F.get(outward(F.col(shape)), F.lit(0)).alias("_ring")).where("_ring IS NOT NULL").distinct()
    s = _sides(own.withColumn("_one", F.array("_ring")), keys, "_one", grid)
    pieces = keep(_cut_by_all(s, keys, 0.5).groupBy(*keys, "l", "h").agg(F.min("way").alias("low"), F.max("way").alias("high")).where("low = high"))
    start, end = (F.when(F.col("high") > 0, F.col(x)).otherwise(F.col(y)) for x, y in (("l", "h"), ("h", "l")))
    edges = pieces.select(*keys, start["x"].alias("ax"), start["y"].alias("ay"), end["x"].alias("bx"), end["y"].alias("by"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = F.sqrt((dx * dx + dy * dy).cast("double"))
    aside = g.point(((F.col("ax") + F.col("bx")) / 2 + dy / size) * grid, ((F.col("ay") + F.col("by")) / 2 - dx / size) * grid)
    spots = edges.withColumn("_spot", aside).withColumn("_k", F.struct(*keys))
    rings_ = own.select(F.struct(*keys).alias("_g"), "_ring")
    inner = spatial_join.contains_points(rings_, spots, "_ring", "_spot", g.bounds(F.col("_ring")), on=("_g", "_k"))
    return edges.join(inner.select(*keys, *_ENDS).distinct().hint("merge"), [*keys, *_ENDS], "left_anti")


def merged_measures(parts: DataFrame, keys: list[str], shape: str, grid: float = dissolve.GRID) -> DataFrame:
    """dissolve.measures() of merged()'s outlines: groups of up to outlines.SMALL corners, equal shapes counted once, are worked out in tasks, whole."""
    ring = F.get(outward(F.col(shape)), F.lit(0))
    own = parts.select(*keys, F.when(ring.isNotNull(), F.array(ring)).alias("_shape")).where("_shape IS NOT NULL").distinct()
    joined = lambda large: dissolve.measures(dissolve.points_of(merged(large, keys, "_shape", grid), keys, grid), keys, grid)
    return dissolve.by_size(spread_by(own, *keys), keys, lambda corners, group: outlines.merged(corners, group, grid), joined, grid)


def overlay(pairs: DataFrame, keys: list[str], a: str, b: str, kind: str, grid: float = dissolve.GRID, tolerance: float = 0.0) -> DataFrame:
    """keys and (ax, ay, bx, by): the pieces of the outline of a and b's "union", "intersection" or "difference", in units of ``grid``.

    keys tell the pairs apart. Rings of a shape don't cross; outer ones and holes
    run in opposite directions. Corners at most ``tolerance`` from a side of the
    other shape count as on it. dissolve.numbered() and rings() make rings of it.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    near = tolerance / grid + 0.5
    sa, sb = _sides(pairs, keys, a, grid), _sides(pairs, keys, b, grid)
    pieces = [_cut(x, y, keys, near).withColumn("of", F.lit(n)) for x, y, n in ((sa, sb, "a"), (sb, sa, "b"))]
    way = lambda n: F.sum(F.when(F.col("of") == n, F.col("way")).otherwise(0)).alias(n)
    net = pieces[0].unionByName(pieces[1]).groupBy(*keys, "l", "h").agg(way("a"), way("b")).where("a <> 0 OR b <> 0")
    shapes = pairs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(a).alias("_sa"), F.col(b).alias("_sb"))
    same = net[keys[0]].eqNullSafe(shapes[f"_{keys[0]}"])
    for k in keys[1:]:
        same = same & net[k].eqNullSafe(shapes[f"_{k}"])
    middle = g.point((F.col("l.x") + F.col("h.x")) / 2 * grid, (F.col("l.y") + F.col("h.y")) / 2 * grid)
    met = net.join(shapes.hint("merge"), same)
    inside = F.when(F.col("b") == 0, g.in_shape(F.col("_sb"), middle)).when(F.col("a") == 0, g.in_shape(F.col("_sa"), middle))
    met = met.select(*keys, "l", "h", F.signum("a").cast("int").alias("a"), F.signum("b").cast("int").alias("b"), F.coalesce(inside, F.lit(False)).alias("inside"))
    alone_a, alone_b, both = F.col("b") == 0, F.col("a") == 0, (F.col("a") != 0) & (F.col("b") != 0)
    if kind == "difference":
        turn = F.when(alone_a & ~F.col("inside"), F.col("a")).when(alone_b & F.col("inside"), -F.col("b")).when(both & (F.col("a") != F.col("b")), F.col("a"))
    else:
        wanted = F.col("inside") if kind == "intersection" else ~F.col("inside")
        turn = F.when(~both & wanted, F.col("a") + F.col("b")).when(both & (F.col("a") == F.col("b")), F.col("a"))
    met = met.withColumn("turn", turn).where("turn IS NOT NULL")
    start, end = F.when(F.col("turn") > 0, F.col("l")).otherwise(F.col("h")), F.when(F.col("turn") > 0, F.col("h")).otherwise(F.col("l"))
    return met.select(*keys, start["x"].alias("ax"), start["y"].alias("ay"), end["x"].alias("bx"), end["y"].alias("by"))


def rings(pairs: DataFrame, keys: list[str], a: str, b: str, kind: str, grid: float = dissolve.GRID, tolerance: float = 0.0) -> DataFrame:
    """dissolve.rings() of the overlay: points in order, for dissolve.measures() and shapes(). Pairs with an empty result give no row."""
    return dissolve.points_of(overlay(pairs, keys, a, b, kind, grid, tolerance), keys, grid)



def measured(pairs: DataFrame, keys: list[str], a: str, b: str, kinds: list[str], grid: float = dissolve.GRID, tolerance: float = 0.0) -> DataFrame:
    """keys and for each of the kinds a struct of dissolve.measures() of rings(); null where nothing is left.

    Pairs of up to outlines.SMALL corners are worked out in tasks, all kinds at
    once and without an exchange; larger ones go by the joins. Pairs with a null key are left out.
    """
    for kind in kinds:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    own = pairs.where(known).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    count = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("bigint"), lambda n, r: n + F.greatest(F.size(r), F.lit(0))), F.lit(0).cast("bigint"))
    small = count("_a") + count("_b") <= outlines.SMALL
    names = [f.name for f in outlines.fields()]

    def run(batches):
        for batch in batches:
            for rows in outlines.pieces_of(batch, ["_a", "_b"]):
                n = rows.num_rows
                columns = [rows.column(k) for k in keys]
                shapes = [outlines.corners_of(rows.column(c)) for c in ("_a", "_b")]
                for p, start, stop in outlines.overlaid(*shapes, n, kinds, grid, tolerance):
                    found, *values = outlines.measures(p, start, stop, n, grid)
                    at = np.full(n, -1)
                    at[found] = np.arange(len(found))
                    gone = at < 0
                    every = [pa.array(v).take(pa.array(at, mask=gone)) for v in values]
                    columns.append(pa.StructArray.from_arrays(every, names, mask=pa.array(gone)))
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *kinds])

    schema = StructType([*[own.schema[k] for k in keys], *[StructField(kind, outlines.fields()) for kind in kinds]])
    found = own.where(small).mapInArrow(run, schema)
    large = own.where(~small)
    if not large.limit(1).count():
        return found
    out = large.select(*keys)
    for kind in kinds:
        one = dissolve.measures(rings(large, keys, "_a", "_b", kind, grid, tolerance), keys, grid)
        out = out.join(one.select(*keys, F.struct(*names).alias(kind)).hint("merge"), keys, "left")
    return found.unionByName(out)
