"""Zoning limits, legal envelopes and shadows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import clipping
from ..functions import geometry as g
from . import dissolve, geo_udf, kernel, outlines, overlay, side_by_side
from .rounds import changes, whole_groups

#: Fixed values of the planning rules.
FUSION_BONUS, CONTEXT_PER_METRE, CONTEXT_MOST, HABITANTS_PER_DWELLING = 1.3, 2.7474774194546216, 140.0, 4.0
MOST_PLANS = 100
#: Width of the lowest level of tiles that tasks work on whole, and the part of it that a reach may take.
TILE, MARGIN = 2048.0, 1 / 16
SOCIAL_FLOORS, SOCIAL_DENSITY, SOCIAL_TO_FLOORS, SOCIAL_HEIGHT = (3, 4, 5), 1.25, 4, 14.0
DEFAULTS = {"shadow_slope": 5.0, "parking_per_unit": 1.0, "visitor_share": 0.15, "parking_area": 30.0, "storage_area": 5.0, "bikes_per_parking": 0.5, "bikes_per_space": 3.0, "max_basements": 7, "parking_coverage": 0.8, "wing_separation": 7.0}


def fusion_factor(lots: Column) -> Column:
    """Bundles of two lots or more may build more."""
    return F.when(F.size(lots) >= 2, FUSION_BONUS).otherwise(1.0)


def limit_or(coefficient: Column, area: Column, otherwise: Column) -> Column:
    """A coefficient of the area; where it is 0 or less there is no limit but ``otherwise``."""
    return F.when(coefficient > 0, coefficient * area).otherwise(otherwise)


def max_dwellings(density: Column, area: Column) -> Column:
    return density / HABITANTS_PER_DWELLING * area / 10000.0


def gross_area(gross_calculated: Column, net_calculated: Column, registered: Column) -> Column:
    return gross_calculated / net_calculated * registered


def context_radius(floors: Column, floor_height: Column) -> Column:
    return F.least(F.lit(CONTEXT_MOST), floors * floor_height * CONTEXT_PER_METRE)


def with_social_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
    """``df`` for each row (template, social) of the plan, with the limits that then hold.

    Social housing where 3 to 5 floors are allowed gets more density, 4 floors,
    14 m, and no floor-area and coverage limits (-1). The allowed floors of the
    parcel count for each row, not what an earlier row made of them.
    """
    rows = plan.select("template", "social").limit(MOST_PLANS + 1).collect()
    if len(rows) > MOST_PLANS:
        raise ValueError(f"a plan has at most {MOST_PLANS} rows")
    told = F.array(*[F.struct(F.lit(r.template).alias("template"), F.lit(r.social).alias("social")) for r in rows])
    each = df.withColumn("_plan", F.explode(told)).select("*", "_plan.*").drop("_plan")
    on = (F.col("social") == 1) & F.col("max_floors").isin(*SOCIAL_FLOORS)
    return each.select(
        *[c for c in each.columns if c not in ("density", "max_floors", "max_height", "far", "coverage")],
        F.when(on, F.col("density") * SOCIAL_DENSITY).otherwise(F.col("density")).alias("density"),
        F.when(on, SOCIAL_TO_FLOORS).otherwise(F.col("max_floors")).alias("max_floors"),
        F.when(on, SOCIAL_HEIGHT).otherwise(F.col("max_height")).alias("max_height"),
        F.when(on, -1.0).otherwise(F.col("far")).alias("far"),
        F.when(on, -1.0).otherwise(F.col("coverage")).alias("coverage"),
    )


def setback_area(shape: Column, street_sides: Column, front: Column, side: Column) -> Column:
    """The ring moved in: by ``front`` on street sides (places from 0), by ``side`` elsewhere."""

    def one(x, streets, f, s):
        ring = geo_udf.load(x)[0]
        on = set(int(k) for k in (streets if streets is not None else ()))
        return geo_udf.store(kernel.offset_edges(ring, [-f if k in on else -s for k in range(len(ring))]))

    f = F.pandas_udf(lambda *cols: pd.Series([one(*row) for row in zip(*cols, strict=True)]), g.SHAPE)
    return f(geo_udf.flat(shape), street_sides, front, side)


def slice_heights(slope: Column, height: Column, step: float = 0.1, reach: float = 50.0) -> Column:
    """Heights of an envelope's slices: multiples of step * slope below the limit, and the limit."""
    n = int(round(reach / step))
    levels = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: i * step * slope)
    return F.concat(F.filter(levels, lambda h: h < height), F.array(height))


def envelope(df: DataFrame, gross: str, build: str, slope: str, height: str, step: float = 0.1, reach: float = 50.0) -> DataFrame:
    """A row for each slice: its height, and the gross ring moved in by height / slope within the build area."""
    each = df.withColumn("slice_height", F.explode(slice_heights(F.col(slope), F.col(height), step, reach)))
    cut = geo_udf.offset(F.col(gross), -F.col("slice_height") / F.col(slope))
    return each.withColumn("slice", geo_udf.intersection(cut, F.col(build)))


def convex_envelope(df: DataFrame, gross: str, build: str, slope: str, height: str, step: float = 0.1, reach: float = 50.0) -> DataFrame:
    """envelope() of rings, the gross one convex and counter-clockwise, without leaving the JVM; slices are rings."""
    each = df.withColumn("slice_height", F.explode(slice_heights(F.col(slope), F.col(height), step, reach)))
    return each.withColumn("slice", clipping.convex_inset(F.col(build), F.col(gross), F.col("slice_height") / F.col(slope)))


def convex_setback(ring: Column, street_sides: Column, front: Column, side: Column) -> Column:
    """setback_area() of a convex counter-clockwise ring, without leaving the JVM."""
    dists = F.transform(ring, lambda _, k: F.when(F.array_contains(street_sides, k), -front).otherwise(-side))
    return clipping.convex_offset(ring, dists)


def convex_shadow(ring: Column, height: Column, towards: str) -> Column:
    """The shadow of a prism on a convex ring: the hull of it and its shifted copy."""
    return clipping.hull(F.concat(ring, g.shadow_shift(ring, height, towards)))


def slices_shadow(slices: DataFrame, keys: list[str], ring: str, height: str, towards: str, ground: str | None = None) -> DataFrame:
    """keys and area: the shadow of an envelope, the union of its slices' shifted rings, slices a row each.

    ``ground`` names a column with the public ground and streets (a shape, the
    same for all slices of a key) that are taken off it. Keys of any number of
    slices are spread over tasks.
    """
    moved = slices.withColumn("_moved", F.array(g.shadow_shift(F.col(ring), F.col(height), towards)))
    if ground is None:
        return overlay.merged_measures(moved, keys, "_moved").select(*keys, "area")
    points = dissolve.points_of(overlay.merged(moved, keys, "_moved"), keys)
    pairs = dissolve.shapes(points, keys).join(slices.groupBy(*keys).agg(F.first(ground).alias("_ground")), keys)
    return pairs.select(*keys, clipping.difference_area(F.col("shape"), F.col("_ground")).alias("area"))


def side_streets(parcels: DataFrame, key: str, ring: str, radius: float, contact: float = 4.0, step: float = 0.25, least: float = 10.0, share: float = 0.8) -> DataFrame:
    """(key, side, width) of the sides (from 0) of convex parcels that face a street: ground that no parcel covers.

    A side faces a street if half a metre in front of it is free for ``contact``
    metres. The street is ``least`` wide or more, and goes on in steps while
    ``share`` of each is free, up to ``radius``. All parcels stand in each other's
    way; they don't overlap. Rings are counter-clockwise and have one convex ring.

    A parcel is worked out in the tile that its reach begins in; parcels that a
    reach from a tile may come to are sent there too. So each is exchanged about
    once, and a task holds the parcels of a tile.
    """
    n = int(round(radius / step))
    depths = np.array([0.5, *[k * step for k in range(n + 1)]])
    # Of few bytes: a ring as its numbers.
    own = parcels.select(F.col(key).alias("key"), F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("_ring")).where("_ring IS NOT NULL")
    levels = own.select("_ring").mapInArrow(lambda batches: _levels(batches, radius), StructType(_fields("level:int"))).distinct().collect()
    levels = sorted(r.level for r in levels)
    place = _fields("_level:int,_cx:bigint,_cy:bigint,_home:boolean")
    placed = own.mapInArrow(lambda batches: _placed(batches, radius, levels), StructType([*own.schema.fields, *place]))
    order = ["_level", "_cx", "_cy"]
    spark = own.sparkSession
    dealt_rows = placed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)
    found = StructType([own.schema["key"], *_fields("side:int,width:double")])
    return dealt_rows.mapInArrow(lambda batches: _widths(batches, radius, depths, contact, step, least, share), found)


def _fields(text: str) -> list[StructField]:
    return list(StructType.fromDDL(text).fields)


def _in_front(x, y, sizes, rows, side, radius):
    """The chosen sides' lines, and the ground in front of them."""
    px, py, dx, dy = side_by_side.sides(x, y, sizes)
    at = (np.cumsum(sizes) - sizes)[rows] + side
    return (px[at], py[at], dx[at], dy[at]), side_by_side.fronts(x, y, sizes, rows, side, radius)


def _each_side(x, y, sizes):
    """Each ring's row and number for every side with a length."""
    _, _, dx, dy = side_by_side.sides(x, y, sizes)
    there = (dx != 0) | (dy != 0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows[there], (np.arange(len(x)) - (np.cumsum(sizes) - sizes)[rows])[there]


def _origin(x, y, sizes):
    """The rings' first corners, around which areas keep their digits."""
    at = np.minimum(np.cumsum(sizes) - sizes, max(len(x) - 1, 0))
    return (x[at], y[at]) if len(x) else (np.zeros(len(sizes)), np.zeros(len(sizes)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and numbers of corners of rings that are lists of numbers."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values[::2], values[1::2], sizes


def _local(x, y, sizes, ox, oy):
    return x - np.repeat(ox, sizes), y - np.repeat(oy, sizes), sizes


def _reaches(x, y, sizes, radius: float) -> np.ndarray:
    """(4, rings): bounds (x0, y0, x1, y1) that hold what lies in front of the rings' sides; not finite for rings without corners.

    Where no side meets the next one at less than a right angle, ground in front
    of it gets no wider, so the ring's bounds grown by the radius hold it.
    """
    out = _bounds_of(x, y, sizes) + np.array([[-1.0], [-1.0], [1.0], [1.0]]) * (radius * (1 + 1e-6))
    _, _, dx, dy = side_by_side.sides(x, y, sizes)
    after, own = side_by_side.following(sizes), np.repeat(np.arange(len(sizes)), sizes)
    size = np.hypot(dx, dy)
    straight = (size > 0) & (dx * dx[after] + dy * dy[after] >= -1e-9 * size * size[after])
    sharp = np.flatnonzero(np.bincount(own, ~straight, len(sizes)) > 0)
    if len(sharp):
        rx, ry, counts = side_by_side.taken(x, y, sizes, sharp)
        out[:, sharp] = _exact_reaches(rx, ry, counts, radius)
    return out


def _exact_reaches(x, y, sizes, radius: float) -> np.ndarray:
    """The bounds of what lies in front of the rings' sides."""
    ox, oy = _origin(x, y, sizes)
    rows, side = _each_side(x, y, sizes)
    _, (rx, ry, counts) = _in_front(*_local(x, y, sizes, ox, oy), rows, side, radius)
    own, out = np.repeat(rows, counts), []
    for f, v, o, start in ((np.minimum, rx, ox, np.inf), (np.minimum, ry, oy, np.inf), (np.maximum, rx, ox, -np.inf), (np.maximum, ry, oy, -np.inf)):
        to = np.full(len(sizes), start)
        f.at(to, own, v)
        out.append(to + o)
    return np.array(out)


def _bounds_of(x, y, sizes) -> np.ndarray:
    """(4, rings): the bounds of rings that have corners; not finite for others."""
    out, there = np.full((4, len(sizes)), np.nan), sizes > 0
    if there.any():
        first = (np.cumsum(sizes) - sizes)[there]
        out[:, there] = [f.reduceat(v, first) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))]
    return out


def _level_of(reach: np.ndarray) -> np.ndarray:
    """The lowest level of whose tiles a reach is MARGIN at most along both axes; -1 for no reach."""
    extent = np.maximum(reach[2] - reach[0], reach[3] - reach[1])
    there = np.isfinite(extent)
    level = np.ceil(np.log(np.where(there, np.maximum(extent, 1e-9), 1.0) / (TILE * MARGIN)) / np.log(4.0))
    return np.where(there, np.maximum(level, 0), -1).astype(np.int32)


def _levels(batches, radius: float):
    for batch in batches:
        levels = np.unique(_level_of(_reaches(*_flat(batch.column(0)), radius)))
        yield pa.RecordBatch.from_arrays([pa.array(levels[levels >= 0])], names=["level"])


def _placed(batches, radius: float, levels: list[int]):
    """Rows (key, _ring) once for the tile that their reach begins in (home), and once for each other tile from which a reach may come to them."""
    for batch in batches:
        x, y, sizes = _flat(batch.column(1))
        reach, bounds = _reaches(x, y, sizes, radius), _bounds_of(x, y, sizes)
        own, known = _level_of(reach), np.isfinite(bounds).all(axis=0)
        for level in levels:
            size = TILE * 4.0**level
            home = own == level
            hx, hy = (np.floor(np.where(home, v, 0.0) / size).astype(np.int64) for v in reach[:2])
            low = [np.floor((np.where(known, v, 0.0) - size * MARGIN) / size).astype(np.int64) for v in bounds[:2]]
            high = [np.floor(np.where(known, v, 0.0) / size).astype(np.int64) for v in bounds[2:]]
            wide, tall = (np.where(known, h - w + 1, 0) for w, h in zip(low, high, strict=True))
            rows = np.repeat(np.arange(len(sizes)), wide * tall)
            k = np.arange(len(rows)) - np.repeat(np.cumsum(wide * tall) - wide * tall, wide * tall)
            cx, cy = low[0][rows] + k // np.maximum(tall[rows], 1), low[1][rows] + k % np.maximum(tall[rows], 1)
            other = ~(home[rows] & (cx == hx[rows]) & (cy == hy[rows]))
            at = np.flatnonzero(home)
            rows, cx, cy = (np.concatenate(v) for v in ((rows[other], at), (cx[other], hx[at]), (cy[other], hy[at])))
            columns = [c.take(pa.array(rows)) for c in batch.columns]
            homes = np.arange(len(rows)) >= len(rows) - len(at)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows), level, np.int32)), pa.array(cx), pa.array(cy), pa.array(homes)], names=["key", "_ring", "_level", "_cx", "_cy", "_home"])


def _widths(batches, radius: float, depths: np.ndarray, contact: float, step: float, least: float, share: float):
    """(key, side, width) of the homes of rows in order of tiles, tile by tile."""
    for table in whole_groups(batches, ["_level", "_cx", "_cy"]):
        table = table.combine_chunks()
        tile = np.cumsum(np.any([changes(table.column(c)) for c in ("_level", "_cx", "_cy")], axis=0)) - 1
        rings = table.column("_ring").combine_chunks()
        x, y, sizes = _flat(rings)
        home, keys = np.flatnonzero(table.column("_home").to_numpy()), _numbers(table.column("key").combine_chunks())
        for at in range(0, len(home), side_by_side.ROWS):
            yield from _widths_of(table, home[at : at + side_by_side.ROWS], keys, tile, x, y, sizes, radius, depths, contact, step, least, share)


def _numbers(column: pa.Array) -> list[np.ndarray]:
    """Numbers that are equal where keys are, for each field of a struct."""
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    if pa.types.is_struct(column.type):
        return [v for c in column.flatten() for v in _numbers(c)]
    return [column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)]


def _widths_of(table, home, keys, tile, x, y, sizes, radius, depths, contact, step, least, share):
    """_widths of some homes, among all rows of their tiles."""
    bounds, known = _bounds_of(x, y, sizes), table.column("key").is_valid().to_numpy()
    hx, hy, corners = side_by_side.taken(x, y, sizes, home)
    reach = _reaches(hx, hy, corners, radius)
    ox, oy = _origin(hx, hy, corners)
    hx, hy, _ = _local(hx, hy, corners, ox, oy)
    rows, side = _each_side(hx, hy, corners)
    lines, (rx, ry, counts) = _in_front(hx, hy, corners, rows, side, radius)
    whole = side_by_side.areas_within(*side_by_side.along_side(rx, ry, counts, *lines), counts, depths)
    free = whole.copy()
    number = np.full((len(home), int(corners.max(initial=0))), -1)
    number[rows, side] = np.arange(len(rows))
    # Rows of a tile in order of their left ends, so a reach meets a stretch of them.
    there = np.flatnonzero(np.isfinite(bounds).all(axis=0))
    there = there[np.lexsort((bounds[0][there], tile[there]))]
    tiles = int(tile[-1]) + 1 if len(tile) else 0
    begins, widest = np.searchsorted(tile[there], np.arange(tiles + 1)), np.zeros(tiles)
    np.maximum.at(widest, tile[there], (bounds[2] - bounds[0])[there])
    own = tile[home]
    first, last = (outlines.places(bounds[0][there], begins, own, v, s) for v, s in ((reach[0] - widest[own], "left"), (reach[2], "right")))
    for k, o in outlines.each(first, np.where(np.isfinite(reach[0]), last - first, 0)):
        o = there[o]
        near = (reach[0][k] <= bounds[2][o]) & (bounds[0][o] <= reach[2][k]) & (reach[1][k] <= bounds[3][o]) & (bounds[1][o] <= reach[3][k]) & known[home[k]] & known[o]
        near[near] = ~np.all([c[home[k[near]]] == c[o[near]] for c in keys], axis=0)
        k, o = k[near], o[near]
        for part in range(0, len(k), side_by_side.ROWS):
            pair, other = k[part : part + side_by_side.ROWS], o[part : part + side_by_side.ROWS]
            mine, theirs = side_by_side.taken(hx, hy, corners, pair), side_by_side.taken(x, y, sizes, other)
            pairs, sides, areas = _covered(mine, _local(*theirs, ox[pair], oy[pair]), radius, depths)
            np.subtract.at(free, number[pair[pairs], sides], areas)
    faces = free[:, 0] / 0.5 >= contact - 1e-6
    width = np.full(len(rows), float(depths.size - 2) * step)
    for k in reversed(range(depths.size - 2)):
        if k * step >= least:
            width = np.where(free[:, k + 2] - free[:, k + 1] < (whole[:, k + 2] - whole[:, k + 1]) * share, k * step, width)
    rows, side, width = rows[faces], side[faces], width[faces]
    if len(rows):
        key = table.column("key").combine_chunks().take(pa.array(home[rows]))
        yield pa.RecordBatch.from_arrays([key, pa.array(side, pa.int32()), pa.array(width)], names=["key", "side", "width"])


def _covered(mine, theirs, radius: float, depths: np.ndarray):
    """(pair, side, areas): what the second ring of each pair takes within the depths in front of each side of the first that it meets."""
    x, y, sizes = mine
    tx, ty, there = theirs
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(depths)))
    rows, side = _each_side(x, y, sizes)
    rows, side = rows[there[rows] > 0], side[there[rows] > 0]
    # Only sides of which the other ring is in front, and near enough.
    px, py, dx, dy = side_by_side.sides(x, y, sizes)
    k = (np.cumsum(sizes) - sizes)[rows] + side
    cx, cy, counts = side_by_side.taken(tx, ty, there, rows)
    _, h = side_by_side.along_side(cx, cy, counts, px[k], py[k], dx[k], dy[k])
    first = np.cumsum(counts) - counts
    near = (np.maximum.reduceat(h, first) > 0) & (np.minimum.reduceat(h, first) < radius) if len(h) else np.zeros(0, bool)
    rows, side = rows[near], side[near]
    if not len(rows):
        return none
    lines, (rx, ry, counts) = _in_front(x, y, sizes, rows, side, radius)
    cx, cy, n = side_by_side.half_planes(*side_by_side.taken(tx, ty, there, rows), side_by_side.sides(rx, ry, counts), counts)
    areas = side_by_side.areas_within(*side_by_side.along_side(cx, cy, n, *lines), n, depths)
    met = np.flatnonzero(areas[:, -1] > 0)
    return rows[met], side[met], areas[met]


def slice_at(slices: Column, height: Column) -> Column:
    """The ring at a height from an ordered array of (height, ring): between its neighbours, or the lower one where corners differ.

    Below the first slice, the first; above the last, the last.
    """
    at = F.struct(slices.alias("slices"), height.alias("height"))

    def around(v: Column) -> Column:
        under = F.filter(v["slices"], lambda s: s["height"] < v["height"])
        over = F.filter(v["slices"], lambda s: s["height"] >= v["height"])
        below = g.let(under, lambda u: F.get(u, F.size(u) - 1))
        return F.struct(below.alias("below"), F.when(v["height"].isNull(), F.get(v["slices"], F.lit(0))).otherwise(F.get(over, F.lit(0))).alias("above"), v["height"].alias("height"))

    def shared(v: Column) -> Column:
        share = (v["above"]["height"] - v["height"]) / (v["above"]["height"] - v["below"]["height"])
        return F.struct(v["below"]["ring"].alias("below"), v["above"]["ring"].alias("above"), share.alias("share"))

    def mixed(v: Column) -> Column:
        mix = lambda a, b, c: a[c] * v["share"] + b[c] * (F.lit(1.0) - v["share"])
        rings = F.zip_with(v["below"], v["above"], lambda a, b: g.point(mix(a, b, "x"), mix(a, b, "y")))
        return F.when(v["below"].isNull(), v["above"]).when(v["above"].isNull(), v["below"]).when(F.size(v["below"]) == F.size(v["above"]), rings).otherwise(v["below"])

    # Each step is computed once: within expressions of corners it would be at each of their uses.
    return g.let(g.let(g.let(at, around), shared), mixed)


_SHIFT = {"p": (-1 / 0.49, 0.0), "o": (1 / 0.49, 0.0), "s": (0.0, -1 / 1.54)}


def building_shadow(base: kernel.Shape, height: float, towards: str, public: kernel.Shape = (), streets: kernel.Shape = ()) -> kernel.Shape:
    """Each part's hull with its shifted copy, united, less public ground and streets."""
    dx, dy = _SHIFT[towards]
    hulls = [[kernel.hull(np.vstack([r, r + np.array([dx, dy]) * height]))] for r in base]
    out = kernel.union(hulls) if hulls else []
    for ground in (public, streets):
        if len(ground):
            out = kernel.difference(out, list(ground))
    return out


def envelope_shadow(slices: list[tuple[float, kernel.Shape]], towards: str, public: kernel.Shape = (), streets: kernel.Shape = ()) -> kernel.Shape:
    """The union of all slices' shifted rings, less public ground and streets."""
    dx, dy = _SHIFT[towards]
    moved = [[r + np.array([dx, dy]) * h for r in shape] for h, shape in slices]
    out = kernel.union(moved) if moved else []
    for ground in (public, streets):
        if len(ground):
            out = kernel.difference(out, list(ground))
    return out


def shadow_area(base: Column, height: Column, towards: str) -> Column:
    f = F.pandas_udf(lambda b, h: pd.Series([kernel.area(building_shadow(geo_udf.load(x), float(z), towards)) for x, z in zip(b, h, strict=True)]), "double")
    return f(geo_udf.flat(base), height)


def streets(target: kernel.Shape, parcels: kernel.Shape, radius: float, contact: float = 4.0, step: float = 0.25, most: float = 10.0, share: float = 0.8) -> dict:
    """Streets around a parcel: what of its buffer no parcel covers.

    A side faces a street if it touches one for ``contact`` metres. The width
    grows from ``step`` while ``share`` of each new strip is street.
    """
    ring = kernel.oriented(target[0])
    closed = kernel.offset(kernel.offset(kernel.union([parcels, target]), 0.1), -0.1)
    ground = kernel.difference(kernel.buffer(target, radius), closed)
    sides, widths = [], []
    for k in range(len(ring)):
        d = np.zeros(len(ring))
        d[k] = 0.5
        strip = kernel.difference(kernel.offset_edges(ring, d), [ring])
        if kernel.intersection_area(strip, ground) / 0.5 < contact:
            continue
        sides.append(k)
        width, before, before_all = 0.0, 0.0, 0.0
        for _ in range(int(2 * radius / step)):
            d[k] = width + step
            strip = kernel.difference(kernel.offset_edges(ring, d), [ring])
            got, all_ = kernel.intersection_area(strip, ground), kernel.area(strip)
            if width >= most and (got - before) < share * (all_ - before_all):
                break
            before, before_all, width = got, all_, width + step
        widths.append(width)
    half, whole = np.zeros(len(ring)), np.zeros(len(ring))
    half[sides], whole[sides] = np.array(widths) / 2, widths
    return {"ground": ground, "sides": sides, "widths": widths, "gross": kernel.offset_edges(ring, half), "public": kernel.offset(kernel.offset_edges(ring, whole), 0.1)}


def street_sides(df: DataFrame, shape: str, parcels: str, radius: float) -> DataFrame:
    """``df`` with the street sides (from 0), their widths, and the gross and public shapes."""

    @F.pandas_udf(f"sides array<int>, widths array<double>, gross {g.SHAPE}, public {g.SHAPE}")
    def run(own: pd.Series, others: pd.Series) -> pd.DataFrame:
        found = [streets(geo_udf.load(s), geo_udf.load(p), radius) for s, p in zip(own, others, strict=True)]
        rows = [(f["sides"], f["widths"], geo_udf.store(f["gross"]), geo_udf.store(f["public"])) for f in found]
        return pd.DataFrame(rows, columns=["sides", "widths", "gross", "public"])

    told = df.withColumn("_streets", run(geo_udf.flat(F.col(shape)), geo_udf.flat(F.col(parcels))))
    return told.select(*df.columns, "_streets.sides", "_streets.widths", "_streets.gross", "_streets.public")


def prism_faces(slices: list[tuple[float, np.ndarray]], near: float = 5.0) -> list[np.ndarray]:
    """The faces between consecutive slices: parallel sides at most ``near`` apart are joined, the top closed."""
    faces = []
    for (h0, a), (h1, b) in zip(slices, slices[1:], strict=False):
        mids = [(b[k] + b[(k + 1) % len(b)]) / 2 for k in range(len(b))]
        for i in range(len(a)):
            p, q = a[i], a[(i + 1) % len(a)]
            u = (q - p) / max(np.linalg.norm(q - p), 1e-12)
            best = None
            for k in range(len(b)):
                r, s = b[k], b[(k + 1) % len(b)]
                v = (s - r) / max(np.linalg.norm(s - r), 1e-12)
                if abs(u[0] * v[1] - u[1] * v[0]) < 0.0015:
                    gap = abs(u[0] * (mids[k] - p)[1] - u[1] * (mids[k] - p)[0])
                    if gap <= near and (best is None or gap < best[0]):
                        best = (gap, r, s)
            if best:
                _, r, s = best
                faces.append(np.array([[*p, h0], [*q, h0], [*s, h1], [*r, h1]]))
    if slices:
        h, top = slices[-1]
        faces.append(np.column_stack([top, np.full(len(top), h)]))
    return faces
