"""Borders that parcels share, exactly; without leaving the JVM, or in bulk in numpy for blocks of few sides.

Every side of a parcel lies on a line, known by its direction and its offset from
the block's corner. Sides are joined on their block, their line in coarse steps
and their stretch of it; the length they share is then computed. One side of a
pair is listed under its own step only, the other under all steps within the
tolerance, so a pair meets once for each stretch and counts at its first one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import geometry as g
from . import side_by_side
from .rounds import changes, whole_groups

#: Steps of direction (radians), offset and stretch (metres) by which sides are joined.
TURN, OFFSET, STRETCH = 0.01, 1.0, 32.0
#: Corners of a block up to which one task tries all pairs of its sides, and of the blocks that it works on at once.
SMALL, CORNERS = 256, 50_000


def outward(shape: Column) -> Column:
    """Outer rings counter-clockwise: all rings are turned over where their signed areas add up below zero."""
    return F.when(g.shape_area(shape) < 0, F.transform(shape, lambda r: F.reverse(r))).otherwise(shape)


def sides(parcels: DataFrame, keys: list[str], shape: str) -> DataFrame:
    """keys and (x0, y0, x1, y1) of each side, with the parcel on its left; sides without length are left out."""
    rings = parcels.select(*keys, F.explode(outward(F.col(shape))).alias("_ring"))
    lines = rings.select(*keys, F.explode(g.sides(F.col("_ring"))).alias("_line"))
    ends = [F.col("_line")[k][c].alias(f"{c}{k}") for k in (0, 1) for c in "xy"]
    return lines.select(*keys, *ends).where("x0 <> x1 OR y0 <> y1")


def _steps(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def shared_borders(parcels: DataFrame, key: str, block: str, shape: str, tolerance: float = 0.05, bulk: bool = False) -> DataFrame:
    """(block, a, b, shared): the length of border that parcels a < b of one block share.

    Sides share where they run against each other, at most g.PARALLEL radians
    off, and the other is at most ``tolerance`` away at both ends of the common
    stretch. Parcels without a common stretch, null shapes and null blocks give
    no row. Parcels on both sides of a line may be cut at different places.

    With ``bulk``, blocks of up to SMALL corners are exchanged once, whole, and
    worked out in numpy; larger ones go by the joins on lines as without it.
    """
    if not bulk:
        return _by_lines(parcels, key, block, shape, tolerance)
    own = parcels.select(F.col(block).alias("block"), F.col(key).alias("k"), F.col(shape).alias("_shape")).where("block IS NOT NULL AND k IS NOT NULL")
    sizes = own.groupBy("block").agg(F.sum(_corners()).alias("_n"))
    found = _in_tasks(own, tolerance)
    if not sizes.where(F.col("_n") > SMALL).limit(1).count():
        return found
    large = own.withColumn("_n", _in_block()).where(F.col("_n") > SMALL)
    return found.unionByName(_by_lines(large, "k", "block", "_shape", tolerance))


def _corners() -> Column:
    return F.coalesce(F.aggregate("_shape", F.lit(0).cast("bigint"), lambda n, r: n + F.greatest(F.size(r), F.lit(0))), F.lit(0).cast("bigint"))


def _in_block() -> Column:
    """Corners of all shapes in a row's block."""
    every = Window.partitionBy("block").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.sum(_corners()).over(every)


def _in_tasks(parcels: DataFrame, tolerance: float) -> DataFrame:
    """shared_borders of (block, k, _shape) in blocks of up to SMALL corners."""
    # The window exchanges and sorts; the sort after it says what the task counts on and costs nothing.
    rows = parcels.withColumn("_n", _in_block()).where(F.col("_n") <= SMALL).select("block", "k", "_shape").sortWithinPartitions("block", "k")
    kinds = [StructField(name, rows.schema[of].dataType) for name, of in (("block", "block"), ("a", "k"), ("b", "k"))]

    def run(batches):
        for table in whole_groups(batches, "block"):
            for part in _parts(table):
                found = borders_of_rows(part, tolerance)
                if found.num_rows:
                    yield from found.to_batches()

    return rows.mapInArrow(run, StructType([*kinds, StructField("shared", DoubleType())]))


def _parts(rows: pa.Table) -> Iterator[pa.Table]:
    """The table in pieces of about CORNERS corners, blocks whole."""
    rings = rows.column("_shape").combine_chunks()
    held = np.repeat(np.arange(rows.num_rows), rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    sizes = rings.flatten().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(np.bincount(held, sizes, rows.num_rows))])
    starts = np.append(np.flatnonzero(changes(rows.column("block"))), rows.num_rows)
    at = 0
    while at < len(starts) - 1:
        to = max(int(np.searchsorted(before[starts], before[starts[at]] + CORNERS, "right")) - 1, at + 1)
        yield rows.slice(starts[at], starts[to] - starts[at])
        at = to


def borders_of_rows(rows: pa.Table, tolerance: float) -> pa.Table:
    """(block, a, b, shared) of rows (block, k, _shape) in order of blocks and keys, all blocks at once: each side meets the one d places on in its block, d = 1, 2, ..."""
    rows = rows.combine_chunks()
    shapes = rows.column("_shape").combine_chunks()
    each = shapes.flatten()
    x, y, corners = side_by_side.corners(each)
    of_ring = np.repeat(np.arange(rows.num_rows), shapes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    ring = np.repeat(np.arange(len(corners)), corners)
    after = side_by_side.following(corners)
    # Twice the area, seen from the ring's first corner; rings turn where their row's areas add up below zero.
    first = (np.cumsum(corners) - corners)[ring]
    px, py = x - x[first], y - y[first]
    twice = np.bincount(of_ring[ring], px * py[after] - px[after] * py, rows.num_rows)
    row = of_ring[ring]
    back = twice[row] < 0
    x0, y0, x1, y1 = np.where(back, x[after], x), np.where(back, y[after], y), np.where(back, x, x[after]), np.where(back, y, y[after])
    real = (x0 != x1) | (y0 != y1)
    x0, y0, x1, y1, row = (v[real] for v in (x0, y0, x1, y1, row))
    new_block = changes(rows.column("block"))
    owners = np.flatnonzero(new_block | changes(rows.column("k")))
    owner = (np.searchsorted(owners, np.arange(rows.num_rows), "right") - 1)[row]
    block = np.cumsum(new_block)[row]
    n = len(row)
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if n else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, n))
    if n:
        cx, cy = (np.repeat(np.minimum.reduceat(v, starts), lengths) for v in (x0, y0))
        x0, y0, x1, y1 = x0 - cx, y0 - cy, x1 - cx, y1 - cy
    left = np.repeat(starts + lengths, lengths) - np.arange(n) - 1
    dx, dy = x1 - x0, y1 - y0
    size = np.sqrt(dx * dx + dy * dy)
    i, d, met = np.arange(n), 1, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(i := i[left[i] >= d]):
        j = i + d
        against = dx[i] * dx[j] + dy[i] * dy[j] < 0
        level = np.abs(dx[i] * dy[j] - dy[i] * dx[j]) <= math.sin(g.PARALLEL) * size[i] * size[j]
        fits = against & level & (owner[i] != owner[j])
        met.append((i[fits], j[fits]))
        d += 1
    i, j = (np.concatenate(v) for v in zip(*met, strict=True))
    ax, ay, long = dx[i], dy[i], size[i]
    # Places and distances of j's ends in i's frame; i runs from 0 to its size.
    at = [((v[j] - x0[i]) * ax + (w[j] - y0[i]) * ay) / long for v, w in ((x0, y0), (x1, y1))]
    aside = [((w[j] - y0[i]) * ax - (v[j] - x0[i]) * ay) / long for v, w in ((x0, y0), (x1, y1))]
    begin, end = np.maximum(0.0, np.minimum(*at)), np.minimum(long, np.maximum(*at))
    drift = lambda t: np.abs(aside[0] + (t - at[0]) / (at[1] - at[0]) * (aside[1] - aside[0]))
    fits = (end - begin > 1e-6) & (drift(begin) <= tolerance) & (drift(end) <= tolerance)
    pair, which = np.unique(owner[i[fits]] * np.int64(len(owners) + 1) + owner[j[fits]], return_inverse=True)
    shared = np.bincount(which, (end - begin)[fits], len(pair))
    a, b = owners[pair // (len(owners) + 1)], owners[pair % (len(owners) + 1)]
    k = rows.column("k")
    return pa.table({"block": rows.column("block").take(pa.array(a)), "a": k.take(pa.array(a)), "b": k.take(pa.array(b)), "shared": shared})


def _by_lines(parcels: DataFrame, key: str, block: str, shape: str, tolerance: float) -> DataFrame:
    """shared_borders by joins on lines, for blocks of any size."""
    s = sides(parcels.select(F.col(block).alias("block"), F.col(key).alias("k"), F.col(shape).alias("_shape")), ["block", "k"], "_shape")
    corners = s.groupBy("block").agg(F.min("x0").alias("cx"), F.min("y0").alias("cy"))
    s = s.join(corners.hint("merge"), "block")
    for c in ("x0", "x1"):
        s = s.withColumn(c, F.col(c) - F.col("cx"))
    for c in ("y0", "y1"):
        s = s.withColumn(c, F.col(c) - F.col("cy"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    forward = (dx > 0) | ((dx == 0) & (dy > 0))
    s = s.withColumn("turn", F.atan2(F.when(forward, dy).otherwise(-dy), F.when(forward, dx).otherwise(-dx)))
    u, v = F.cos("turn"), F.sin("turn")
    along = [F.col(f"x{k}") * u + F.col(f"y{k}") * v for k in (0, 1)]
    s = s.withColumn("low", F.least(*along)).withColumn("high", F.greatest(*along))
    s = s.withColumn("off", (F.col("y0") + F.col("y1")) / 2 * u - (F.col("x0") + F.col("x1")) / 2 * v)

    a = s.select("block", *[F.col(c).alias(f"a_{c}") for c in ("k", "x0", "y0", "x1", "y1", "turn", "low")], "off", "low", "high")
    a = a.withColumn("_turn", F.floor(F.col("a_turn") / TURN)).withColumn("_off", F.floor(F.col("off") / OFFSET))
    a = a.withColumn("_stretch", F.explode(_steps(F.col("low"), F.col("high"), STRETCH))).drop("off", "low", "high")

    # A side's line seen in the other direction too, where its own is next to the end of the half turn.
    own = F.struct("turn", "off", "low", "high")
    other = F.struct((F.col("turn") - F.signum("turn") * math.pi).alias("turn"), (-F.col("off")).alias("off"), (-F.col("high")).alias("low"), (-F.col("low")).alias("high"))
    views = F.when(F.abs("turn") > math.pi / 2 - 2 * g.PARALLEL, F.array(own, other)).otherwise(F.array(own))
    b = s.select("block", *[F.col(c).alias(f"b_{c}") for c in ("k", "x0", "y0", "x1", "y1")], F.explode(views).alias("w"))
    reach = F.greatest(*[F.sqrt(F.col(f"b_x{k}") * F.col(f"b_x{k}") + F.col(f"b_y{k}") * F.col(f"b_y{k}")) for k in (0, 1)])
    wide = F.lit(tolerance) + reach * (2 * g.PARALLEL)
    b = b.withColumn("_turn", F.explode(_steps(F.col("w.turn") - g.PARALLEL, F.col("w.turn") + g.PARALLEL, TURN)))
    b = b.withColumn("_off", F.explode(_steps(F.col("w.off") - wide, F.col("w.off") + wide, OFFSET)))
    b = b.withColumn("_stretch", F.explode(_steps(F.col("w.low") - wide, F.col("w.high") + wide, STRETCH))).drop("w")

    pairs = a.join(b.hint("merge"), ["block", "_turn", "_off", "_stretch"]).where("a_k < b_k")
    ax, ay, bx, by = F.col("a_x1") - F.col("a_x0"), F.col("a_y1") - F.col("a_y0"), F.col("b_x1") - F.col("b_x0"), F.col("b_y1") - F.col("b_y0")
    size = F.sqrt(ax * ax + ay * ay)
    # Places and distances of b's ends in a's frame; a runs from 0 to its size.
    at = [((F.col(f"b_x{k}") - F.col("a_x0")) * ax + (F.col(f"b_y{k}") - F.col("a_y0")) * ay) / size for k in (0, 1)]
    aside = [((F.col(f"b_y{k}") - F.col("a_y0")) * ax - (F.col(f"b_x{k}") - F.col("a_x0")) * ay) / size for k in (0, 1)]
    pairs = pairs.where(ax * bx + ay * by < 0).where(F.abs(ax * by - ay * bx) <= math.sin(g.PARALLEL) * size * F.sqrt(bx * bx + by * by))
    pairs = pairs.select("block", "_stretch", F.col("a_k").alias("a"), F.col("b_k").alias("b"), "a_turn", "a_low", ((F.cos("a_turn") * ax + F.sin("a_turn") * ay) > 0).alias("same"), size.alias("size"), *[c.alias(f"{n}{k}") for n, cs in (("at", at), ("aside", aside)) for k, c in enumerate(cs)])
    pairs = pairs.withColumn("begin", F.greatest(F.lit(0.0), F.least("at0", "at1"))).withColumn("end", F.least("size", F.greatest("at0", "at1"))).where("end - begin > 1e-6")
    drift = lambda t: F.abs(F.col("aside0") + (F.col(t) - F.col("at0")) / (F.col("at1") - F.col("at0")) * (F.col("aside1") - F.col("aside0")))
    first = F.col("a_low") + F.when(F.col("same"), F.col("begin")).otherwise(F.col("size") - F.col("end"))
    pairs = pairs.where((drift("begin") <= tolerance) & (drift("end") <= tolerance) & (F.floor(first / STRETCH) == F.col("_stretch")))
    return pairs.groupBy("block", "a", "b").agg(F.sum(F.col("end") - F.col("begin")).alias("shared"))
