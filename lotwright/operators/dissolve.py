"""Shapes of a group made one, without a task that holds the group.

Parcels that lie side by side run along their common border in opposite
directions. Their sides are put on a grid, cut where another corner of the group
lies on them, and counted with their direction: what adds up to nothing is inside,
the rest is the outline. Each piece of the outline knows the piece that follows
it, and rings are named and numbered by doubling steps along these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, MapType, StructField, StructType, VariantType
from pyspark.sql.window import Window

from . import outlines
from .borders import sides
from .rounds import drop, keep, whole_groups

#: Units of a cell by which corners and sides are joined, and of the grid in metres.
CELL, GRID = 1000, 0.01
#: Corners of a group up to which all are tried on each of its sides, and pieces of a group up to which one task follows its rings.
FEW, SMALL = 64, 20_000
#: Pieces that a task follows at once, about.
BATCH = 200_000
_ENDS = ["ax", "ay", "bx", "by"]


def cells_along(near: float) -> Column:
    """The cells around points of a side (ax, ay, bx, by) that are half a cell apart: all that hold a point at most ``near`` from it."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    steps = F.ceil(F.sqrt((dx * dx + dy * dy).cast("double")) * 2 / CELL) + 1
    spots = F.transform(F.sequence(F.lit(0).cast("bigint"), steps), lambda k: F.struct((F.col("ax") + dx * k / steps).alias("x"), (F.col("ay") + dy * k / steps).alias("y")))
    around = lambda p, c: F.sequence(F.floor((p[c] - CELL / 4 - near) / CELL), F.floor((p[c] + CELL / 4 + near) / CELL))
    return F.array_distinct(F.flatten(F.transform(spots, lambda p: F.flatten(F.transform(around(p, "x"), lambda i: F.transform(around(p, "y"), lambda j: F.struct(i.alias("i"), j.alias("j"))))))))


def outline(parts: DataFrame, keys: list[str], shape: str, grid: float = GRID, tolerance: float = 0.02) -> DataFrame:
    """keys and (ax, ay, bx, by): the pieces of each group's outline in units of ``grid``, the group on their left.

    The shapes of a group may touch but not overlap; equal ones count once. A
    corner at most ``tolerance`` from a side cuts it.
    """
    ends = [F.round(F.col(c) / grid).cast("bigint").alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), _ENDS, strict=True)]
    s = sides(parts.select(*keys, F.col(shape).alias("_shape")).distinct(), keys, "_shape").select(*keys, *ends).where("ax <> bx OR ay <> by").distinct()
    corners = s.select(*keys, F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    corners = corners.withColumn("_cx", F.floor(F.col("x") / CELL)).withColumn("_cy", F.floor(F.col("y") / CELL))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = F.sqrt((dx * dx + dy * dy).cast("double"))
    near = tolerance / grid
    # Corners of groups that have few are all tried: sides need not be listed under cells, which are many more rows to exchange.
    sizes = corners.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    few = F.col("_n") <= FEW
    at_once = F.array(F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j")))
    corners = corners.join(sizes.hint("merge"), keys)
    for c in ("_cx", "_cy"):
        corners = corners.withColumn(c, F.when(few, F.lit(0).cast("bigint")).otherwise(F.col(c)))
    listed = s.join(sizes.hint("merge"), keys).select(*keys, *_ENDS, F.explode(F.when(few, at_once).otherwise(cells_along(near))).alias("_c"))
    listed = listed.select(*keys, *_ENDS, F.col("_c.i").alias("_cx"), F.col("_c.j").alias("_cy"))
    met = listed.join(corners.drop("_n").hint("merge"), [*keys, "_cx", "_cy"])
    at = ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / size
    aside = F.abs((F.col("y") - F.col("ay")) * dx - (F.col("x") - F.col("ax")) * dy) / size
    met = met.where((aside <= near) & (at > near) & (at < size - near))
    cuts = met.groupBy(*keys, *_ENDS).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "x", "y"))).alias("cuts"))
    s = s.join(cuts.hint("merge"), [*keys, *_ENDS], "left")
    spot = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    # A side without cuts is its two ends.
    inner = F.transform("cuts", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    whole = F.array(spot("ax", "ay"), spot("bx", "by"))
    s = s.select(*keys, F.when(F.col("cuts").isNull(), whole).otherwise(F.concat(F.array(whole[0]), inner, F.array(whole[1]))).alias("p"))
    pieces = s.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.struct(F.element_at("p", k).alias("a"), F.element_at("p", k + 1).alias("b")))).alias("e"))
    ahead = F.col("e.a") < F.col("e.b")
    low, high = F.when(ahead, F.col("e.a")).otherwise(F.col("e.b")), F.when(ahead, F.col("e.b")).otherwise(F.col("e.a"))
    net = pieces.select(*keys, low.alias("l"), high.alias("h"), F.when(ahead, 1).otherwise(-1).alias("way")).groupBy(*keys, "l", "h").agg(F.sum("way").alias("net")).where("net <> 0")
    on = F.col("net") > 0
    a, b = F.when(on, F.col("l")).otherwise(F.col("h")), F.when(on, F.col("h")).otherwise(F.col("l"))
    return net.select(*keys, a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


def followed(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, e and next: each piece and the one after it.

    Where several begin, it is the first to the right of the way back: regions
    that meet in a corner stay apart, and holes that do are one ring.
    """
    into = edges.select(*keys, F.struct(*_ENDS).alias("e"), F.col("bx").alias("x"), F.col("by").alias("y"))
    out = edges.select(*keys, F.struct(*_ENDS).alias("f"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    back = F.atan2(F.col("e.ay") - F.col("e.by"), F.col("e.ax") - F.col("e.bx"))
    on = F.atan2(F.col("f.by") - F.col("f.ay"), F.col("f.bx") - F.col("f.ax"))
    right = F.pmod(back - on, F.lit(2 * math.pi))
    right = F.when(right < 1e-12, 2 * math.pi).otherwise(right)
    return into.join(out.hint("merge"), [*keys, "x", "y"]).groupBy(*keys, "e").agg(F.min_by("f", right).alias("next"))


def _hop(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """``df`` (keys, e, next, ...) beside the row of its next, as ``n``, with new columns."""
    there = df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*[c for c in df.columns if c not in keys]).alias("n"))
    same = [df[k].eqNullSafe(there[f"_{k}"]) for k in keys]
    on = df["next"] == F.col("n.e")
    for c in same:
        on = on & c
    return df.join(there.hint("merge"), on, "left").select(*keys, "e", *[c.alias(n) for n, c in columns.items()])


def numbered(edges: DataFrame, keys: list[str], rounds: int = 60) -> DataFrame:
    """keys, ring (its smallest piece), place (from 0 at that piece), pieces of the ring, where the piece before begins (from), and the piece's ends.

    Groups of up to SMALL pieces are exchanged once and followed side by side in
    tasks; what larger ones need is exchanged in rounds. A round doubles the way
    that each piece sees: there are about twice the logarithm of the longest
    ring's pieces. Raises if ``rounds`` don't settle it.
    """
    links = keep(followed(edges, keys))
    sizes = links.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = keep(sizes.where(F.col("_n") > SMALL).select(*keys))
    if not large.limit(1).count():
        return _followed_in_tasks(links, keys, rounds)
    far = keep(links.join(large.hint("merge"), keys, "left_semi"))
    return _followed_in_tasks(links.join(large.hint("merge"), keys, "left_anti"), keys, rounds).unionByName(_in_rounds(far, keys, rounds))


def _followed_in_tasks(links: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """numbered() of links (keys, e, next) of groups of which a task can hold each; all groups of a batch are followed at once."""
    group = [F.xxhash64(*keys).alias("_g"), F.xxhash64(F.lit(1), *keys).alias("_h")]
    rows = links.select(F.struct(*keys).alias("k"), *group, "e", "next").repartition("_g", "_h").sortWithinPartitions("_g", "_h", "e")
    piece, start = rows.schema["e"].dataType, StructType([StructField(c, LongType()) for c in ("ax", "ay")])
    schema = StructType([rows.schema["k"], StructField("ring", piece), StructField("place", LongType()), StructField("pieces", LongType()), StructField("from", start), StructField("e", piece)])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size < BATCH:
                continue
            # The last hash's rows wait for what may follow of their group.
            rows = pa.Table.from_batches(held)
            g = rows.column("_g").to_numpy()
            end = int(np.searchsorted(g, g[-1]))
            if end:
                yield from ring_places(rows.slice(0, end), rounds).to_batches()
                held, size = rows.slice(end).to_batches(), len(g) - end
        if size:
            yield from ring_places(pa.Table.from_batches(held), rounds).to_batches()

    return rows.mapInArrow(run, schema).select("k.*", "ring", "place", "pieces", "from", "e.*")


def ring_places(rows: pa.Table, rounds: int = 60) -> pa.Table:
    """(k, ring, place, pieces, from, e) of rows (k, _g, _h, e, next): a group's pieces lie side by side, in order."""
    rows, n = rows.combine_chunks(), rows.num_rows
    g, h = (rows.column(c).to_numpy() for c in ("_g", "_h"))
    group = np.concatenate([[0], np.cumsum((g[1:] != g[:-1]) | (h[1:] != h[:-1]))])
    own, then = ([pc.struct_field(rows.column(name), c).to_numpy() for c in _ENDS] for name in ("e", "next"))
    # Each piece's next one: equal rows of group and ends lie side by side, the piece itself before those that name it.
    both = [np.concatenate([group, group]), *[np.concatenate(x) for x in zip(own, then, strict=True)]]
    order = np.lexsort(both[::-1])
    new = np.concatenate([[True], np.any([v[order][1:] != v[order][:-1] for v in both], axis=0)])
    follows = np.empty(2 * n, np.int64)
    follows[order] = order[np.maximum.accumulate(np.where(new, np.arange(2 * n), 0))]
    follows = follows[n:]
    every = np.arange(n)
    ring, ahead = every, follows
    for _ in range(rounds):
        least = np.minimum(ring, ring[ahead])
        if (least == ring).all():
            break
        ring, ahead = least, ahead[ahead]
    else:
        raise RuntimeError(f"rings did not settle in {rounds} rounds")
    # Steps left to the ring's smallest piece; row n is behind it.
    left = np.append((ring != every).astype(np.int64), 0)
    ahead = np.append(np.where(ring == every, n, follows), n)
    while (ahead != n).any():
        left, ahead = left + left[ahead], ahead[ahead]
    pieces = np.bincount(ring, minlength=n)[ring]
    place = (pieces - left[:n]) % pieces
    by_place = np.lexsort((place, ring))
    first = np.concatenate([[0], np.cumsum(np.bincount(ring, minlength=n))])[ring]
    before = by_place[first + (place - 1) % pieces]
    e = pa.concat_arrays(rows.column("e").chunks)
    start = pa.StructArray.from_arrays([pa.array(own[k][before]) for k in (0, 1)], ["ax", "ay"])
    return pa.table({"k": rows.column("k"), "ring": e.take(pa.array(ring)), "place": place, "pieces": pieces, "from": start, "e": e})


def _in_rounds(links: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """numbered() of links of groups of any size."""
    seen = keep(links.withColumn("ring", F.col("e")))
    for _ in range(rounds):
        new = keep(_hop(seen, keys, {"next": F.col("n.next"), "ring": F.least("ring", "n.ring"), "old": F.col("ring")}))
        moved = new.where("ring <> old").limit(1).count()
        drop(seen)
        seen = new.drop("old")
        seen._kept = new._kept
        if not moved:
            break
    else:
        raise RuntimeError(f"rings did not settle in {rounds} rounds")
    named = seen.select(*keys, "e", "ring")
    led = links.join(named.hint("merge"), [*keys, "e"]).withColumn("next", F.when(F.col("e") != F.col("ring"), F.col("next")))
    left = keep(led.withColumn("left", F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint")))
    drop(links, seen)
    for _ in range(rounds):
        if not left.where("next is not null").limit(1).count():
            break
        new = keep(_hop(left, keys, {"next": F.col("n.next"), "ring": F.col("ring"), "left": F.col("left") + F.coalesce(F.col("n.left"), F.lit(0))}))
        drop(left)
        left = new
    else:
        raise RuntimeError(f"places did not settle in {rounds} rounds")
    sizes = left.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("pieces"))
    placed = left.join(sizes.hint("merge"), [*keys, "ring"])
    found = placed.select(*keys, "ring", F.pmod(F.col("pieces") - F.col("left"), F.col("pieces")).alias("place"), "pieces", "e.*")
    before = found.select(*keys, "ring", F.struct("ax", "ay").alias("from"), F.pmod(F.col("place") + 1, F.col("pieces")).alias("place"))
    return found.join(before.hint("merge"), [*keys, "ring", "place"]).select(*keys, "ring", "place", "pieces", "from", *_ENDS)


def rings(parts: DataFrame, keys: list[str], shape: str, grid: float = GRID, tolerance: float = 0.02) -> DataFrame:
    """keys, ring, place, x, y, corner: the outline's points in order, outer rings counter-clockwise, holes clockwise.

    ``corner`` tells where the outline bends. A ring may pass a point twice, where
    holes meet. Groups with a null key are left out. Groups of any size are spread over
    tasks; null shapes and shapes without area add nothing.
    """
    return points_of(outline(parts, keys, shape, grid, tolerance), keys, grid)


def points_of(edges: DataFrame, keys: list[str], grid: float = GRID) -> DataFrame:
    """The points of rings() from the pieces of an outline."""
    met = numbered(edges, keys)
    cross = (F.col("ax") - F.col("from.ax")) * (F.col("by") - F.col("ay")) - (F.col("ay") - F.col("from.ay")) * (F.col("bx") - F.col("ax"))
    sizes = F.sqrt((F.pow(F.col("ax") - F.col("from.ax"), 2) + F.pow(F.col("ay") - F.col("from.ay"), 2)) * (F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2)))
    return met.select(*keys, "ring", "place", (F.col("ax") * grid).alias("x"), (F.col("ay") * grid).alias("y"), (F.abs(cross) > math.sin(5e-3) * sizes).alias("corner"), *_ENDS)


def _cross() -> Column:
    """Twice what a piece adds to its ring's area, seen from the ring's first point: products of far places would not fit in 64 bits."""
    ax, ay, bx, by = (F.col(c) - F.col(f"ring.a{c[1]}") for c in _ENDS)
    return ax * by - bx * ay


def measures(points: DataFrame, keys: list[str], grid: float = GRID) -> DataFrame:
    """keys and area, perimeter, rings, holes and corners of rings()' points."""
    cross = _cross().cast("double") * (grid * grid / 2)
    size = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2)) * grid
    each = points.groupBy(*keys, "ring").agg(F.sum(cross).alias("area"), F.sum(size).alias("size"), F.count_if("corner").alias("corners"))
    return each.groupBy(*keys).agg(F.sum("area").alias("area"), F.sum("size").alias("perimeter"), F.count(F.lit(1)).alias("rings"), F.count_if(F.col("area") < 0).alias("holes"), F.sum("corners").alias("corners"))


def measured(parts: DataFrame, keys: list[str], shape: str, grid: float = GRID, tolerance: float = 0.02) -> DataFrame:
    """measures() of rings(): groups of up to outlines.SMALL corners are exchanged once, whole, and worked out in numpy; larger ones go by the joins."""
    own = parts.select(*keys, F.col(shape).alias("_shape"))
    return by_size(own, keys, lambda corners, group: outlines.dissolved(outlines.grid_sides(corners, group, grid), tolerance / grid), lambda large: measures(rings(large, keys, "_shape", grid, tolerance), keys, grid), grid)


def by_size(own: DataFrame, keys: list[str], pieces, joined, grid: float) -> DataFrame:
    """measures() of the groups of (keys, _shape): by ``pieces`` of their corners in tasks, of groups with more than outlines.SMALL by ``joined``.

    Groups with a null key are left out.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    own = own.where(known)
    if any(isinstance(own.schema[k].dataType, (ArrayType, BinaryType, MapType, StructType, VariantType)) for k in keys):
        return joined(own)
    corners = F.coalesce(F.aggregate("_shape", F.lit(0).cast("bigint"), lambda n, r: n + F.greatest(F.size(r), F.lit(0))), F.lit(0).cast("bigint"))
    every = Window.partitionBy(*keys).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The window exchanges and sorts; the sort after it says what the task counts on and costs nothing.
    rows = own.withColumn("_n", F.sum(corners).over(every)).where(F.col("_n") <= outlines.SMALL).select(*keys, "_shape").sortWithinPartitions(*keys)

    def run(batches):
        for table in whole_groups(batches, keys):
            for part, group in outlines.parts(table, keys, ["_shape"]):
                groups = int(group[-1]) + 1
                p, a, b = pieces(outlines.corners_of(part.column("_shape").combine_chunks()), group)
                found, *values = outlines.measures(p, a, b, groups, grid)
                first = pa.array(np.searchsorted(group, found))
                columns = [part.column(k).take(first).combine_chunks() for k in keys]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns] if len(found) else []
                if columns:
                    yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, values)], names=[*keys, *outlines.MEASURES])

    fields = [StructField(k, own.schema[k].dataType) for k in keys]
    found = rows.mapInArrow(run, StructType([*fields, *outlines.fields().fields]))
    large = own.groupBy(*keys).agg(F.sum(corners).alias("_n")).where(F.col("_n") > outlines.SMALL).select(*keys)
    if not large.limit(1).count():
        return found
    return found.unionByName(joined(own.join(large.hint("merge"), keys, "left_semi")))


def shapes(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys and shape: the corners of rings()' points as arrays, for shapes that a row can hold; outer rings first, the largest first."""
    corner = F.when(F.col("corner"), F.struct("place", F.struct("x", "y").alias("p")))
    each = points.groupBy(*keys, "ring").agg(F.sort_array(F.collect_list(corner)).alias("c"), F.sum(_cross()).alias("twice"))
    ring = F.struct((-F.col("twice")).alias("less"), "ring", F.transform("c", lambda c: c["p"]).alias("p"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(ring)), lambda r: r["p"]).alias("shape"))
