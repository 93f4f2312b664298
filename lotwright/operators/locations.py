"""Combinations of lots, and the locations they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import dissolve, graph
from .rounds import dealt


def combinations(parcels: DataFrame, borders: DataFrame, lot_area: tuple[float, float], combo_area: tuple[float, float], most_lots: int, least_border: float, mode: str = "paths", bulk: bool = False) -> DataFrame:
    """(block, lots, area, lot_count, max_lot, min_lot): sets of adjacent lots whose total area is in range.

    parcels: (block, parcel, area); borders: (block, a, b, shared). Lots count if
    their area is strictly within ``lot_area``; they are adjacent if they share
    ``least_border``. Single lots are sets too. Sets grow in rounds over all
    blocks together, and only while their area is in range. With ``bulk``, blocks
    of up to graph.FEW such lots are listed in tasks, whole; parcels are whole numbers.
    """
    good = parcels.where((F.col("area") > lot_area[0]) & (F.col("area") < lot_area[1])).select("block", "parcel", "area")
    # Lengths come from coordinates: a micrometre less is as much.
    near = borders.where(F.col("shared") >= least_border - 1e-6).select("block", F.col("a").alias("u"), F.col("b").alias("v"))
    # A little more than the most, as sums in another order may differ in their last digits.
    most = combo_area[1] * (1 + 1e-9)
    if bulk:
        weights = good.select("block", F.col("parcel").alias("vertex"), F.col("area").alias("weight"))
        found = graph.weighed_sets(weights, near, "block", most_lots, mode, most, combo_area)
        found = found.select("block", F.col("nodes").alias("lots"), F.col("weight").alias("area"), F.col("count").alias("lot_count"), F.col("greatest").alias("max_lot"), F.col("least").alias("min_lot"))
        large = good.groupBy("block").count().where(F.col("count") > graph.FEW).select("block")
        if not large.limit(1).count():
            return found
        rest = [df.join(large.hint("merge"), "block", "left_semi") for df in (parcels, borders)]
        return found.unionByName(combinations(*rest, lot_area, combo_area, most_lots, least_border, mode))
    near = near.join(good.select("block", F.col("parcel").alias("u")), ["block", "u"], "left_semi").join(good.select("block", F.col("parcel").alias("v")), ["block", "v"], "left_semi")
    alone = good.select("block", F.array("parcel").alias("nodes"))
    weights = good.select("block", F.col("parcel").alias("vertex"), F.col("area").alias("weight"))
    sets = graph.node_sets(near, "block", most_lots, mode, weights, most).where(F.size("nodes") > 1).unionByName(alone)
    each = sets.select("block", "nodes", F.explode("nodes").alias("parcel")).join(good, ["block", "parcel"])
    out = each.groupBy("block", F.col("nodes").alias("lots")).agg(F.sum("area").alias("area"), F.count(F.lit(1)).cast("int").alias("lot_count"), F.max("area").alias("max_lot"), F.min("area").alias("min_lot"))
    return out.where(F.col("area").between(*combo_area) & (F.col("lot_count") <= most_lots))


def locations(members: DataFrame) -> DataFrame:
    """(combo, location): combos that share a lot, directly or by others, are at one location, named by its smallest lot."""
    found = graph.components(graph.combos_to_edges(members, "combo", "lot"))
    named = members.join(found, members["lot"] == found["vertex"], "left")
    return named.groupBy("combo").agg(F.min(F.coalesce("component", "lot")).alias("location"))


def spatial_locations(combos: DataFrame, key: str, shape: str, bounds) -> DataFrame:
    """(key, location): combos whose shapes meet are at one location, named by its smallest key."""
    from . import spatial_join

    left = combos.select(F.col(key).alias("u"), F.col(shape).alias("_su"), bounds.alias("_bu"))
    right = combos.select(F.col(key).alias("v"), F.col(shape).alias("_sv"), bounds.alias("_bv"))
    pairs = spatial_join.bounds_join(left, right, F.col("_bu"), F.col("_bv")).where("u < v")
    pairs = pairs.where(g.shape_distance(F.col("_su"), F.col("_sv")) <= 1e-9).select("u", "v")
    found = graph.components(pairs)
    return combos.join(found, combos[key] == found["vertex"], "left").select(combos[key], F.coalesce("component", key).alias("location"))


def regions(parts: DataFrame, keys: list[str], shape: str) -> DataFrame:
    """keys, regions, one_region, area: of how many regions the union of each group's shapes is; regions that meet in a corner count apart."""
    found = dissolve.measured(parts, keys, shape)
    count = F.col("rings") - F.col("holes")
    return found.select(*keys, count.alias("regions"), (count == 1).alias("one_region"), "area")


def location_outlines(members: DataFrame, parcels: DataFrame, lot: str = "lot", shape: str = "shape") -> DataFrame:
    """(location, shape): the outline of each location's lots; members: (location, lot), parcels: (lot, shape)."""
    own = members.select("location", "lot").distinct()
    parts = own.join(parcels.select(F.col(lot).alias("lot"), F.col(shape).alias("_shape")), "lot").select("location", F.col("_shape").alias("shape"))
    return dissolve.shapes(dissolve.rings(parts, ["location"], "shape"), ["location"])


def location_lists(members: DataFrame) -> DataFrame:
    """(location, combos): each location's combos in order."""
    return members.groupBy("location").agg(F.array_sort(F.collect_set("combo")).alias("combos"))


def location_summary(members: DataFrame) -> DataFrame:
    """Of each location: combos, the least and most lots of one, different lots."""
    sizes = members.groupBy("location", "combo").agg(F.count(F.lit(1)).alias("lots"))
    by = sizes.groupBy("location").agg(F.count(F.lit(1)).alias("combos"), F.min("lots").alias("min_lots"), F.max("lots").alias("max_lots"))
    return by.join(members.groupBy("location").agg(F.countDistinct("lot").alias("different_lots")), "location")


def combos_per_lot(members: DataFrame, tasks: int | None = None) -> DataFrame:
    """(location, lot, combos): members are exchanged once, to ``tasks`` if given."""
    return dealt(members, tasks, "location", "lot").groupBy("location", "lot").agg(F.countDistinct("combo").alias("combos"))


def with_location(results: DataFrame, found: DataFrame, on: str = "combo") -> DataFrame:
    return results.join(found.select(on, "location"), on, "left")
