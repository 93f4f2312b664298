"""Convex hulls of groups, of parts first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clipping as c
from .rounds import drop, keep

#: Points of which a hull is made at once, about.
PART = 512


def group_hulls(points: DataFrame, keys: list[str], point: str, part: int = PART, rounds: int = 20) -> DataFrame:
    """keys and hull: the convex hull of each group's points, counter-clockwise.

    Groups beyond ``part`` points are dealt out by a hash of the points, each part
    leaves its hull's corners, and so on until a group is one part or all its
    points are corners, when the row holds them anyway. Null points are left out.
    """
    left = points.select(*keys, F.struct(F.col(point)["x"].alias("x"), F.col(point)["y"].alias("y")).alias("p")).where("p.x IS NOT NULL AND p.y IS NOT NULL").distinct()
    left = keep(left)
    before = None
    for _ in range(rounds):
        sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        beyond = sizes.where(F.col("_n") > part).agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        if not beyond or before is not None and beyond > 0.9 * before:
            break
        before = beyond
        large = sizes.where(F.col("_n") > part).select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("_n") / part).alias("_parts"))
        same = None
        for k in keys:
            this = left[k].eqNullSafe(large[f"_{k}"])
            same = this if same is None else same & this
        dealt = left.join(large, same, "left").select(*keys, "p", F.coalesce(F.pmod(F.xxhash64("p"), F.col("_parts")), F.lit(0)).alias("_part"))
        corners = dealt.groupBy(*keys, "_part").agg(c.hull(F.collect_list("p")).alias("h"))
        new = keep(corners.select(*keys, F.explode("h").alias("p")))
        drop(left)
        left = new
    return left.groupBy(*keys).agg(c.hull(F.collect_list("p")).alias("hull"))
