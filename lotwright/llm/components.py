"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest node that each node can reach, where that isn't itself.

    ``edges`` has two bigint columns ``a`` and ``b``. Rounds of large-star and
    small-star alternate until nothing changes; each needs aggregations with
    map-side partial sums and equality joins (which adaptive execution splits
    where a node is hot), and is written to the shared folder. Joins are by merge:
    edges in small files would be broadcast, which the driver holds. Only a count and
    a checksum reach it. Nulls and loops are ignored. The result
    ``(node, component)`` lists the nodes that reach a smaller one.
    """
    e = edges.where(F.col("a") != F.col("b"))
    e = cut(e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    before = _state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low.hint("merge"), "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        done, e = e, cut(small.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        discard(done)
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
