"""Strategic lots: the fewest lots that every combination needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import drop, keep

#: What stands for locations without combos to choose from, without a good one, and for failures.
NO_COMBOS, NO_SOLUTION, FAILED = -333333, -222222, -999999
#: Lots in a word of bits.
BITS = 62


def _words(members: DataFrame, words: int) -> list[Column]:
    """Of grouped rows with ``place``, their places as bits."""
    bit = lambda w: F.when(F.floor(F.col("place") / BITS) == w, F.expr(f"shiftleft(1L, CAST(place % {BITS} AS INT))")).otherwise(F.lit(0).cast("bigint"))
    return [F.bit_or(bit(w)).alias(f"m{w}") for w in range(words)]


def _both(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _closed(states: DataFrame, combos: DataFrame, words: int) -> DataFrame:
    """Each state's lots and those that all combos with them have; states that no combo holds go."""
    s, m = [f"s{w}" for w in range(words)], [f"m{w}" for w in range(words)]
    met = states.join(combos, "location").where(_both(F.col(b).bitwiseAND(F.col(a)) == F.col(a) for a, b in zip(s, m, strict=True)))
    met = met.groupBy("location", *s).agg(*[F.bit_and(b).alias(b) for b in m])
    return met.select("location", *[F.col(b).alias(a) for a, b in zip(s, m, strict=True)]).distinct()


def smallest_sets(combos: DataFrame, every: DataFrame, words: int) -> DataFrame:
    """(location, s0, s1, ...): the strategic set of each location; combos (location, m0, m1, ...) are its different combos, every (location, e0, ...) its lots.

    A set that lies in a combo meets the second condition just if it is what all
    combos that hold it have in common. So sets are closed under that as they
    grow; a set that misses a combo grows by each of that combo's lots, rounds go
    on while some is smaller than the best one of its location. The set of all
    lots always fits.
    """
    s = [f"s{w}" for w in range(words)]
    size = reduce(lambda a, b: a + b, [F.bit_count(c) for c in s])
    order = F.struct(size.alias("size"), *[F.col(c) for c in reversed(s)])
    nothing = combos.select("location").distinct().select("location", *[F.lit(0).cast("bigint").alias(c) for c in s])
    best = keep(every.join(combos.select("location").distinct(), "location").select("location", *[F.col(f"e{w}").alias(f"s{w}") for w in range(words)]).select("location", order.alias("best")))
    wave = keep(_closed(nothing, combos, words))
    while wave.limit(1).count():
        hits = reduce(lambda a, b: a | b, [F.col(f"m{w}").bitwiseAND(F.col(f"s{w}")) != 0 for w in range(words)])
        lots_of = reduce(lambda a, b: a + b, [F.bit_count(f"m{w}") for w in range(words)])
        missed = F.min(F.when(~hits, F.struct(lots_of.alias("n"), *[F.col(f"m{w}") for w in range(words)]))).alias("missed")
        seen = keep(wave.join(combos, "location").groupBy("location", *s).agg(missed))
        done = seen.where("missed IS NULL").select("location", order.alias("best"))
        new = keep(best.unionByName(done).groupBy("location").agg(F.min("best").alias("best")))
        drop(best)
        best = new
        open_ = seen.where("missed IS NOT NULL").join(best, "location").where(size < F.col("best.size"))
        each = [open_.withColumn("_k", F.explode(F.expr(f"filter(sequence(0, {BITS - 1}), k -> getbit(missed.m{w}, k) = 1)"))).withColumn(c, F.col(c).bitwiseOR(F.expr("shiftleft(1L, _k)"))).select("location", *s) for w, c in enumerate(s)]
        new = keep(_closed(reduce(DataFrame.unionByName, each).distinct(), combos, words))
        drop(wave, seen)
        wave = new
    drop(wave)
    return best.select("location", *[F.col(f"best.{c}").alias(c) for c in s])


def strategic_lots(members: DataFrame) -> DataFrame:
    """(location, lots) from (location, combo, lot, sign): combos with a positive sign and a lot count.

    Lots are those of all a location's combos. A location whose combos have no
    lot and no positive sign gets [NO_COMBOS], one with lots but without a combo
    that counts [NO_SOLUTION], one with positive signs but without lots an empty
    list. A combo without lots is a row whose lot is null; null signs are not
    positive. Locations may have any number of lots; null locations are left out.
    """
    own = members.select(F.col("location").cast("bigint").alias("location"), "combo", F.col("lot").cast("bigint").alias("lot"), (F.coalesce("sign", F.lit(0)) >= 1).alias("good")).where("location IS NOT NULL").distinct()
    own = keep(own)
    places = own.where("lot IS NOT NULL").select("location", "lot").distinct()
    places = keep(places.withColumn("place", F.row_number().over(Window.partitionBy("location").orderBy("lot")) - 1))
    words = (places.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]) // BITS + 1
    chosen = own.where("good AND lot IS NOT NULL").join(places, ["location", "lot"])
    combos = keep(chosen.groupBy("location", "combo").agg(*_words(chosen, words)).drop("combo").distinct())
    every = places.groupBy("location").agg(*[c.alias(f"e{w}") for w, c in enumerate(_words(places, words))])
    found = keep(smallest_sets(combos, every, words))
    held = reduce(lambda a, b: a | b, [(F.floor(F.col("place") / BITS) == w) & (F.expr(f"getbit(s{w}, CAST(place % {BITS} AS INT))") == 1) for w in range(words)])
    listed = places.join(found, "location").where(held).groupBy("location").agg(F.array_sort(F.collect_list("lot")).alias("lots"))
    kind = own.groupBy("location").agg(F.max(F.col("lot").isNotNull()).alias("_lots"), F.max("good").alias("_good"))
    out = kind.join(listed, "location", "left")
    told = F.when(F.col("lots").isNotNull(), F.col("lots")).when(F.col("_lots"), F.array(F.lit(NO_SOLUTION).cast("bigint"))).when(F.col("_good"), F.slice(F.array(F.lit(0).cast("bigint")), 1, 0))
    out = keep(out.select("location", told.otherwise(F.array(F.lit(NO_COMBOS).cast("bigint"))).alias("lots")))
    drop(own, places, combos, found)
    return out
