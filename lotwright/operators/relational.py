"""Candidate selection, list columns, lookups and aggregates over parcels and their bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

#: Parcels fit for high-rise: fewest floors, least density, registered owners.
MIN_FLOORS, MIN_DENSITY, OWNERS = 3, 200, 1
#: What an unlimited height or number of floors (-1) stands for.
UNLIMITED_HEIGHT, UNLIMITED_FLOORS = 100.0, 30.0


def highrise(parcels: DataFrame, floors="floors", density="density", owners="owners", built="built", land="land") -> DataFrame:
    return parcels.where((F.col(floors) >= MIN_FLOORS) & (F.col(density) >= MIN_DENSITY) & (F.col(owners) == OWNERS) & (F.col(built) < F.col(land)))


def like_any(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose upper-case ``column`` is like one of the patterns."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.upper(column).like(p)
    return df.where(found)


def not_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose ``column`` is none of the values; null ones are left out, as SQL has it."""
    return df.where(~F.col(column).isin(values))


def where_exists(df: DataFrame, probe: DataFrame) -> DataFrame:
    """``df`` if ``probe`` has a row, else nothing. The probe ends at its first row."""
    one = probe.limit(1).select(F.lit(1).alias("_one"))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one", "left_semi").drop("_one")


def status_queue(df: DataFrame, status: int, order: str = "id") -> DataFrame:
    return df.where(F.col("status") == status).orderBy(order)


def area_band(df: DataFrame, column: str, low: float, high: float, inclusive: bool = False) -> DataFrame:
    """Strictly between for lots, inclusive for combinations."""
    c = F.col(column)
    return df.where((c >= low) & (c <= high) if inclusive else (c > low) & (c < high))


def anti_join_chain(df: DataFrame, key: str, *others: tuple[DataFrame, str]) -> DataFrame:
    """Rows of ``df`` whose key none of the others has; keys are not null in any of them."""
    for other, column in others:
        found = other.select(F.col(column).alias(key)).where(F.col(key).isNotNull())
        df = df.join(found, key, "left_anti")
    return df


def set_where_found(df: DataFrame, key: str, other: DataFrame, column: str, old, new) -> DataFrame:
    """``column`` becomes ``new`` where it is ``old`` and ``other`` has the key."""
    found = other.select(F.col(key)).distinct().withColumn("_found", F.lit(True))
    own = df.join(found, key, "left")
    value = F.when(F.col("_found") & (F.col(column) == old), F.lit(new)).otherwise(F.col(column))
    return own.withColumn(column, value).drop("_found")


def rekey(results: DataFrame, combos: DataFrame, on: str, key: str) -> DataFrame:
    """``results`` with the key that ``combos`` gives their ``on``; the own one where it gives none."""
    new = combos.groupBy(on).agg(F.min(key).alias("_new"))
    return results.join(new, on, "left").withColumn(key, F.coalesce("_new", key)).drop("_new")


def lookup_first(df: DataFrame, key: str, dimension: DataFrame, value: str, order: str) -> DataFrame:
    """``df`` with the value of the dimension's first row of its key; rows without one go."""
    first = dimension.groupBy(key).agg(F.min_by(value, order).alias(value))
    return df.join(first, key)


def weighted_zoning(parcels: DataFrame, bundle: str, area: str, means: list[str], height: str, floors: str, slope_degrees: str) -> DataFrame:
    """One row a bundle: its area, land-weighted means of zoning limits, and the tangent of its least slope.

    -1 stands for no limit in heights and floors. All in one aggregation.
    """
    limit = lambda c, v: F.when(F.col(c) == -1, v).otherwise(F.col(c).cast("double"))
    mean = lambda c: F.sum(c * F.col(area)) / F.sum(area)
    return parcels.groupBy(bundle).agg(
        F.sum(area).alias("area"),
        *[mean(F.col(c)).alias(c) for c in means],
        mean(limit(height, UNLIMITED_HEIGHT)).alias(height),
        mean(limit(floors, UNLIMITED_FLOORS)).alias(floors),
        F.tan(F.radians(F.min(slope_degrees))).alias("slope"),
    )


def gap(df: DataFrame, cost: str = "cost", market: str = "market") -> DataFrame:
    """``gap`` and ``gap_pct``; both null where there is no market value to compare with."""
    known = F.col(market).isNotNull() & (F.col(market) != 0)
    own = F.when(known, F.col(cost) - F.col(market))
    return df.withColumn("gap", own).withColumn("gap_pct", own / F.col(market))


def market_value(members: DataFrame, combo: str, place: str, price: str, stop_at_missing: bool = False) -> DataFrame:
    """The sum of lot prices of each combo, missing ones 0.

    ``stop_at_missing``: lots after the first one without a price don't count.
    """
    if not stop_at_missing:
        return members.groupBy(combo).agg(F.sum(F.coalesce(price, F.lit(0.0))).alias("market"))
    lots = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(price).alias("price"))))
    going = F.struct(F.lit(0.0).alias("sum"), F.lit(True).alias("on"))
    add = lambda a, x: F.struct((a["sum"] + F.when(a["on"], F.coalesce(x["price"], F.lit(0.0))).otherwise(0.0)).alias("sum"), (a["on"] & x["price"].isNotNull()).alias("on"))
    return members.groupBy(combo).agg(F.aggregate(lots, going, add, lambda a: a["sum"]).alias("market"))


def best_per_group(df: DataFrame, group: str, value: str, key: str, extra: list[str] = ()) -> DataFrame:
    """The row of the greatest value of each group, ties to the smallest key, and the ordered signs of all."""
    best = F.max_by(F.struct(key, value, *extra), F.struct(F.col(value), -F.col(key)))
    signs = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), F.signum(value).cast("int").alias("s")))), lambda x: x["s"])
    out = df.groupBy(group).agg(best.alias("_best"), signs.alias("signs"))
    return out.select(group, "_best.*", "signs")


def every_kth(df: DataFrame, group: str | None, order: Column | list[Column], k: int) -> DataFrame:
    """The k-th, 2k-th, ... row of each group by ``order``; without a group, of the whole table."""
    orders = order if isinstance(order, list) else [order]
    if group:
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*orders)))
    else:
        ranked = numbered(df, orders, "rank")
    return ranked.where(F.col("rank") % k == 0)


def first_tries(df: DataFrame, group: str, order: list[Column], tries: int = 2) -> DataFrame:
    """The best ``tries`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= tries)


def wide_to_list(df: DataFrame, columns: list[str], missing: str = "NA") -> Column:
    """The columns' values as one list, without ``missing`` and nulls."""
    return F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != missing))


def decode_list(text: str) -> Column:
    return F.from_json(text, "array<bigint>")


def encode_list(values: str) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def distinct_combos(df: DataFrame, lots: str, order: str) -> DataFrame:
    """One row for each set of lots, that of the smallest ``order``."""
    key = F.array_sort(F.array_distinct(lots))
    return df.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def lot_values(members: DataFrame, lot: str, area: str, combo_value: str, combo_area: str) -> DataFrame:
    """Each lot's area times the value of its combos by their area; members: a row for each lot of each combo."""
    by = members.groupBy(lot).agg(F.sum(combo_value).alias("_v"), F.sum(combo_area).alias("_a"), F.max(area).alias("lot_area"))
    return by.select(lot, (F.col("_v") / F.col("_a") * F.col("lot_area")).alias("lot_value"))
