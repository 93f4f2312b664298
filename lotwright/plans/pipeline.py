"""The land-assembly stages, each a function from DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import borders, capacity, economics, locations, lots, pricing, relational
from ..sources import export, tables


def combine(parcels: DataFrame, lot_area=(400.0, 3000.0), combo_area=(1200.0, 4000.0), most_lots: int = 11, least_border: float = 18.0) -> DataFrame:
    """Combos of (block, parcel, area, shape): shared borders, then sets of adjacent lots, numbered by a hash of their lots."""
    shared = borders.shared_borders(parcels, "parcel", "block", "shape")
    found = locations.combinations(parcels, shared, lot_area, combo_area, most_lots, least_border)
    return found.withColumn("combo", F.xxhash64("lots")).withColumn("status", F.lit(capacity.PENDING))


def volume(combos: DataFrame, **options) -> DataFrame:
    """The volumetric run over pending combos: a result and a status for each."""
    pending = combos.where(F.col("status") == capacity.PENDING) if "status" in combos.columns else combos
    return capacity.best_building(pending, **options)


def economic(results: DataFrame, projects: DataFrame, types: dict) -> DataFrame:
    """The economic run over combos with a building: price, and status 3 or 39."""
    done = projects.join(results.where(F.col("status").isin(capacity.DONE, capacity.PROVISIONAL)).select("key"), "key", "left_semi")
    priced = economics.best_prices(done, "key", types)
    return priced.withColumn("status", F.when("feasible", capacity.ECONOMIC).otherwise(capacity.ECONOMIC_ERROR))


#: What a run makes of a combo: the status that it looks for, and the next one by the outcome's name.
RUNS = {
    "volumetric": (capacity.PENDING, {"done": capacity.DONE, "error": capacity.ERROR, "infeasible": capacity.INFEASIBLE, "low": capacity.LOW}),
    "provisional": (capacity.DONE, {"done": capacity.PROVISIONAL, "error": capacity.PROVISIONAL_ERROR}),
    "economic": (capacity.PROVISIONAL, {"done": capacity.ECONOMIC, "error": capacity.ECONOMIC_ERROR}),
}


def settle(spark, path: str, parts: list[str], run: str, outcomes: DataFrame) -> int:
    """Moves the combos of a table of (combo, status, ...) on by the outcomes (combo, outcome) of a run; the partitions written.

    Only combos in the status that the run looks for move; those without an
    outcome, or with one that the run doesn't have, stay. Partitions without
    a combo in that status are not touched.
    """
    since, then = RUNS[run]
    told = outcomes.where(F.col("outcome").isin(*then)).groupBy("combo").agg(F.min("outcome").alias("_outcome"))
    to = F.create_map(*[F.lit(v) for pair in then.items() for v in pair])

    def change(rows: DataFrame) -> DataFrame:
        met = rows.join(told, "combo", "left")
        on = (F.col("status") == since) & F.col("_outcome").isNotNull()
        return met.withColumn("status", F.when(on, to[F.col("_outcome")]).otherwise(F.col("status"))).drop("_outcome")

    return tables.modify_partitions(spark, path, parts, change, F.col("status") == since)


def reset(spark, path: str, parts: list[str]) -> int:
    """All combos pending again; partitions where they are already stay as they are."""
    return tables.modify_partitions(spark, path, parts, lambda rows: rows.withColumn("status", F.lit(capacity.PENDING).cast(rows.schema["status"].dataType)), F.col("status") != capacity.PENDING)


def locate(members: DataFrame) -> DataFrame:
    """members (combo, lot) with their location."""
    return members.join(locations.locations(members), "combo")


def compare(members: DataFrame, costs: DataFrame, prices: DataFrame) -> DataFrame:
    """(combo, location, cost, market, gap, gap_pct); members: (location, combo, lot); prices: (lot, price)."""
    priced = members.join(prices, "lot", "left")
    market = relational.market_value(priced, "combo", "lot", "price")
    known = members.select("combo", "location").distinct()
    return relational.gap(known.join(costs, "combo").join(market, "combo"))


def summarise(compared: DataFrame) -> DataFrame:
    return relational.best_per_group(compared.where(F.col("gap").isNotNull()), "location", "gap", "combo", ["gap_pct"])


def choose(members: DataFrame, compared: DataFrame) -> DataFrame:
    """Strategic lots of each location."""
    signed = compared.select("combo", F.coalesce(F.signum("gap"), F.lit(0.0)).cast("int").alias("sign"))
    return lots.strategic_lots(members.join(signed, "combo"))


def bid(members: DataFrame, compared: DataFrame, least_gap: float = 0.0) -> DataFrame:
    """Bids of each location's combos with a gap of ``least_gap`` or more; members also have market and area."""
    good = compared.where(F.col("gap") >= least_gap).select("combo", F.col("cost").alias("combo_value"))
    return pricing.optimal_bids(members.join(good, "combo"))


def publish(buildings: DataFrame) -> DataFrame:
    """One GeoJSON text for each building of (key, floors, height, base, first, gap)."""
    features = export.building_features(buildings, "key", "floors", "height", "base", "first", "gap")
    return export.feature_collection(features, "key", "feature", ["floor", "part"])
