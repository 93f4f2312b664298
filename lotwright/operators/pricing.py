"""Bids for lots and prices of combinations by expected utility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import let
from . import graph, numbering
from .rounds import dealt, keep


BIDS = "location bigint, utility double, start_utility double, lots array<bigint>, bids array<double>, combos array<bigint>, prices array<double>"


def _part_utility(x: Column, lots: Column, combos: Column) -> Column:
    """Of one part: bids ``x`` of its lots, and combos with the places of their lots and what they are worth when bought."""
    p = lambda k: (F.get(x, k) - F.get(lots, k)["low"]) / (F.get(lots, k)["high"] - F.get(lots, k)["low"])
    places = F.sequence(F.lit(0), F.size(lots) - 1)

    def one(c: Column) -> Column:
        paid = F.aggregate(c["of"], F.lit(0.0), lambda s, k: s + F.get(x, k))
        likely = F.aggregate(places, F.lit(1.0), lambda s, k: s * F.when(F.array_contains(c["of"], k), p(k)).otherwise(1 - p(k)))
        return (c["worth"] - paid) * likely

    return F.aggregate(combos, F.lit(0.0), lambda s, c: s + one(c))


def _best_bid(x: Column, j: Column, lots: Column, combos: Column) -> Column:
    """The bid for lot ``j`` that is best beside the others: utility is a quadratic in it, whose top has a closed form."""
    p = lambda k: (F.get(x, k) - F.get(lots, k)["low"]) / (F.get(lots, k)["high"] - F.get(lots, k)["low"])
    places = F.filter(F.sequence(F.lit(0), F.size(lots) - 1), lambda k: k != j)

    def one(c: Column) -> Column:
        paid = F.aggregate(F.filter(c["of"], lambda k: k != j), F.lit(0.0), lambda s, k: s + F.get(x, k))
        likely = F.aggregate(places, F.lit(1.0), lambda s, k: s * F.when(F.array_contains(c["of"], k), p(k)).otherwise(1 - p(k)))
        return F.struct(likely.alias("q"), (likely * (c["worth"] - paid)).alias("v"), F.array_contains(c["of"], j).alias("own"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("d"))
    add = lambda s, t: F.struct((s["a"] + F.when(t["own"], t["v"]).otherwise(0.0)).alias("a"), (s["b"] + F.when(t["own"], t["q"]).otherwise(0.0)).alias("b"), (s["d"] + F.when(t["own"], 0.0).otherwise(t["v"])).alias("d"))
    lot = F.get(lots, j)
    top = lambda s: (s["a"] - s["d"] + s["b"] * lot["low"]) / (s["b"] * 2)
    return let(F.aggregate(F.transform(combos, one), zero, add), lambda s: F.when(s["b"] > 0, F.greatest(lot["least"], F.least(lot["most"], top(s)))).otherwise(F.get(x, j)))


def optimal_bids(members: DataFrame, d_lots: float = 0.1, d_combos: float = 0.2, d_opt_lots: float = 0.0, d_opt_combos: float = 0.2, sweeps: int = 40) -> DataFrame:
    """BIDS for each location, from (location, combo, lot, market, area, combo_value).

    A combo's price is best at a value that no bid changes. Bids go from the
    middle of their ranges, one after another, to what is best beside the others,
    ``sweeps`` times. Parts that no combo ties together are rows of their own;
    the lots and combos of a part are arrays in its row.
    """
    members = members.select("location", "combo", F.col("lot").cast("bigint").alias("lot"), "market", "area", "combo_value")
    lots, combos = price_limits(members, ["location"], d_lots, d_combos)
    own = with_parts(members, ["location"]).select("location", "part", "combo", "lot").distinct()
    middle = (F.col("low") + F.col("high")) / 2
    box = [F.col("market") * (1 - d_opt_lots), F.col("value") * (1 + d_opt_lots)]
    lot = F.struct("lot", "low", "high", "market", F.least(box[0], middle).alias("least"), F.greatest(box[1], middle).alias("most"), middle.alias("start"))
    lots = own.select("location", "part", "lot").distinct().join(lots, ["location", "lot"]).groupBy("location", "part").agg(F.sort_array(F.collect_list(lot)).alias("lots"))
    met = own.join(members.select("location", "lot", "market").distinct(), ["location", "lot"]).groupBy("location", "part", "combo").agg(F.sort_array(F.collect_set("lot")).alias("names"), F.sum("market").alias("sum"))
    met = met.join(combos, ["location", "combo"])
    price = F.greatest(F.least(F.col("value") * (1 - d_opt_combos), middle), F.least(F.greatest(F.col("value") * (1 + d_opt_combos), middle), (F.col("high") + F.col("sum")) / 2))
    sold = lambda c: (F.col("high") - c) / (F.col("high") - F.col("low"))
    worth = lambda c: c * sold(c) + F.col("sum") * (1 - sold(c))
    combo = F.struct(F.col("combo").cast("bigint").alias("combo"), "names", price.alias("price"), worth(price).alias("worth"), worth(middle).alias("first"))
    parts = met.groupBy("location", "part").agg(F.sort_array(F.collect_list(combo)).alias("combos")).join(lots, ["location", "part"])
    placed = lambda worth: F.transform("combos", lambda c: F.struct(F.transform(c["names"], lambda n: (F.array_position(F.transform("lots", lambda x: x["lot"]), n) - 1).cast("int")).alias("of"), c[worth].alias("worth")))
    parts = parts.withColumn("best", placed("worth")).withColumn("first", placed("first")).withColumn("start", F.transform("lots", lambda x: x["start"]))
    turn = lambda x, t: let(F.pmod(t, F.size("lots")), lambda j: let(_best_bid(x, j, F.col("lots"), F.col("best")), lambda v: F.transform(x, lambda y, k: F.when(k == j, v).otherwise(y))))
    parts = parts.withColumn("x", F.aggregate(F.sequence(F.lit(0), F.size("lots") * sweeps - 1), F.col("start"), turn))
    parts = parts.select("location", "lots", "x", "combos", _part_utility(F.col("x"), F.col("lots"), F.col("best")).alias("utility"), _part_utility(F.col("start"), F.col("lots"), F.col("first")).alias("start_utility"))
    pairs = F.zip_with("lots", "x", lambda a, b: F.struct(a["lot"].alias("lot"), b.alias("bid")))
    found = parts.groupBy(F.col("location").cast("bigint").alias("location")).agg(F.sum("utility").alias("utility"), F.sum("start_utility").alias("start_utility"), F.array_sort(F.flatten(F.collect_list(pairs))).alias("l"), F.array_sort(F.flatten(F.collect_list(F.transform("combos", lambda c: F.struct(c["combo"].alias("combo"), c["price"].alias("price")))))).alias("c"))
    return found.select("location", "utility", "start_utility", F.transform("l", lambda v: v["lot"]).alias("lots"), F.transform("l", lambda v: v["bid"]).alias("bids"), F.transform("c", lambda v: v["combo"]).alias("combos"), F.transform("c", lambda v: v["price"]).alias("prices"))


MARGINAL = "location bigint, lot bigint, value double"


def marginal_values(members: DataFrame, **options) -> DataFrame:
    """MARGINAL for each lot of each location: the best utility less that without the lot and its combos; members as for optimal_bids.

    As in marginal_utilities() every lot makes a copy of its location's other combos.
    """
    whole = optimal_bids(members, **options).select("location", "utility")
    lots = keep(numbering.numbered(members.select("location", F.col("lot").alias("without")).distinct(), ["location", "without"], "_case"))
    holding = members.select("location", F.col("lot").alias("without"), "combo").distinct()
    rest = lots.join(members, "location").join(holding, ["location", "without", "combo"], "left_anti")
    left = optimal_bids(rest.drop("location", "without").withColumnRenamed("_case", "location"), **options).select(F.col("location").alias("_case"), F.col("utility").alias("_left"))
    found = lots.join(whole, "location").join(left, "_case", "left")
    return found.select(F.col("location").cast("bigint").alias("location"), F.col("without").cast("bigint").alias("lot"), (F.col("utility") - F.coalesce("_left", F.lit(0.0))).alias("value"))


def purchase_probability(members: DataFrame, lots: DataFrame, tasks: int | None = None) -> DataFrame:
    """(location, combo, probability) that exactly its lots are bought.

    members: (location, combo, lot); lots: (location, lot, p). The product of a
    location's probabilities of no purchase is taken once, certain purchases
    apart; a combo's own lots then replace theirs, so the work is linear in lots
    and members. Rows are exchanged to ``tasks`` if given.
    """
    rest, certain = F.when(F.col("p") < 1, 1 - F.col("p")).otherwise(1.0), (F.col("p") >= 1).cast("int")
    every = dealt(lots, tasks, "location").groupBy("location").agg(F.product(rest).alias("_rest"), F.sum(certain).alias("_certain"))
    own = dealt(members.select("location", "combo", "lot"), tasks, "location", "lot").distinct().join(dealt(lots, tasks, "location", "lot"), ["location", "lot"])
    own = dealt(own, tasks, "location").groupBy("location", "combo").agg(F.product("p").alias("_bought"), F.product(rest).alias("_own_rest"), F.sum(certain).alias("_own_certain"))
    met = own.join(every, "location")
    return met.select("location", "combo", F.when(F.col("_certain") > F.col("_own_certain"), 0.0).otherwise(F.col("_bought") * F.col("_rest") / F.col("_own_rest")).alias("probability"))


def with_parts(members: DataFrame, keys: list[str]) -> DataFrame:
    """``members`` with their connected part as ``part``: lots that combos tie together, within each of the keys."""
    lots = numbering.numbered(members.select(*keys, "lot").distinct(), [*keys, "lot"], "_id", 0)
    own = members.join(lots, [*keys, "lot"]).withColumn("_combo", F.struct(*keys, "combo"))
    found = graph.components(graph.combos_to_edges(own.select("_combo", "_id").distinct(), "_combo", "_id"))
    return own.join(found, own["_id"] == found["vertex"], "left").withColumn("part", F.coalesce("component", "_id")).drop("_combo", "_id", "vertex", "component")


def price_limits(members: DataFrame, keys: list[str], d_lots: float = 0.1, d_combos: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(keys, lot, market, value, low, high) and (keys, combo, value, low, high): bounds() as Columns."""
    size = members.groupBy(*keys, "combo").agg(F.sum("area").alias("_size"))
    own = members.join(size, [*keys, "combo"]).groupBy(*keys, "lot").agg(F.max("market").alias("market"), (F.sum("combo_value") / F.sum("_size") * F.max("area")).alias("_value"))
    lots = own.select(*keys, "lot", "market", F.col("_value").alias("value"), (F.least("market", "_value") * (1 - d_lots)).alias("low"), (F.greatest("market", "_value") * (1 + d_lots)).alias("high"))
    value = F.col("combo_value")
    combos = members.select(*keys, "combo", "combo_value").distinct().select(*keys, "combo", value.alias("value"), (value * (1 - d_combos)).alias("low"), (value * (1 + d_combos)).alias("high"))
    return lots, combos


def utilities(members: DataFrame, keys: list[str], bids: DataFrame | None = None, prices: DataFrame | None = None, **deltas) -> DataFrame:
    """keys and utility: what the bids (keys, lot, price) and the combos' prices (keys, combo, price) are expected to earn.

    Without them both are in the middle of their ranges. Parts that no combo ties
    together are bought apart, and their utilities added; members has keys, combo,
    lot, market, area and combo_value, a row for each lot of each combo.
    """
    lots, combos = price_limits(members, keys, **deltas)
    middle = (F.col("low") + F.col("high")) / 2
    lots = lots.withColumn("price", middle) if bids is None else lots.join(bids, [*keys, "lot"])
    combos = combos.withColumn("price", middle) if prices is None else combos.join(prices, [*keys, "combo"])
    own = with_parts(members, keys).select(*keys, "part", "combo", "lot").distinct()
    lots = own.select(*keys, "part", "lot").distinct().join(lots.withColumn("p", (F.col("price") - F.col("low")) / (F.col("high") - F.col("low"))), [*keys, "lot"])
    # A combo of the same name in two keys is in two parts, so parts tell them apart.
    likely = purchase_probability(own.select(F.col("part").alias("location"), "combo", "lot"), lots.select(F.col("part").alias("location"), "lot", "p")).withColumnRenamed("location", "part")
    paid = own.join(lots.select(*keys, "lot", "market", F.col("price").alias("_paid")), [*keys, "lot"]).groupBy(*keys, "part", "combo").agg(F.sum("_paid").alias("_paid"), F.sum("market").alias("_market"))
    sold = (F.col("high") - F.col("price")) / (F.col("high") - F.col("low"))
    gain = (F.col("price") - F.col("_paid")) * sold + (F.col("_market") - F.col("_paid")) * (1 - sold)
    met = paid.join(combos, [*keys, "combo"]).join(likely, ["part", "combo"])
    return met.groupBy(*keys).agg(F.sum(gain * F.col("probability")).alias("utility"))


def marginal_utilities(members: DataFrame, **deltas) -> DataFrame:
    """(location, lot, value): the utility in the middle of the ranges of all lots, less that without one lot and its combos.

    Every lot of a location makes a copy of the location's other combos: rows
    grow with a location's lots times its members. Ranges are taken anew from
    what is left; where nothing is left the utility is 0.
    """
    whole = utilities(members, ["location"], **deltas)
    lots = members.select("location", F.col("lot").alias("without")).distinct()
    holding = members.select("location", F.col("lot").alias("without"), "combo").distinct()
    rest = lots.join(members, "location").join(holding, ["location", "without", "combo"], "left_anti")
    left = utilities(rest, ["location", "without"], **deltas).withColumnRenamed("utility", "_left")
    found = lots.join(whole, "location").join(left, ["location", "without"], "left")
    return found.select("location", F.col("without").alias("lot"), (F.col("utility") - F.coalesce("_left", F.lit(0.0))).alias("value"))
