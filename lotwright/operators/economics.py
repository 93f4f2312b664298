"""The greatest price of land that a building's sales can pay.

For a mix of units every cost but the land's is known, and the required return
is linear in the price: the best price of a mix has a closed form. Mixes are
counted per floor, every allowed one is a row, so the optimum is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rounds import spread

#: Default unit costs, in the currency unit UF.
UNIT_COSTS = {
    "duration": 24.0,
    "land": 40.0,
    "commission": 0.02,
    "demolition": 0.6,
    "other_land": 0.003,
    "slab_above": 21.0,
    "slab_below": 13.0,
    "inspection": 100.0,
    "construction_vat": 0.19,
    "vat_credit": 0.065,
    "architecture": 0.4,
    "structure": 0.145,
    "soil": 0.0020,
    "topography": 0.0080,
    "specialties": 0.31,
    "connections": 50.0,
    "urban_contribution": 0.0,
    "road_mitigation": 0.0,
    "permits": 0.0,
    "marketing": 0.025,
    "sales_room": 1000.0,
    "management": 0.05,
    "accounting": 12.0,
    "legal": 0.004,
    "insurance": 0.0,
    "after_sales": 0.02,
    "presale_insurance": 0.001,
    "other_sales": 0.001,
    "financing": 0.034,
    "contingency": 0.03,
}
#: A table of unit costs, a row for each.
COSTS = "name string, value double"
VAT = 0.19
SPREAD, LARGE_UNIT = 2.5, 140.0
_PER_SALE = ("marketing", "management", "legal", "after_sales", "insurance", "presale_insurance", "other_sales", "contingency")


def cost_table(spark: SparkSession, changed: dict[str, float]) -> DataFrame:
    """COSTS with the default unit costs, some of them changed."""
    return spark.createDataFrame([(k, float(v)) for k, v in (UNIT_COSTS | changed).items()], COSTS)


def cost_row(table: DataFrame) -> DataFrame:
    """One row with a struct ``costs``: the greatest value of each known name in COSTS, the default where there is none."""
    value = lambda k: F.coalesce(F.max(F.when(F.col("name") == k, F.col("value"))), F.lit(UNIT_COSTS[k])).alias(k)
    return table.agg(F.struct(*[value(k) for k in UNIT_COSTS]).alias("costs"))


def with_costs(projects: DataFrame, row: DataFrame) -> DataFrame:
    """``projects`` with the one row of cost_row()."""
    one = row.withColumn("_one", F.lit(1))
    return projects.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def price_of_mix(sales: Column, rest: Column, land: Column, required: float, costs: dict | None = None) -> Column:
    """The closed form as a Column."""
    c = UNIT_COSTS | (costs or {})
    return (sales / required - rest) / (land * (1 - VAT + c["commission"] + c["other_land"]))


def parking_spaces(units_parking: Column, visitor_share: float = 0.15, bikes: float = 0.5, per_space: float = 3.0) -> Column:
    """The spaces to sell: one for each unit's need, or the normal ones less the bicycles' discount and the visitors'."""
    normal = units_parking * (1 + visitor_share)
    return F.greatest(units_parking, normal - normal * bikes / per_space - units_parking * visitor_share)


def disabled_spaces(dwellings: Column) -> Column:
    """Parking spaces for disabled people among so many dwellings; the steps are fixed values."""
    steps = ((20, 1), (50, 2), (200, 3), (400, 4), (500, 5))
    found = F.when(dwellings <= steps[0][0], float(steps[0][1]))
    for most, spaces in steps[1:]:
        found = found.when(dwellings <= most, float(spaces))
    return found.otherwise(dwellings * 0.01)


def mixes(projects: DataFrame, types: dict[str, list[float]]) -> DataFrame:
    """``projects`` (land, base, max_coverage, floors, max_units, common_share, return, far) once for each allowed mix, its units of a floor as c0, c1, ...

    One kind of unit after another: counts go up to what is left of the slab and
    of the allowed units, so most of what doesn't fit never becomes a row.
    """
    n = len(types["util"])
    each = projects.withColumn("_factor", F.col("floors") - 1).where("_factor >= 1")
    above = F.col("base") * F.col("_factor") + F.least("base", "max_coverage")
    each = each.withColumn("_area", above).withColumn("_units", F.col("max_units").cast("double")).withColumn("_least", F.lit(None).cast("double")).withColumn("_greatest", F.lit(None).cast("double"))
    for k in range(n):
        util = float(types["util"][k])
        need = (F.col("common_share") * util + (types["terrace"][k] + types["interior"][k])) * F.col("_factor")
        most = F.least(F.floor((F.col("_area") + 1e-9) / need), F.floor((F.col("_units") + 1e-9) / F.col("_factor")))
        fits = F.coalesce(F.greatest("_greatest", F.lit(util)) <= F.least("_least", F.lit(util)) * SPREAD + 1e-9, F.lit(True))
        if util >= LARGE_UNIT:
            fits = fits & (F.col("far") > 0)
        each = each.withColumn(f"c{k}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(fits & (most > 0), most).otherwise(0))))
        used = F.col(f"c{k}") > 0
        each = each.withColumn("_area", F.col("_area") - need * F.col(f"c{k}")).withColumn("_units", F.col("_units") - F.col("_factor") * F.col(f"c{k}"))
        each = each.withColumn("_least", F.when(used, F.least("_least", F.lit(util))).otherwise(F.col("_least"))).withColumn("_greatest", F.when(used, F.greatest("_greatest", F.lit(util))).otherwise(F.col("_greatest")))
    return each.drop("_area", "_units", "_least", "_greatest")


def priced_mixes(each: DataFrame, types: dict[str, list[float]], costs: dict | None = None) -> DataFrame:
    """mixes() with util, common, parking, sales, and the price that is best for each."""
    c = UNIT_COSTS | (costs or {})
    counts = [F.col(f"c{k}") for k in range(len(types["util"]))]
    total = lambda name: sum((n * float(v) for n, v in zip(counts[1:], types[name][1:], strict=True)), counts[0] * float(types[name][0])) * F.col("_factor")
    above = F.col("base") * F.col("_factor") + F.least("base", "max_coverage")
    each = each.withColumn("_above", above).withColumn("parking", parking_spaces(total("parking"))).withColumn("util", total("util")).withColumn("sales", total("price"))
    each = each.withColumn("common", F.col("_above") - total("terrace") - total("interior")).withColumn("_below", F.col("parking") * 30.0 + total("storage") * 5.0)
    units = sum(counts[1:], counts[0]) * F.col("_factor")
    build = F.col("_above") * c["slab_above"] + F.col("_below") * c["slab_below"] + c["inspection"] * c["duration"]
    rest = (
        F.col("land") * (c["demolition"] + c["soil"] + c["topography"])
        + build * (1 + c["financing"])
        + F.col("util") * c["architecture"]
        + (F.col("_above") + F.col("_below")) * (c["structure"] + c["specialties"])
        + units * c["connections"]
        + F.col("sales") * (sum(c[n] for n in _PER_SALE) + VAT / (1 + VAT))
        + (c["permits"] + c["sales_room"] + c["accounting"] * c["duration"])
    )
    price = (F.col("sales") / F.col("return") - rest) / (F.col("land") * (1 - VAT + c["commission"] + c["other_land"]))
    return each.withColumn("price", price).drop("_above", "_below")


RESULT = "key bigint, feasible boolean, price double, sales double, util double, common double, parking double, per_floor array<int>, mix array<int>"


def best_prices(projects: DataFrame, key: str, types: dict[str, list[float]], costs: dict | None = None) -> DataFrame:
    """RESULT for each row of ``projects`` (land, base, max_coverage, floors, max_units, common_share, return, far).

    All allowed mixes are rows, and the best of each project is taken on the way
    to one; ties go to the smaller counts, first kind first. Projects without a
    mix of a price of 0 or more are not feasible. Projects that differ in their
    key alone are worked out once: the mixes of all would be sorted for their best.
    """
    names = ["land", "base", "max_coverage", "floors", "max_units", "common_share", "return", "far"]
    own = projects.select(F.col(key).cast("bigint").alias("key"), *[F.col(n).cast("double").alias(n) for n in names])
    own = own.select("key", F.struct(*names).alias("project")).distinct()
    n = len(types["util"])
    counts = [F.col(f"c{k}").cast("int") for k in range(n)]
    # Dealt anew, as few different projects may hash to few tasks.
    different = spread(own.select("project").distinct()).select("project", "project.*")
    priced = priced_mixes(mixes(different, types), types, costs).where("price >= 0")
    found = F.struct("price", "sales", "util", "common", "parking", F.array(*counts).alias("per_floor"), F.array(*[(c * F.col("_factor")).cast("int") for c in counts]).alias("mix"))
    best = priced.groupBy("project").agg(F.max_by(found, F.struct("price", *[-c for c in counts])).alias("b"))
    better = F.struct("b.price", *[-F.get("b.per_floor", F.lit(k)) for k in range(n)])
    each = own.join(best, "project", "left").groupBy("key").agg(F.max_by("b", F.when(F.col("b").isNotNull(), better)).alias("b"))
    return each.select("key", F.col("b").isNotNull().alias("feasible"), "b.*")
