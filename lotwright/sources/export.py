"""Exports: GeoJSON features, drawing scripts and reports, as rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colours of a building by its gap, and the thickness of its slabs in metres.
RED, YELLOW, GREEN, YELLOW_TO, SLAB = "#e36465", "#f2ec77", "#92ba7b", 0.2, 0.2
CRS = "urn:ogc:def:crs:OGC:1.3:CRS84"


def gap_colour(gap: Column) -> Column:
    return F.when(gap <= 0, RED).when(gap <= YELLOW_TO, YELLOW).otherwise(GREEN)


def coordinates(ring: Column) -> Column:
    """A ring's vertices as GeoJSON's closed coordinates."""
    pairs = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    return F.array(pairs)


def feature(ring: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates(ring).alias("coordinates")).alias("geometry")))


def building_features(df: DataFrame, key: str, floors: str, height: str, base: str, first: str, gap: str) -> DataFrame:
    """A slab and the walls of each floor: (key, floor, part, bottom, top, colour, feature).

    The first floor has its own ring; slabs are SLAB high, walls fill the rest.
    """
    each = df.withColumn("floor", F.explode(F.sequence(F.lit(1), F.col(floors).cast("int"))))
    bottom = (F.col("floor") - 1) * F.col(height)
    parts = F.array(
        F.struct(F.lit("slab").alias("part"), bottom.alias("bottom"), (bottom + SLAB).alias("top")),
        F.struct(F.lit("walls").alias("part"), (bottom + SLAB).alias("bottom"), (bottom + F.col(height)).alias("top")),
    )
    ring = F.when(F.col("floor") == 1, F.col(first)).otherwise(F.col(base))
    each = each.withColumn("_ring", ring).withColumn("_p", F.explode(parts))
    each = each.select(key, "floor", "_ring", "_p.*", gap_colour(F.col(gap)).alias("colour"))
    about = F.struct("floor", "part", F.col("bottom").alias("base_height"), F.col("top").alias("height"), F.col("colour").alias("color"))
    return each.select(key, "floor", "part", "bottom", "top", "colour", feature(F.col("_ring"), about).alias("feature"))


def feature_collection(df: DataFrame, group: str, text: str, order: list[str]) -> DataFrame:
    """One GeoJSON text a group (a building or location, which bounds it)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text")))), lambda x: x["_text"])
    head = f'{{"type":"FeatureCollection","crs":{{"type":"name","properties":{{"name":"{CRS}"}}}},"features":['
    return df.groupBy(group).agg(F.concat(F.lit(head), F.array_join(parts, ","), F.lit("]}")).alias("geojson"))


def summary_features(df: DataFrame, key: str, ring: str, properties: list[str]) -> DataFrame:
    """(key, feature): a GeoJSON feature of each location's ring, with its centroid and ``properties``."""
    from ..functions.geometry import centroid

    c = centroid(F.col(ring))
    own = F.struct(c["x"].alias("centroid_x"), c["y"].alias("centroid_y"), *properties)
    return df.select(key, feature(F.col(ring), own).alias("feature"))


def script_lines(df: DataFrame, key: str, ring: str, height: Column, floors: Column) -> DataFrame:
    """(key, place, line): drawing commands for a ring, extruded and copied floor by floor."""
    number = lambda c: F.call_function("format_number", F.lit(c).cast("double"), F.lit("0.####"))
    corner = lambda p: F.concat_ws(",", number(p["x"]), number(p["y"]), F.lit("0"))
    outline = F.concat(F.array(F.lit("3dpoly")), F.transform(ring, corner), F.array(F.lit("c")))
    solid = F.array(F.concat(F.lit("extrude last  "), number(height)))
    copies = F.transform(F.sequence(F.lit(1), F.greatest(floors.cast("int") - 1, F.lit(1))), lambda k: F.when(floors > 1, F.concat(F.lit("copym last  0,0,0 0,0,"), number(k * height))))
    every = F.filter(F.concat(outline, solid, copies), lambda x: x.isNotNull())
    return df.select(key, F.posexplode(every).alias("place", "line"))


def face_lines(ring: Column, height: Column) -> Column:
    """The walls of a prism as 3DFACE commands."""
    number = lambda c: F.call_function("format_number", F.lit(c).cast("double"), F.lit("0.####"))
    n = F.size(ring)
    at = lambda i, z: F.concat_ws(",", number(F.get(ring, F.pmod(i, n))["x"]), number(F.get(ring, F.pmod(i, n))["y"]), number(z))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(" ", F.lit("3DFACE"), at(i, F.lit(0)), at(i + 1, F.lit(0)), at(i + 1, height), at(i, height)))


def report(df: DataFrame, names: list[str], digits: int = 2) -> DataFrame:
    """Rounded numbers under their names, one row each: (name, value)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.round(F.col(n).cast("double"), digits).alias("value")) for n in names])
    return df.select(F.explode(pairs).alias("r")).select("r.*")
