"""Queries on whole tables: numbering, changes of partitions, files that are loaded and joined."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.numbers import q6, q6_sql
from ..operators import capacity, economics, relational
from ..operators.rounds import shared_folder
from ..sources import tables
from . import pipeline

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_LINE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, number FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(_LINE)}) AS number FROM lineitem) WHERE number % 100 = 0")
def every_hundredth_line(spark, t):
    """Every hundredth line of all, by the date and what else tells lines apart."""
    found = relational.every_kth(t("lineitem"), None, [F.col(c) for c in _LINE], 100)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.col("rank").alias("number"))


@query(f"SELECT o_orderkey AS id, o_totalprice AS amount FROM orders UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY {', '.join(_LINE)}), l_extendedprice FROM lineitem")
def inserted_lines(spark, t):
    """All lines inserted into the orders, numbered after the greatest id."""
    have = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    new = tables.insert_rows(have, t("lineitem").select(*_LINE, F.col("l_extendedprice").alias("amount")), "id", _LINE)
    return new.select("id", "amount")


def outcome(key, names: list[str]):
    """One of the names (or none) for each key."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.floor(key / 8), F.lit(len(names))) + 1).cast("int"))


_VOLUME = ["done", "done", "infeasible", "low", "error", None, "done"]
_PROVISION = ["done", "error", "done", None]
_ECONOMY = ["done", "done", "error"]


@query("""
WITH o AS (SELECT o_orderkey AS combo, o_orderkey % 8 AS part, o_orderkey // 8 AS n FROM orders),
v AS (SELECT *, CASE WHEN part >= 6 THEN 3 ELSE CASE n % 7 WHEN 2 THEN 192 WHEN 3 THEN 193 WHEN 4 THEN 191 WHEN 5 THEN 0 ELSE 1 END END AS s FROM o),
p AS (SELECT *, CASE WHEN s = 1 THEN CASE n % 4 WHEN 1 THEN 29 WHEN 3 THEN 1 ELSE 2 END ELSE s END AS s2 FROM v)
SELECT combo, part, CAST(CASE WHEN s2 = 2 THEN CASE n % 3 WHEN 2 THEN 39 ELSE 3 END ELSE s2 END AS INTEGER) AS status FROM p
""")
def status_chain(spark, t):
    """Combos from pending to priced in three runs over a table in eight parts, two of which are done before and stay untouched."""
    key = F.col("o_orderkey")
    combos = t("orders").select(key.alias("combo"), F.when(key % 8 >= 6, capacity.ECONOMIC).otherwise(capacity.PENDING).alias("status"), (key % 8).alias("part"))
    path = f"{shared_folder(spark)}/status_chain"
    combos.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
    for run, names in (("volumetric", _VOLUME), ("provisional", _PROVISION), ("economic", _ECONOMY)):
        pipeline.settle(spark, path, ["part"], run, t("orders").select(key.alias("combo"), outcome(key, names).alias("outcome")))
    return spark.read.schema("combo bigint, status int, part bigint").parquet(path)


@query(f"""
SELECT p_partkey, {q6_sql(f"(p_size * 10 + 100) * {economics.UNIT_COSTS['slab_above'] * 1.1 + economics.UNIT_COSTS['architecture']} + {economics.UNIT_COSTS['sales_room']}")} AS cost FROM part
""")
def costs_from_a_file(spark, t):
    """Unit costs written to a CSV file, changed there, loaded by their names and joined to projects."""
    path = f"{shared_folder(spark)}/unit_costs"
    kept = economics.cost_table(spark, {})
    tables.write_csv(kept.withColumn("value", F.when(F.col("name") == "slab_above", F.col("value") * 1.1).otherwise(F.col("value"))), path)
    row = economics.cost_row(tables.read_csv(spark, path, economics.COSTS))
    own = economics.with_costs(t("part"), row)
    area = F.col("p_size") * 10 + 100
    return own.select("p_partkey", q6(area * (F.col("costs.slab_above") + F.col("costs.architecture")) + F.col("costs.sales_room")).alias("cost"))


@query(f"SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS lines, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 5 END AS points, {q6_sql('p_size + 10.0 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE 5 END')} AS length FROM part")
def street_texts(spark, t):
    """Lines and multiple lines read from text, some of them with heights."""
    size, x = F.col("p_size"), F.col("p_partkey") % 1000
    at = lambda dx, dy: F.concat_ws(" ", (x + dx).cast("string"), dy.cast("string"))
    first = F.concat(at(F.lit(0), F.lit(0)), F.lit(", "), at(size, F.lit(0)), F.lit(","), at(size, F.lit(10)))
    tall = F.concat(at(F.lit(0), F.lit(7)), F.lit(" 12.5, "), at(F.lit(3), F.lit(11)), F.lit(" 13"))
    text = F.when(size % 2 == 0, F.concat(F.lit("LINESTRING ("), first, F.lit(")"))).otherwise(F.concat(F.lit("MULTILINESTRING Z (("), F.regexp_replace(first, ",", " 4,"), F.lit(" 4), ("), tall, F.lit("))")))
    lines = t("part").select(F.col("p_partkey").alias("k"), g.lines_from_wkt(text).alias("l"))
    each = F.flatten(F.transform("l", lambda r: F.zip_with(r, F.slice(r, 2, F.size(r)), lambda a, b: F.when(b.isNotNull(), g.distance(a, b)).otherwise(0.0))))
    return lines.select("k", F.size("l").alias("lines"), F.size(F.flatten("l")).alias("points"), q6(F.aggregate(each, F.lit(0.0), lambda s, v: s + v)).alias("length"))


@query("SELECT s_suppkey AS rol, TRY_CAST(CASE WHEN s_suppkey % 7 = 0 THEN 'n/a' ELSE CAST(s_suppkey * 2 AS VARCHAR) END AS DOUBLE) AS price, s_name AS owner FROM supplier WHERE s_suppkey % 11 <> 0")
def valuations_from_a_file(spark, t):
    """A CSV file under its own headers, loaded under the table's names and types; rows without an id are left out."""
    path = f"{shared_folder(spark)}/valuations"
    key = F.col("s_suppkey")
    raw = t("supplier").select(F.when(key % 11 == 0, F.lit(None)).otherwise(key.cast("string")).alias("Rol"), F.when(key % 7 == 0, "n/a").otherwise((key * 2).cast("string")).alias("Precio"), F.col("s_name").alias("Dueno"))
    tables.write_csv(raw, path)
    read = tables.read_csv(spark, path, "Rol string, Precio string, Dueno string")
    return tables.typed(read, {"rol": ("Rol", "bigint"), "price": ("Precio", "double"), "owner": ("Dueno", "string")}).where("rol IS NOT NULL")
