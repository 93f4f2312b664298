"""Queries of the relational operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import q6, q6_sql
from ..operators import locations, relational
from ..operators.rounds import dealt, tasks_for
from ..sources import tables

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a function of a table reader under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def text_of(values):
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def _weighted(c):
    return q6_sql(f"sum(({c}) * l_quantity) / sum(l_quantity)")


@query(f"""
SELECT l_orderkey AS bundle, {q6_sql("sum(l_quantity)")} AS area, {_weighted("l_discount")} AS side_setback, {_weighted("l_tax")} AS front_setback,
  {_weighted("CASE WHEN l_linenumber = 1 THEN 100.0 ELSE l_extendedprice / 1000 END")} AS max_height,
  {_weighted("CASE WHEN l_linenumber % 3 = 0 THEN 30.0 ELSE CAST(l_linenumber AS DOUBLE) END")} AS max_floors,
  {q6_sql("tan(radians(min(40.0 + 2 * l_linenumber)))")} AS slope
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_orderkey
""")
def bundle_weighted_zoning(t):
    parcels = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    parcels = parcels.select(
        F.col("l_orderkey").alias("bundle"),
        "l_quantity",
        F.col("l_discount").alias("side_setback"),
        F.col("l_tax").alias("front_setback"),
        F.when(F.col("l_linenumber") == 1, -1.0).otherwise(F.col("l_extendedprice") / 1000).alias("max_height"),
        F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(F.col("l_linenumber")).alias("max_floors"),
        (F.col("l_linenumber") * 2 + 40.0).alias("slope_degrees"),
    )
    out = relational.weighted_zoning(parcels, "bundle", "l_quantity", ["side_setback", "front_setback"], "max_height", "max_floors", "slope_degrees")
    return out.select("bundle", *[q6(c).alias(c) for c in out.columns[1:]])


@query("SELECT p_partkey FROM part WHERE p_size % 10 >= 3 AND p_retailprice / 4.5 >= 200 AND p_partkey % 3 = 1 AND p_size * 40.0 < p_retailprice")
def highrise_filter(t):
    parcels = t("part").select("p_partkey", (F.col("p_size") % 10).alias("floors"), (F.col("p_retailprice") / 4.5).alias("density"), (F.col("p_partkey") % 3).alias("owners"), (F.col("p_size") * 40.0).alias("built"), F.col("p_retailprice").alias("land"))
    return relational.highrise(parcels).select("p_partkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE upper(s_name) LIKE '%1' OR upper(s_name) LIKE '%7%'")
def owner_like_any(t):
    return relational.like_any(t("supplier"), "s_name", ["%1", "%7%"]).select("s_suppkey", "s_name")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def poi_not_in(t):
    return relational.not_in(t("events"), "event_type", ["click", "view"]).select("event_id", "event_type")


@query("SELECT r_regionkey, r_name FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P')")
def exists_probe(t):
    return relational.where_exists(t("region"), t("orders").where("o_orderstatus = 'P'")).select("r_regionkey", "r_name")


@query("SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS BIGINT) AS status FROM orders WHERE o_orderkey % 4 = 1 ORDER BY 1")
def status_queue_scan(t):
    return relational.status_queue(t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("status")), 1)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20")
def area_band(t):
    return relational.area_band(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 10, 20)


@query("SELECT l_orderkey, sum(l_quantity) AS area FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) BETWEEN 40 AND 90")
def combo_area_band(t):
    return relational.area_band(t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("area")), "area", 40, 90, inclusive=True)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def simple_query(t):
    return tables.simple_query(t("nation"), ["n_nationkey", "n_name"], "n_regionkey = 1")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE NOT coalesce(n_regionkey = 2, false)")
def delete_rows(t):
    return tables.delete_rows(t("nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("n_regionkey") == 2)


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 3 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_regionkey = 3 THEN 30 ELSE n_regionkey END AS n_regionkey FROM nation")
def modify_rows(t):
    return tables.modify_rows(t("nation").select("n_nationkey", "n_name", "n_regionkey"), {"n_name": F.lower("n_name"), "n_regionkey": F.lit(30)}, F.col("n_regionkey") == 3)


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT CAST((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_regionkey) AS INTEGER), r_name FROM region")
def insert_rows_next_id(t):
    return tables.insert_rows(t("nation").select("n_nationkey", "n_name"), t("region").select(F.col("r_name").alias("n_name"), "r_regionkey"), "n_nationkey", ["r_regionkey"]).select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT -1, r_name, r_regionkey FROM region")
def append_rows(t):
    added = tables.append_rows(t("nation").select("n_nationkey", "n_name", "n_regionkey"), t("region").select(F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey")))
    return added.withColumn("n_nationkey", F.coalesce("n_nationkey", F.lit(-1)))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat_ws(',', p_brand, p_type) ELSE concat_ws(',', p_brand, p_name, p_type) END AS codes FROM part")
def wide_to_list(t):
    part = t("part").withColumn("middle", F.when(F.col("p_size") % 2 == 0, "NA").otherwise(F.col("p_name")))
    return part.select("p_partkey", F.array_join(relational.wide_to_list(part, ["p_brand", "middle", "p_type"]), ",").alias("codes"))


@query("SELECT p_partkey, CAST(3 AS INTEGER) AS n, CAST(p_partkey + p_size + 7 AS BIGINT) AS total FROM part")
def decode_list(t):
    part = t("part").select("p_partkey", F.concat_ws("", F.lit("["), F.col("p_partkey").cast("string"), F.lit(","), F.col("p_size").cast("string"), F.lit(",7]")).alias("text"))
    part = part.withColumn("lots", relational.decode_list("text"))
    return part.select("p_partkey", F.size("lots").alias("n"), F.aggregate("lots", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


@query("SELECT p_partkey, concat('[', p_partkey, ',', p_size, ']') AS text FROM part")
def encode_list(t):
    part = t("part").withColumn("lots", F.array(F.col("p_partkey"), F.col("p_size").cast("bigint")))
    return part.select("p_partkey", relational.encode_list("lots").alias("text"))


@query("""
WITH a AS (SELECT p_partkey, [p_size % 5, p_size % 3, 7] AS x, [1, 2, p_size % 4] AS y FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(x, y))), ',') AS both, array_to_string(list_sort(list_distinct(list_filter(x, lambda v: NOT list_contains(y, v)))), ',') AS left_only, list_contains(y, p_size % 5) AS has
FROM a JOIN part USING (p_partkey)
""")
def list_setops(t):
    part = t("part").select("p_partkey", "p_size", F.array(F.col("p_size") % 5, F.col("p_size") % 3, F.lit(7)).alias("x"), F.array(F.lit(1), F.lit(2), F.col("p_size") % 4).alias("y"))
    return part.select("p_partkey", text_of(F.array_sort(F.array_union("x", "y"))).alias("both"), text_of(F.array_sort(F.array_except("x", "y"))).alias("left_only"), F.array_contains("y", F.col("p_size") % 5).alias("has"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)")
def anti_join_chain(t):
    chosen = relational.anti_join_chain(t("customer").select("c_custkey", "c_nationkey"), "c_custkey", (t("orders").where("o_orderstatus = 'F'"), "o_custkey"))
    return relational.anti_join_chain(chosen, "c_nationkey", (t("nation").where("n_regionkey = 3"), "n_nationkey")).select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 1 ELSE CAST(c_custkey % 2 AS INTEGER) * 5 END AS status FROM customer")
def semi_join_update(t):
    queue = t("customer").select("c_custkey", ((F.col("c_custkey") % 2) * 5).cast("int").alias("status"))
    done = t("orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.set_where_found(queue, "c_custkey", done, "status", 0, 1)


@query("""
SELECT s_suppkey AS combo, coalesce((SELECT min(p_partkey) FROM part WHERE p_partkey % 150 = s_suppkey), -s_suppkey) AS id FROM supplier
""")
def rekey_join(t):
    results = t("supplier").select(F.col("s_suppkey").alias("combo"), (-F.col("s_suppkey")).alias("id"))
    return relational.rekey(results, t("part").select((F.col("p_partkey") % 150).alias("combo"), F.col("p_partkey").alias("id")), "combo", "id")


@query("SELECT s_suppkey, (SELECT arg_min(c_name, c_custkey) FROM customer WHERE c_nationkey = s_nationkey) AS c_name FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer)")
def lookup_first(t):
    suppliers = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return relational.lookup_first(suppliers, "nation", t("customer").withColumnRenamed("c_nationkey", "nation"), "c_name", "c_custkey").select("s_suppkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, 'small' AS kind FROM lineitem WHERE l_quantity < 5 UNION ALL SELECT l_orderkey, l_linenumber, 'large' FROM lineitem WHERE l_quantity > 45")
def union_all_lots(t):
    lots = t("lineitem")
    small, large = lots.where("l_quantity < 5"), lots.where("l_quantity > 45")
    return tables.append_rows(small.select("l_orderkey", "l_linenumber", F.lit("small").alias("kind")), large.select("l_orderkey", "l_linenumber", F.lit("large").alias("kind")))


@query("""
WITH c AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey % 5))) AS lots FROM lineitem GROUP BY l_orderkey)
SELECT min(l_orderkey) AS combo, array_to_string(lots, ',') AS lots FROM c GROUP BY lots
""")
def dedupe_combis(t):
    combos = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey") % 5).alias("lots"))
    found = relational.distinct_combos(combos, "lots", "l_orderkey")
    return found.select(F.col("l_orderkey").alias("combo"), text_of(F.array_sort(F.array_distinct("lots"))).alias("lots"))


def _tasks(table):
    """For exchanges of a table's rows; its files tell how many there are."""
    return tasks_for(table.count(), table.sparkSession)


def _members(t):
    lines = t("lineitem")
    tasks = _tasks(lines)
    lines = dealt(lines.select("l_orderkey", "l_partkey"), tasks, "l_orderkey")
    orders = dealt(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), tasks, "l_orderkey")
    return lines.join(orders, "l_orderkey").select(F.col("o_custkey").alias("location"), F.col("l_orderkey").alias("combo"), F.col("l_partkey").alias("lot"))


_MEMBERS = "(SELECT o_custkey AS location, l_orderkey AS combo, l_partkey AS lot FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"SELECT location, array_to_string(list_sort(list_distinct(list(combo))), ',') AS combos FROM {_MEMBERS} GROUP BY location")
def location_lists(t):
    return locations.location_lists(_members(t)).select("location", text_of("combos").alias("combos"))


@query(f"""
WITH m AS {_MEMBERS}, s AS (SELECT location, combo, count(*) AS lots FROM m GROUP BY ALL)
SELECT a.location, a.combos, a.min_lots, a.max_lots, b.different_lots
FROM (SELECT location, count(*) AS combos, min(lots) AS min_lots, max(lots) AS max_lots FROM s GROUP BY location) a
JOIN (SELECT location, count(DISTINCT lot) AS different_lots FROM m GROUP BY location) b ON a.location = b.location
""")
def location_summary(t):
    return locations.location_summary(_members(t))


@query(f"SELECT location, lot, count(DISTINCT combo) AS combos FROM {_MEMBERS} GROUP BY ALL")
def combos_per_lot(t):
    return locations.combos_per_lot(_members(t), _tasks(t("lineitem")))


@query("SELECT l_orderkey AS combo, max(l_quantity) AS max_lot, min(l_quantity) AS min_lot FROM lineitem GROUP BY l_orderkey")
def combi_minmax_lot(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("combo")).agg(F.max("l_quantity").alias("max_lot"), F.min("l_quantity").alias("min_lot"))


def _priced(t):
    price = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_extendedprice"))
    return t("lineitem").select(F.col("l_orderkey").alias("combo"), "l_linenumber", price.alias("price"))


@query(f"SELECT l_orderkey AS combo, {q6_sql('sum(CASE WHEN l_linenumber % 4 <> 0 THEN l_extendedprice ELSE 0 END)')} AS market FROM lineitem GROUP BY l_orderkey")
def market_value(t):
    return relational.market_value(_priced(t), "combo", "l_linenumber", "price").select("combo", q6("market").alias("market"))


@query(f"""
WITH f AS (SELECT l_orderkey, coalesce(min(CASE WHEN l_linenumber % 4 = 0 THEN l_linenumber END), 1000000) AS first FROM lineitem GROUP BY l_orderkey)
SELECT l.l_orderkey AS combo, {q6_sql('sum(CASE WHEN l_linenumber < first THEN l_extendedprice ELSE 0 END)')} AS market FROM lineitem l JOIN f ON l.l_orderkey = f.l_orderkey GROUP BY l.l_orderkey
""")
def market_value_to_first_missing(t):
    return relational.market_value(_priced(t), "combo", "l_linenumber", "price", stop_at_missing=True).select("combo", q6("market").alias("market"))


@query(f"""
WITH c AS (SELECT o_orderkey AS combo, o_totalprice AS cost, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 WHEN o_orderkey % 11 = 0 THEN NULL ELSE 1000.0 * (1 + o_orderkey % 13) END AS market FROM orders)
SELECT combo, {q6_sql('CASE WHEN market <> 0 THEN cost - market END')} AS gap, {q6_sql('CASE WHEN market <> 0 THEN (cost - market) / market END')} AS gap_pct FROM c
""")
def gap_guarded(t):
    key = F.col("o_orderkey")
    market = F.when(key % 7 == 0, 0.0).when(key % 11 != 0, (key % 13 + 1) * 1000.0)
    found = relational.gap(t("orders").select(key.alias("combo"), F.col("o_totalprice").alias("cost"), market.alias("market")))
    return found.select("combo", q6("gap").alias("gap"), q6("gap_pct").alias("gap_pct"))


_GAPS = "(SELECT o_custkey AS location, o_orderkey AS combo, o_totalprice - 150000 AS gap FROM orders)"


def _gaps(t):
    return t("orders").select(F.col("o_custkey").alias("location"), F.col("o_orderkey").alias("combo"), (F.col("o_totalprice") - 150000).alias("gap"))


@query(f"""
SELECT location, combo, {q6_sql('gap')} AS gap FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY gap DESC, combo) AS k FROM {_GAPS}) WHERE k = 1
""")
def max_gap_per_location(t):
    return relational.best_per_group(_gaps(t), "location", "gap", "combo").select("location", "combo", q6("gap").alias("gap"))


@query(f"SELECT location, array_to_string(list(CAST(sign(gap) AS INTEGER) ORDER BY combo), ',') AS signs FROM {_GAPS} GROUP BY location")
def gap_sign_vector(t):
    return relational.best_per_group(_gaps(t), "location", "gap", "combo").select("location", text_of("signs").alias("signs"))


@query(f"SELECT location, combo, {q6_sql('gap')} AS gap FROM {_GAPS} WHERE gap >= 20000 ORDER BY combo")
def gap_threshold(t):
    return _gaps(t).where("gap >= 20000").orderBy("combo").select("location", "combo", q6("gap").alias("gap"))


@query(f"SELECT location, combo, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY gap, combo) AS k FROM {_GAPS}) WHERE k % 5 = 0")
def rank_modulo(t):
    return relational.every_kth(_gaps(t), "location", F.struct("gap", "combo"), 5).select("location", "combo", "rank")


@query(f"SELECT location, combo, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY gap DESC, combo) AS k FROM {_GAPS}) WHERE k <= 2")
def first_tries(t):
    return relational.first_tries(_gaps(t), "location", [F.col("gap").desc(), F.col("combo")]).select("location", "combo", "rank")


@query("SELECT DISTINCT l_suppkey AS lot FROM lineitem ORDER BY 1")
def sorted_unique(t):
    return t("lineitem").select(F.col("l_suppkey").alias("lot")).distinct().orderBy("lot")


@query(f"""
WITH c AS (SELECT l_orderkey, sum(l_extendedprice) AS v, sum(l_quantity) AS a FROM lineitem GROUP BY l_orderkey)
SELECT l_partkey AS lot, {q6_sql('sum(v) / sum(a) * max(l_quantity)')} AS lot_value FROM lineitem JOIN c USING (l_orderkey) GROUP BY l_partkey
""")
def lot_value_from_combis(t):
    lots = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("lot"), F.col("l_quantity").alias("area"), "l_extendedprice")
    combos = lots.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("v"), F.sum("area").alias("a"))
    return relational.lot_values(lots.join(combos, "l_orderkey"), "lot", "area", "v", "a").select("lot", q6("lot_value").alias("lot_value"))


@query(f"SELECT p_brand, {q6_sql('avg((p_size % 5) / (p_size + 10.0))')} AS share FROM part GROUP BY p_brand")
def terrace_share(t):
    return t("part").groupBy("p_brand").agg(q6(F.avg((F.col("p_size") % 5) / (F.col("p_size") + 10.0))).alias("share"))
