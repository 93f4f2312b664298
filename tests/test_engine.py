"""Spatial joins, tables, sources and pipeline stages on small frames."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lotwright.functions import geometry as g
from lotwright.operators import geo_udf, graph, relational, spatial_join
from lotwright.plans import pipeline
from lotwright.sources import export, tables


def _boxes(spark, prefix):
    return spark.range(40).select(F.col("id").alias(f"{prefix}k"), F.array(g.box(F.col("id") % 7 * 9, F.col("id") % 5 * 9, F.col("id") % 4 * 3 + 2, 5)).alias(f"{prefix}s"))


def test_grid_join_equals_nested_loop_and_plans_no_nested_loop(spark):
    a, b = _boxes(spark, "a"), _boxes(spark, "b")
    joined = spatial_join.bounds_join(a, b, g.bounds(F.element_at("as", 1)), g.bounds(F.element_at("bs", 1)), cell=6.0)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r.ak, r.bk) for r in joined.select("ak", "bk").collect())
    rows = [(i, i % 7 * 9, i % 5 * 9, i % 4 * 3 + 2, 5) for i in range(40)]
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[1] <= q[1] + q[3] and q[1] <= p[1] + p[3] and p[2] <= q[2] + q[4] and q[2] <= p[2] + p[4])
    assert got == want


def test_clipped_and_dissolved(spark):
    a = spark.range(1).select(F.array(g.box(0, 0, 10, 10)).alias("as"))
    b = spark.range(3).select(F.col("id").alias("bk"), F.array(g.box(F.col("id") * 12, 0, 5, 5)).alias("bs"))
    near = spatial_join.clipped(a, b, "as", "bs", g.bounds(F.element_at("as", 1)), g.bounds(F.element_at("bs", 1)), 5.0)
    assert sorted(r.bk for r in near.select("bk").collect()) == [0, 1]
    merged = geo_udf.dissolve(b.withColumn("one", F.lit(1)), ["one"], "bs").select(g.shape_area(F.col("bs"))).first()[0]
    assert merged == pytest.approx(75)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 9)] + [(20, 21), (30, 22), (22, 21)], "u bigint, v bigint")
    got = {r.vertex: r.component for r in graph.components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 10)}, 20: 20, 21: 20, 22: 20, 30: 20}


def test_wkt(spark):
    text = "MULTIPOLYGON Z (((0 0 5, 4 0 5, 4 3 5, 0 0 5), (1 1 0, 2 1 0, 1 2 0, 1 1 0)), ((10 10 0, 11 10 0, 11 11 0, 10 10 0)))"
    shape = spark.range(1).select(g.from_wkt(F.lit(text)).alias("s")).first().s
    assert [len(r) for r in shape] == [3, 3] and shape[0][1].x == 4


def test_tables(spark, tmp_path):
    name = "Lots_T"
    tables.delete_table(spark, name)
    tables.create_table(spark, name, [("id", "bigint"), ("area", "double"), ("owner", "string")], "id")
    tables.append(spark.createDataFrame([(1, 10.0)], "id bigint, area double"), name)
    assert tables.table_exists(spark, name)
    have = spark.table(name.lower())
    assert have.collect()[0].asDict() == {"id": 1, "area": 10.0, "owner": None}
    more = tables.insert_rows(have, spark.createDataFrame([("b",), ("a",)], "owner string"), "id", ["owner"])
    assert sorted((r.id, r.owner) for r in more.collect()) == [(1, None), (2, "a"), (3, "b")]
    tables.delete_table(spark, name)
    assert not tables.table_exists(spark, name)
    with pytest.raises(ValueError):
        tables.create_table(spark, "x", [("a", "int")], "b")
    tables.write_csv(spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"), str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "a int, b string").count() == 2
    tables.write_xlsx(spark.createDataFrame([(1, "x<y")], "a int, b string"), str(tmp_path / "r.xlsx"))
    assert "x&lt;y" in zipfile.ZipFile(tmp_path / "r.xlsx").read("xl/sheet1.xml").decode()


def test_nulls_in_changes(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id int, v int")
    assert tables.delete_rows(df, F.col("v") == 5).count() == 1
    changed = tables.modify_rows(df, {"v": F.lit(9)}, F.col("v") == 5)
    assert sorted((r.id, r.v) for r in changed.collect()) == [(1, 9), (2, None)]
    found = relational.gap(spark.createDataFrame([(1.0, 0.0), (3.0, 2.0), (1.0, None)], "cost double, market double"))
    assert [(r.gap, r.gap_pct) for r in found.collect()] == [(None, None), (1.0, 0.5), (None, None)]


def test_exports(spark):
    b = spark.range(1).select(F.lit(1).alias("key"), F.lit(2).alias("floors"), F.lit(3.0).alias("height"), g.box(0, 0, 4, 4).alias("base"), g.box(0, 0, 2, 2).alias("first"), F.lit(0.3).alias("gap"))
    told = json.loads(pipeline.publish(b).first().geojson)
    assert [f["properties"]["part"] for f in told["features"]] == ["slab", "walls"] * 2
    assert told["features"][0]["geometry"]["coordinates"][0][2] == [2.0, 2.0]
    assert told["features"][2]["geometry"]["coordinates"][0][2] == [4.0, 4.0]
    assert len(b.select(export.face_lines(F.col("base"), F.lit(3.0)).alias("l")).first().l) == 4
    assert export.report(b, ["height", "gap"]).count() == 2


def test_pipeline_stages(spark):
    parcels = spark.range(6).select(F.lit(1).alias("block"), F.col("id").alias("parcel"), F.lit(900.0).alias("area"), F.array(g.box(F.col("id") * 30, 0, 30, 30)).alias("shape"))
    combos = pipeline.combine(parcels)
    assert combos.count() == 5 + 4 + 3  # pairs, threes, fours: 1800 to 3600
    members = combos.select("combo", F.explode("lots").alias("lot"))
    located = pipeline.locate(members)
    assert located.select("location").distinct().count() == 1
    costs = combos.select("combo", (F.col("area") * 50).alias("cost"))
    prices = parcels.select(F.col("parcel").alias("lot"), F.lit(40000.0).alias("price"))
    compared = pipeline.compare(located, costs, prices)
    assert pipeline.summarise(compared).first().gap == pytest.approx(3600 * 50 - 4 * 40000)
    assert len(pipeline.choose(located, compared).first().lots) >= 1
    found = pipeline.bid(located.join(prices.select("lot", F.col("price").alias("market"), F.lit(900.0).alias("area")), "lot"), compared)
    r = found.first()
    assert r.utility >= r.start_utility


def test_database_queries_in_ranges(spark):
    """Against the database that Spark brings along, in memory."""
    url = "jdbc:derby:memory:lots;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(50).select(F.col("id").alias("LOT"), (F.col("id") * 2.5).alias("AREA"))
    rows.write.jdbc(url, "LOTS", mode="overwrite", properties=driver)
    text = "SELECT LOT, AREA FROM LOTS WHERE LOT >= 10"
    whole = tables.read_jdbc(spark, url, text, "app", "app", **driver)
    parts = tables.read_jdbc(spark, url, text, "app", "app", key="LOT", bounds=(10, 50), parts=4, **driver)
    want = [(k, k * 2.5) for k in range(10, 50)]
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) == want
    assert parts.rdd.getNumPartitions() == 4


def test_files_on_another_file_system(spark, tmp_path):
    """Paths go through Hadoop's file systems: one that is mounted serves like the local one."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lots.link./in", f"file://{tmp_path}")
    path = "viewfs://lots/in/prices"
    tables.write_csv(spark.createDataFrame([(1, "a"), (2, None)], "id int, name string"), path)
    assert sorted(map(tuple, tables.read_csv(spark, path, "id int, name string").collect())) == [(1, "a"), (2, None)]
    assert list((tmp_path / "prices").glob("*.csv"))


def test_sheets_are_written_row_by_row(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.xlsx"
    tables.write_xlsx(spark.range(300).selectExpr("id", "concat('<', id, '>') AS name", "CAST(NULL AS DOUBLE) AS gone").repartition(3), str(path))
    text = zipfile.ZipFile(path).read("xl/sheet1.xml").decode()
    assert text.count("<row>") == 301 and "&lt;7&gt;" in text and text.endswith("</sheetData></worksheet>")
    monkeypatch.setattr(tables, "SHEET_ROWS", 10)
    with pytest.raises(ValueError, match="more than 10 rows"):
        tables.write_xlsx(spark.range(20), str(path))


def test_properties_are_set(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 1.5)], "u int, v int, shared double")
    got = graph.with_property(graph.with_property(edges, "kind", "wall", F.col("shared") > 1), "shared", 2.0, F.col("u") == 1)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 2.0, None), (2, 3, 1.5, "wall")]
    assert [r.n for r in graph.with_property(edges, "n", 7).collect()] == [7, 7]
