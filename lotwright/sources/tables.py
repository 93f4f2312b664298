"""Tables as DataFrames: reading, writing and changing them without update in place.

A change is a new DataFrame (or table version); nothing is modified row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import numbered
from ..operators.rounds import drop, keep


def simple_query(source: DataFrame, select: list[str] | None = None, where: str | Column | None = None) -> DataFrame:
    out = source if where is None else source.where(where)
    return out if select is None else out.select(*select)


def sql_query(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The result of SQL text over ``tables``, known to it by their names (and over what the session has registered)."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def read_jdbc(spark: SparkSession, url: str, query: str, user: str, password: str, key: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 1, **options) -> DataFrame:
    """A database query's rows, read in ``parts`` ranges of a numeric ``key`` where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("user", user).option("password", password).options(**options)
    if key is None:
        return reader.option("query", query).load()
    ranges = {"partitionColumn": key, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": parts}
    return reader.option("dbtable", f"({query}) q").options(**ranges).load()


def typed(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """The columns a table is loaded with: its own name, the file's and the type; text that isn't of the type becomes null."""
    return df.select(*[F.expr(f"try_cast(`{source}` AS {kind})").alias(name) for name, (source, kind) in columns.items()])


def create_table(spark: SparkSession, name: str, columns: list[tuple[str, str]], key: str | None = None) -> DataFrame:
    """An empty managed table with a lower-case name; ``key`` must be one of its columns."""
    if key is not None and key not in [c for c, _ in columns]:
        raise ValueError(f"{key} is not a column")
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(t), c != key) for c, t in columns])
    spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name.lower())
    return spark.table(name.lower())


def delete_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name.lower()}")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name.lower())


def materialise(df: DataFrame, name: str, replace: bool = False) -> DataFrame:
    """A table made once: where it exists it is read instead."""
    spark = df.sparkSession
    if replace or not table_exists(spark, name):
        df.write.mode("overwrite").format("parquet").saveAsTable(name.lower())
    return spark.table(name.lower())


def append(df: DataFrame, name: str) -> None:
    """Adds rows in bulk; columns go by name, and those that are absent are null."""
    have = df.sparkSession.table(name.lower())
    own = {c.lower() for c in df.columns}
    df.select(*[(F.col(f.name) if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in have.schema.fields]).write.mode("append").insertInto(name.lower())


def append_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def delete_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is null stay, as with SQL's DELETE."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def modify_rows(df: DataFrame, values: dict[str, Column], condition: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def insert_rows(df: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` and the new rows, numbered after the greatest key by ``order``, without gaps and without one task for all."""
    top = df.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    new = numbered(rows.drop(key), order, key, top + 1)
    return df.unionByName(new.withColumn(key, F.col(key).cast(df.schema[key].dataType)), allowMissingColumns=True)


def modify_partitions(spark: SparkSession, path: str, parts: list[str], change, condition: Column) -> int:
    """Changes rows of the parquet table at ``path``, partitioned by ``parts``; the number of partitions written anew.

    ``change`` takes the rows of all partitions in which some row meets
    ``condition``, and returns what stands there afterwards. Other partitions
    aren't read for it, and their files stay as they are. A partition that
    ``change`` leaves empty keeps its rows: delete it by its folder.
    """
    table = spark.read.parquet(path)
    met = keep(table.where(F.coalesce(condition, F.lit(False))).select(*parts).distinct())
    count = met.count()
    if count:
        same = [table[c].eqNullSafe(met[c]) for c in parts]
        touched = table.join(met, reduce(lambda a, b: a & b, same), "left_semi")
        # Written aside first: the files that are read are those to be replaced.
        new = keep(change(touched).select(*table.columns))
        new.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
        drop(new)
    drop(met)
    return count


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, local or in an object store, by an explicit schema."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="NA", enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


#: Rows of a sheet at most, by the format.
SHEET_ROWS = 1_048_576


def write_xlsx(df: DataFrame, path: str) -> None:
    """One sheet "data" with the column names in row 1, written row by row as partitions arrive; raises beyond what a sheet holds."""
    import zipfile
    from xml.sax.saxutils import escape

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        return f"<c><v>{v!r}</v></c>"

    def lines():
        yield df.columns
        for n, r in enumerate(df.toLocalIterator(), 2):
            if n > SHEET_ROWS:
                raise ValueError(f"more than {SHEET_ROWS} rows")
            yield r

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="sheet1.xml"/></Relationships>')
        with z.open("xl/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            for r in lines():
                sheet.write(f"<row>{''.join(map(cell, r))}</row>".encode())
            sheet.write(b"</sheetData></worksheet>")
