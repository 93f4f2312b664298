"""The tables that the queries read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.rounds import spread

#: Tables whose rows of few bytes become shapes and more: a file that one task reads would leave it all the work.
SHAPED = ("part", "supplier", "customer", "events")


def reader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """Reads a table by its name."""

    def read(name: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(df) if name in SHAPED else df

    return read
