"""Row numbers over a whole table without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import keep


def numbered(df: DataFrame, order: list[str | Column], column: str = "number", start: int = 1) -> DataFrame:
    """``df`` with the place of each row by ``order``, from ``start``, without gaps.

    Rows are dealt out by ranges of ``order``, sorted and counted in each, and the
    counts before a range are added: the driver sees one number for each range.
    Rows that are equal in ``order`` share a range, and which of them comes first
    is not defined; give enough columns to tell rows apart, or to spread them.
    """
    spark = df.sparkSession
    # The places must not be worked out twice, or a lost task could give others.
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = keep(dealt.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = dict(dealt.groupBy("_range").count().collect())
    before, rows = start, []
    for k in sorted(counts):
        rows.append((k, before))
        before += counts[k]
    # One row for each range: as many as there are shuffle partitions at most.
    offsets = F.broadcast(spark.createDataFrame(rows, "_range bigint, _before bigint"))
    return dealt.join(offsets, "_range").withColumn(column, F.col("_before") + F.col("_at")).drop("_range", "_before", "_at")
