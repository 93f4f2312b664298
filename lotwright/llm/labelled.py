"""Bounded samples of labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of labelled rows for which ``usable`` holds, about ``most`` of them in expectation.

    Rows are chosen by a hash of their id. A doc_id with several labels has
    their maximum; null labels and null texts are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.where(usable)
    rows = known.count()
    if rows > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(most / rows * (1 << 20))))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # The sample's ids are bounded by ``most``: a proven size.
    return texts.join(F.broadcast(known), "doc_id")


def unlabelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(doc_id, text) of rows without a label for which ``usable`` holds, about ``most`` in expectation, by a hash of their id."""
    rows = docs.where(usable & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    part = min(1.0, 2 * most / max(rows.count(), 1))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < F.lit(int(part * (1 << 20)))
    texts = rows.where(chosen).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where(F.col(label).isNotNull()).where(chosen).select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return texts.join(known, "doc_id", "left_anti").where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)) == 0)
