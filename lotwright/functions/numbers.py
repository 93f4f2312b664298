"""Rounding that is the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q6(value) -> Column:
    """To six decimals, halves up; as a double."""
    c = F.col(value) if isinstance(value, str) else value
    return (F.floor(c * 1e6 + 0.5) / 1e6).cast("double")


def q6_sql(text: str) -> str:
    return f"floor(({text}) * 1e6 + 0.5) / 1e6"
