"""The registered land-assembly queries and their SQL oracles."""

from __future__ import annotations

from . import geometry_queries, kernel_queries, parcel_queries, relational_queries, spatial_queries, table_queries

_PARTS = (relational_queries, geometry_queries, spatial_queries, kernel_queries, parcel_queries, table_queries)


def queries():
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
