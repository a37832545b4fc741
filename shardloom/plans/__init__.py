"""Registered queries and their DuckDB SQL."""

from shardloom.plans import merge, passthrough, routing, sequences, telemetry, text  # noqa: F401
from shardloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
