"""Registered queries: one Spark plan per operator, each with its SQL twin.

Every query reads the driver tables of ``sf_dir`` (or data Spark derives from
them) in full; the SQL twin computes the same result independently in DuckDB
over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from fleetseries.plans import (  # noqa: F401
        q_catalog,
        q_files,
        q_mapping,
        q_profile,
        q_publish,
        q_telemetry,
    )
