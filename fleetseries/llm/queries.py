"""The thin query of each operator and its SQL twin.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLES`` has the
DuckDB statement of those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def load() -> None:
    """Import every module that registers a query."""
    from . import (  # noqa: F401
        conversation_trie,
        decontaminate,
        html_text,
        inner_product,
        license_scan,
        line_dedup,
        ngram_join,
        piece_codec,
        token_count,
        toxicity,
        vector_dedup,
        warc,
        whitening,
    )
