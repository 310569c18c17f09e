"""Joins that survive keys holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds more than one in this many rows is met by broadcast; so at most this many rows are sent.
HOT_SHARE = 1000


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with the one row of ``found`` per key (inner join; ``found`` is read twice).

    ``size`` names the column of ``found`` that counts the key's rows and
    ``total`` bounds the sum of all counts, so that at most ``HOT_SHARE`` keys
    count as hot. Hot keys are met by broadcast, the others by a shuffle.
    """
    hot = F.col(size) * HOT_SHARE > total
    often = F.broadcast(found.where(hot).withColumn("__hot", F.lit(True)))
    met = rows.join(often, keys, "left")
    plain = met.where(F.col("__hot").isNull()).select(*rows.columns).join(found.where(~hot), keys)
    return met.where(F.col("__hot")).select(*plain.columns).unionByName(plain)
