"""Joining many rows to a lookup table when a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postprism.operators.population import with_scalar

# A lookup up to this size is sent to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

# A key with more than one in this many rows is heavy, so there are fewer heavy keys than this.
HEAVY_ONE_IN = 1_000


def fits_broadcast(lookup: DataFrame, rows: int = BROADCAST_ROWS, text_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small enough to broadcast, by its rows and the bytes of its texts."""
    lengths = [F.octet_length(field.name) for field in lookup.schema if isinstance(field.dataType, T.StringType)]
    width = sum((F.coalesce(length, F.lit(0)) for length in lengths), F.lit(0))
    size = lookup.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).first()
    return size["n"] <= rows and (size["bytes"] or 0) <= text_bytes


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of rows to a lookup that holds each key once.

    A lookup of checked size is broadcast. With a larger one the rows are shuffled by key, except those of heavy
    keys, which would all meet in one task: their few lookup rows are broadcast instead. A heavy key holds more than
    a fixed share of all rows, so the number of heavy keys is bounded whatever the data.
    """
    if fits_broadcast(lookup, broadcast_rows):
        return rows.join(F.broadcast(lookup), key)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    whole = counts.agg(F.sum("_rows").alias("_whole"))
    heavy = with_scalar(counts, whole).where(F.col("_rows") * HEAVY_ONE_IN > F.col("_whole")).select(key)
    of_heavy = lookup.join(F.broadcast(heavy), key, "left_semi")
    spread = rows.join(F.broadcast(heavy), key, "left_anti").join(lookup, key)
    return spread.unionByName(rows.join(F.broadcast(of_heavy), key))
