"""Dense, repeatable keys without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from postprism.session import materialise

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row's position in the low 33 bits


def surrogate_key(
    df: DataFrame, key: str, order_by: Sequence[str], unique: bool = False, observed: tuple[Observation, Sequence[Column]] | None = None
) -> DataFrame:
    """Number rows 1..n by ``order_by`` (NULLs last), then by every other column.

    ``unique`` says that no two rows share ``order_by``: other columns, such as long texts, are then neither sampled nor compared.

    Equal to ``row_number()`` over one global order, but the sort is split by ranges: each task
    sorts its range, a row knows its place in the range, and the ranges' row counts give the offset.
    Using all columns as tie-breakers makes the key repeatable and lets a run of equal leading
    columns be cut into several ranges; rows should be distinct (drop full duplicates first).
    Range bounds come from a sample, so the placed rows are written once before they are read twice. ``observed`` takes measures of
    all rows during that write.
    """
    ties = [] if unique else [name for name in df.columns if name not in order_by]
    order = [F.col(name).asc_nulls_last() for name in (*order_by, *ties)]
    ranges = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << _POSITION_BITS) - 1))
    )
    placed = materialise(ranges.observe(observed[0], *observed[1]) if observed else ranges, f"placed-{key}")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: its size is bounded by the number of shuffle partitions, not by the data.
    offsets = (
        placed.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    return placed.join(F.broadcast(offsets), "_range").select(
        (F.col("_before") + F.col("_place") + 1).cast("bigint").alias(key), *df.columns
    )


def first_seen_dimension(rows: DataFrame, name: str, order: str, key: str, missing: str = "Unknown") -> DataFrame:
    """Dimension keyed by first appearance: the name with the lowest ``order`` gets key 1.

    Missing names share one entry. Names are reduced map-side, so a name on a third of all
    rows costs one row per task.
    """
    firsts = rows.groupBy(F.coalesce(F.col(name), F.lit(missing)).alias("name")).agg(F.min(order).alias("_first"))
    return surrogate_key(firsts, key, ["_first", "name"], unique=True).select(key, "name")
