"""Exact quantiles per group with bounded memory per task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pay in cents fits decimal(12,2), i.e. below 2**40: at most 2**20 buckets of at most 2**20 values.
_BUCKET_BITS = 20


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per (keys, value) as column ``n``, NULL values left out.

    The only pass that moves data: it is combined map-side and spread over keys *and* values, so a
    key on a third of all rows is not one task's work.
    """
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def grouped_quantiles(
    counts: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], bucket_bits: int = _BUCKET_BITS
) -> DataFrame:
    """Exact, interpolated quantiles of bigint values per group, with the group's size and sum.

    ``counts`` is the result of :func:`value_counts`. Returns keys, ``n``, ``total`` (sum of values),
    ``low`` and ``high`` and one double per entry of ``quantiles`` (name -> fraction). No keys gives one
    row, also for no input. Rows with a NULL key belong to no group.

    Spark's ``percentile`` keeps all distinct values of a group in one task. Here the values are first
    added up in buckets of ``2**bucket_bits`` neighbouring values; a running total finds the few buckets
    that hold the wanted ranks; only these are ordered value by value. A window never sees more than
    the buckets of one group or the values of one bucket.
    """
    bucketed = counts.withColumn("_bucket", F.shiftright(value, bucket_bits))
    # Stated here so that both uses below are the same plan and share one shuffle of the counts.
    for name in (*keys, "_bucket"):
        bucketed = bucketed.where(F.col(name).isNotNull())
    whole = Window.partitionBy(*keys)
    running = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(
            F.sum("n").alias("_rows"),
            F.sum(F.col(value) * F.col("n")).alias("_sum"),
            F.min(value).alias("_min"),
            F.max(value).alias("_max"),
        )
        .select(
            *keys,
            "_bucket",
            "_rows",
            F.sum("_rows").over(running).alias("_upto"),
            F.sum("_rows").over(whole).alias("_n"),
            F.sum("_sum").over(whole).alias("_total"),
            F.min("_min").over(whole).alias("_low"),
            F.max("_max").over(whole).alias("_high"),
        )
    )

    size = F.col("_n")
    ranks: dict[str, tuple[Column, Column, Column]] = {}
    for name, fraction in quantiles.items():
        place = F.lit(float(fraction)) * (size - 1)
        ranks[name] = (F.floor(place) + 1, F.ceil(place) + 1, place - F.floor(place))
    wanted = F.lit(False)
    for lower, upper, _ in ranks.values():
        for rank in (lower, upper):
            wanted = wanted | ((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_rows") < rank))
    targets = buckets.where(wanted).select(
        *[F.col(name).alias(f"_target_{name}") for name in keys],
        F.col("_bucket").alias("_target_bucket"),
        (F.col("_upto") - F.col("_rows")).alias("_before"),
        "_n",
        "_total",
        "_low",
        "_high",
    )

    same = F.col("_bucket") == F.col("_target_bucket")
    for name in keys:
        same = same & (F.col(name) == F.col(f"_target_{name}"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    if not keys:
        # One group: at most two buckets per quantile.
        targets = F.broadcast(targets)
    ordered = bucketed.join(targets, same).withColumn("_upto", F.col("_before") + F.sum("n").over(within))

    picks = [
        F.coalesce(F.max("_n"), F.lit(0)).cast("bigint").alias("n"),
        F.max("_total").alias("total"),
        F.max("_low").alias("low"),
        F.max("_high").alias("high"),
    ]
    for name, (lower, upper, _) in ranks.items():
        picks.append(F.min(F.when(F.col("_upto") >= lower, F.col(value))).alias(f"_{name}_lower"))
        picks.append(F.min(F.when(F.col("_upto") >= upper, F.col(value))).alias(f"_{name}_upper"))
    found = ordered.groupBy(*keys).agg(*picks)

    results = []
    for name, fraction in quantiles.items():
        place = F.lit(float(fraction)) * (F.col("n") - 1)
        lower, upper = F.col(f"_{name}_lower").cast("double"), F.col(f"_{name}_upper").cast("double")
        results.append((lower + (upper - lower) * (place - F.floor(place))).alias(name))
    return found.select(*keys, "n", "total", "low", "high", *results)

