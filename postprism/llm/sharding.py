"""Shards of near-equal size: longest processing time first, whole groups to the least-loaded shard."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postprism.session import materialise

SHARDS = 24
UNITS_PER_SHARD = 1_024  # bins of small groups, and at most as many large groups, for each shard
ROWS_PER_RUN = 200_000  # rows numbered together
OVERHEAD = 8  # bytes of a row besides its text


def longest_first(sizes: pd.Series, shards: int) -> pd.Series:
    """The shard of each unit: largest units first (ties by unit), each to the shard with the least so far (ties: the lower)."""
    loads = [(0, shard) for shard in range(shards)]
    order = sizes.reset_index().sort_values([sizes.name, "unit"], ascending=[False, True])
    chosen = []
    for size in order[sizes.name]:
        load, shard = heapq.heappop(loads)
        chosen.append(shard)
        heapq.heappush(loads, (load + int(size), shard))
    return pd.Series(chosen, index=order["unit"], name="shard", dtype="int32")


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` for each row; equal texts share a shard.

    Law ``bytes``: shards' sizes are near equal. A group is all rows of one text, NULL texts being one group of none.
    A group larger than 1 / (shards * UNITS_PER_SHARD) of everything is a unit of its own; there are fewer of them than
    that. All other groups fall by the hash of their text into shards * UNITS_PER_SHARD bins, each a unit. So the heap sees
    a bounded number of units whatever the rows, and both tables of their shards are small enough to broadcast. One group
    larger than a shard's share fills its shard alone: it must not be cut. Slots are gapless from 0 in each shard; rows
    are numbered in runs by the hash of their key, runs after each other. NULL keys are ordinary. No rows: no rows.
    """
    spark = docs.sparkSession
    units = shards * UNITS_PER_SHARD
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(key).cast("long").alias("key"),
            (F.octet_length(value) + OVERHEAD).cast("long").alias("size"),
            F.crc32(value.cast("binary")).cast("long").alias("crc"),
            F.xxhash64(text).alias("group"),
        ),
        "shard-rows",
    )
    groups = materialise(rows.groupBy("group").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "shard-groups")
    whole = groups.agg(F.sum("size").alias("size"), F.sum("n").alias("n")).first()
    total, count = whole["size"] or 0, whole["n"] or 0
    large = F.col("size") * units > total
    bin_of = F.pmod(F.xxhash64("group"), F.lit(units))
    parts = groups.groupBy(large.alias("large"), F.when(large, F.col("group")).otherwise(bin_of).alias("unit")).agg(F.sum("size").alias("size"))
    found = parts.toPandas()  # at most 2 * units rows
    found["unit"] = list(zip(found["large"], found["unit"], strict=True))
    placed = longest_first(found.set_index("unit")["size"], shards)
    table = [(bool(is_large), int(unit), int(place)) for (is_large, unit), place in placed.items()]
    places = spark.createDataFrame(table, "large boolean, unit long, shard int")
    alone = places.where("large").select(F.col("unit").alias("group"), F.col("shard").alias("own"))
    shared = places.where("not large").select(F.col("unit").alias("bin"), F.col("shard").alias("common"))
    runs = max(1, -(-count // (shards * ROWS_PER_RUN)))
    sharded = (
        rows.join(F.broadcast(alone), "group", "left")
        .withColumn("bin", bin_of)
        .join(F.broadcast(shared), "bin", "left")
        .withColumn("shard", F.coalesce("own", "common"))
        .withColumn("run", F.pmod(F.xxhash64("key", "group"), F.lit(runs)))
        .select("key", "size", "crc", "group", "shard", "run")
    )
    lengths = sharded.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "run").orderBy("key", "group", "crc")
    numbered = sharded.withColumn("place", F.row_number().over(own)).join(offsets, ["shard", "run"])
    return numbered.select(
        F.col("key").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
