"""Collections kept side by side instead of overwritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unseen(history: DataFrame, collection: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a collection whose key the history does not hold yet.

    The history is first cut down to the keys the collection asks for; with a small collection these are
    broadcast and the long history is scanned without a shuffle. Keys are compared NULL-safe.
    """
    asked = collection.select(*[F.col(key).alias(f"_{key}") for key in keys]).distinct()
    kept = history.select(*[F.col(key).alias(f"_seen_{key}") for key in keys])
    seen = kept.join(asked, _equal("_seen_", "_", keys), "left_semi").distinct()
    return collection.join(seen, _equal("", "_seen_", keys), "left_anti")


def _equal(left: str, right: str, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}{key}").eqNullSafe(F.col(f"{right}{key}"))
    return condition


def append_history(
    spark: SparkSession, path: str, collection: DataFrame, collection_id: int, keys: Sequence[str]
) -> DataFrame:
    """Add a collection's new rows to the table at ``path`` under its id and return the whole table.

    Earlier collections are never rewritten; each id is its own folder. Running the same id again replaces
    that folder only, so a collection that failed half-way can simply be repeated.
    """
    layout = collection.withColumn("collection_id", F.lit(collection_id).cast("int")).schema
    try:
        history = spark.read.schema(layout).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        earlier = history.where(F.col("collection_id") != collection_id)
        collection = unseen(earlier.select(*collection.columns), collection, keys)
    collection.write.mode("overwrite").parquet(f"{path}/collection_id={collection_id}")
    return spark.read.schema(layout).parquet(path)


# Folders of the key index; a collection reads only those that its own keys fall into.
INDEX_BUCKETS = 256


def append_indexed(
    spark: SparkSession, path: str, collection: DataFrame, collection_id: int, keys: Sequence[str], buckets: int = INDEX_BUCKETS
) -> DataFrame:
    """:func:`append_history` beside an index of the keys, so that a small collection does not scan the history's rows.

    ``path/rows`` holds the rows by collection, ``path/keys`` only their keys by collection and bucket, the keys' hash modulo
    ``buckets``, which must stay the same for a table. The buckets of the new rows, at most ``buckets`` numbers, become a filter on the
    folders. Rows are written before their keys; repeating an id replaces its rows and keys only.
    """
    layout = collection.withColumn("collection_id", F.lit(collection_id).cast("int")).schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    seen = indexed_keys(spark, path, collection, keys, collection_id, buckets)
    fresh = collection if seen is None else unseen(seen, collection, keys)
    fresh.write.mode("overwrite").parquet(f"{path}/rows/collection_id={collection_id}")
    written = spark.read.schema(collection.schema).parquet(f"{path}/rows/collection_id={collection_id}")
    by_bucket = written.select(*keys, bucket).distinct().repartition("bucket")
    by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys/collection_id={collection_id}")
    return spark.read.schema(layout).parquet(f"{path}/rows")


def indexed_keys(
    spark: SparkSession, path: str, collection: DataFrame, keys: Sequence[str], collection_id: int, buckets: int = INDEX_BUCKETS
) -> DataFrame | None:
    """The keys that other collections stored in the buckets of a collection's keys; None without an index."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    kinds = collection.select(*keys, bucket, F.lit(0).cast("int").alias("collection_id")).schema
    try:
        index = spark.read.schema(kinds).parquet(f"{path}/keys")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    asked = [row["bucket"] for row in collection.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
    return index.where(F.col("bucket").isin(asked) & (F.col("collection_id") != collection_id)).select(*keys)
