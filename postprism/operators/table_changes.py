"""Table changes as steps that give a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_column(table: DataFrame, name: str, kind: str = "string") -> DataFrame:
    """A new column, NULL at first."""
    return table.withColumn(name, F.lit(None).cast(kind))


def update_by_key(table: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Set ``column`` from ``updates(key, column)``; rows without an update keep their value.

    All updates are one join instead of one pass each. ``updates`` holds a key once.
    """
    new = updates.select(F.col(key).alias("_key"), F.col(column).alias("_new"), F.lit(True).alias("_set"))
    changed = table.join(new, table[key] == F.col("_key"), "left")
    values = {name: F.col(name) for name in table.columns}
    values[column] = F.when(F.col("_set"), F.col("_new")).otherwise(F.col(column))
    return changed.select(*[values[name].alias(name) for name in table.columns])


def rename_column(table: DataFrame, old: str, new: str) -> DataFrame:
    return table.withColumnRenamed(old, new)


def change_type(table: DataFrame, column: str, kind: str) -> DataFrame:
    """Values that do not fit the new type become NULL."""
    return table.withColumn(column, F.col(column).try_cast(kind))


def drop_column(table: DataFrame, column: str) -> DataFrame:
    return table.drop(column)
