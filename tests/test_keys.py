import random
from datetime import datetime

import pytest
from rowtools import as_tuples
from pyspark.sql import functions as F

from postprism.operators.keys import first_seen_dimension, surrogate_key


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(7)
    data = [
        (draw.choice([None, "a", "b", "c", "Ä", "Z"]), draw.choice([None, 1, 2]), draw.choice([None, 0.5, 1.5]), i)
        for i in range(1500)
    ]
    return spark.createDataFrame(data, "name string, grade int, pay double, seq int")


def expected(rows):
    def place(row):
        return tuple((value is None, value.encode() if isinstance(value, str) else value or 0) for value in row)

    return {tuple(row): number for number, row in enumerate(sorted(as_tuples(rows), key=place), 1)}


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_equals_a_global_order_with_any_number_of_partitions(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        keyed = surrogate_key(rows.repartition(5), "id", ["name", "grade"])
        got = {tuple(row[1:]): row[0] for row in as_tuples(keyed)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == expected(rows)


def test_many_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keyed = surrogate_key(spark.range(10000).select((F.lit(10000) - F.col("id")).alias("v")), "id", ["v"])
        assert keyed.where("id <> v").count() == 0
        assert keyed.select("id").distinct().count() == 10000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_no_row_goes_through_one_task(spark, rows):
    plan = surrogate_key(rows, "id", ["name"])._jdf.queryExecution().executedPlan().toString()
    # Only the offsets, one row per range, meet in one task: they come from the counts.
    before_single = plan[: plan.index("SinglePartition")] if "SinglePartition" in plan else plan
    assert "Window" in before_single
    assert plan.count("SinglePartition") == plan.count("count(1)") // 2 or plan.count("SinglePartition") <= 1


def test_empty(spark, rows):
    assert surrogate_key(rows.where("false"), "id", ["name"]).count() == 0


def test_leading_ties_are_cut_into_ranges(spark):
    """A third of the rows share the leading column; the tie-breakers still split them."""
    rows = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("lead"), "id")
    keyed = surrogate_key(rows.withColumnRenamed("id", "seq"), "id", ["lead"])
    assert keyed.where("lead = 0").agg(F.max("id")).first()[0] == 10000
    assert keyed.agg(F.max("id"), F.count_distinct("id")).first() == (30000, 30000)


def test_first_seen(spark):
    rows = spark.createDataFrame(
        [(4, "b"), (2, None), (3, "a"), (1, "b"), (9, None), (5, "Unknown")], "job_id long, company string"
    )
    dimension = first_seen_dimension(rows, "company", "job_id", "company_id")
    assert sorted(as_tuples(dimension)) == [(1, "b"), (2, "Unknown"), (3, "a")]


def test_timestamps_order(spark):
    rows = spark.createDataFrame(
        [(datetime(2023, 1, 2),), (None,), (datetime(2022, 1, 2),)], "t timestamp_ntz"
    )
    assert as_tuples(surrogate_key(rows, "id", ["t"]).orderBy("id"), "t") == [
        (datetime(2022, 1, 2),), (datetime(2023, 1, 2),), (None,)
    ]
