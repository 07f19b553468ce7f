"""One company, skill or group on a third of all rows: results stay whole and no task gets the group."""

import pytest
from rowtools import as_tuples
from pyspark.sql import functions as F

from postprism.operators.lookup import lookup_join
from postprism.operators.prepare import build_fact
from postprism.plans import calendar, quality
from postprism.schemas import BRIDGE, COMPANY, FACT, SKILL, WIDE
from postprism.session import materialise
from postprism.star import Star

ROWS = 90_000


@pytest.fixture
def no_broadcast(spark):
    """Small thresholds, so that adaptive execution meets the skew of a large run."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def filled(df, schema, **values):
    return df.select(
        *[values.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name) for field in schema]
    )


def heavy_names():
    return F.when(F.col("id") % 3 == 0, "heavy").when(F.col("id") % 7 == 0, "big").otherwise(
        F.concat(F.lit("c"), F.col("id") % 5000)
    )


def test_heavy_keys_are_not_shuffled(spark, no_broadcast):
    """Both ways of the lookup join, and every row is there."""
    rows = spark.range(ROWS, numPartitions=8).select("id", F.when(F.col("id") != 5, heavy_names()).alias("name"))
    lookup = rows.where("name <> 'c11'").select("name").distinct().withColumn("key", F.xxhash64("name"))
    lookup = materialise(lookup, "lookup")
    expected = sorted(as_tuples(rows.join(lookup, "name"), "id", "key"))
    small = lookup_join(rows, lookup, "name")
    large = lookup_join(rows, lookup, "name", broadcast_rows=10)
    assert "SortMergeJoin" not in small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(as_tuples(small, "id", "key")) == expected
    assert sorted(as_tuples(large, "id", "key")) == expected
    # What is shuffled to the large lookup holds no heavy name.
    by_task = large.where("name in ('heavy', 'big')").groupBy(F.spark_partition_id()).count()
    assert by_task.count() >= 8


def test_heavy_company_in_the_fact(spark):
    rows = filled(spark.range(ROWS, numPartitions=8), WIDE, company_name=heavy_names())
    postings = rows.withColumn("job_id", F.monotonically_increasing_id())
    company = rows.select(F.col("company_name").alias("name")).distinct().withColumn("company_id", F.xxhash64("name"))
    fact = build_fact(postings, company)
    assert fact.count() == ROWS
    assert fact.where(F.col("company_id") == F.xxhash64(F.lit("heavy"))).count() == ROWS // 3


def test_stored_tables_are_split_by_adaptive_execution(spark, no_broadcast):
    """Analyses join stored tables by key; adaptive execution splits a heavy company's partition."""
    fact = materialise(
        filled(
            spark.range(ROWS, numPartitions=8), FACT, job_id=F.col("id"), company_id=F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")),
            job_health_insurance=F.lit(True), job_posted_date=F.lit("2023-05-01"),
        ),
        "fact",
    )
    company = materialise(
        filled(spark.range(ROWS), COMPANY, company_id=F.col("id"), name=F.sha2(F.col("id").cast("string"), 256)), "company"
    )
    star = Star(fact, company, spark.createDataFrame([], SKILL), spark.createDataFrame([], BRIDGE))
    result = calendar.insured_in_quarter(star)
    assert len(result.collect()) == ROWS
    assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()


def test_heavy_group_of_near_duplicates(spark, no_broadcast):
    """A third of all postings in one group, each with its own skills: counted per skill set before the group."""
    heavy = F.col("id") % 3 == 0
    fact = filled(
        spark.range(ROWS, numPartitions=8), FACT, job_id=F.col("id"), company_id=F.lit(1),
        job_title=F.when(heavy, "heavy").otherwise(F.concat(F.lit("t"), F.col("id"))),
    )
    pairs = spark.range(ROWS).select(F.col("id").alias("job_id"), F.explode(F.array(F.col("id") % 1000, F.lit(1000))).alias("skill_id"))
    star = Star(fact, spark.createDataFrame([(1, "c")], COMPANY), spark.createDataFrame([(1, "s")], SKILL), pairs)
    assert as_tuples(quality.near_duplicates(star)) == [(1, ROWS // 3, 1, ROWS // 3)]


def test_heavy_references_are_counted_before_the_lookup(spark, no_broadcast):
    fact = filled(
        spark.range(ROWS, numPartitions=8), FACT, job_id=F.col("id"),
        company_id=F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 100),
    )
    company = filled(spark.range(100), COMPANY, company_id=F.col("id"), name=F.col("id"))
    star = Star(fact, company, spark.createDataFrame([], SKILL), spark.createDataFrame([], BRIDGE))
    report = quality.integrity_report(star).where("violations > 0")
    assert as_tuples(report) == [("foreign key", "job_postings_fact", "company_id", ROWS // 3)]
