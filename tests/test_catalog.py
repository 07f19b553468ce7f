"""Every registered query against its SQL in another engine, on the smallest tables; and plans."""

import math

import pytest

import __spark_entry__ as entry
from postprism.plans import catalog, demand, pay, quality
from postprism.sources import testdata

duckdb = pytest.importorskip("duckdb")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
PLAIN = catalog.queries()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


@pytest.fixture(scope="module")
def other(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert PLAIN.keys() <= SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, folder, other, name):
    result = QUERIES[name](spark, folder)
    columns = sorted(result.columns)
    cursor = other.execute(SQL[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == columns
    places = [names.index(column) for column in columns]
    expected = sorted(tuple(plain(row[i]) for i in places) for row in cursor.fetchall())
    assert sorted(tuple(plain(value) for value in row) for row in result.select(*columns).collect()) == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize(
    "name",
    ["skill_demand_all", "pay_by_skill", "demand_and_pay", "near_duplicates", "integrity_report", "population_funnel"],
)
def test_no_pairs_are_formed_without_broadcasts(spark, folder, name):
    """With no side small enough to broadcast on its own, joins go by key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = plan_of(demand.skill_demand_all(testdata.star(spark, folder), testdata.MAIN_ROLE))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>" in plan
    assert "struct<l_orderkey:bigint,l_partkey:bigint>" in plan


def test_top_k_is_not_a_full_sort(spark, folder):
    star = testdata.star(spark, folder)
    assert "TakeOrderedAndProject(limit=10" in plan_of(pay.top_paying(star, testdata.MAIN_ROLE))
    assert "TakeOrderedAndProject(limit=10" in plan_of(quality.top_without_skills(star, testdata.MAIN_ROLE))


def test_large_tables_are_shuffled_once_and_by_posting(spark, folder):
    """Without broadcasts: one exchange by posting for the fact and one for the lines, no other pass over either."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = testdata.star(spark, folder)
        plan = plan_of(demand.skill_demand_all(star, testdata.MAIN_ROLE))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(job_id#") == 1
    assert plan.count("Exchange hashpartitioning(l_orderkey#") == 1
    assert plan.count("FileScan parquet [l_orderkey") == 1
    assert plan.count("FileScan parquet [o_orderkey") == 1
