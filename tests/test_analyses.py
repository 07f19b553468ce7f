"""Analyses on a small dataset with ties, gaps and broken references, and on datasets without pay or rows."""

from datetime import datetime
from decimal import Decimal

import pytest
from rowtools import as_tuples
from pyspark.sql import functions as F

from postprism.operators.population import population_funnel, step_size
from postprism.plans import calendar, demand, pay, quality, trend
from postprism.plans.report import write_report
from postprism.schemas import BRIDGE, COMPANY, FACT, SKILL
from postprism.sources import testdata
from postprism.star import Star

DAY = datetime(2023, 6, 2)


def posting(job, company=1, role="Data Analyst", title="t", place="Anywhere", remote=True, posted=DAY, year=None, **more):
    values = dict.fromkeys(FACT.names)
    values.update(
        job_id=job, company_id=company, job_title_short=role, job_title=title, job_location=place, job_via="v",
        job_work_from_home=remote, job_posted_date=posted, salary_year_avg=Decimal(year) if year else None,
    )
    values.update(more)
    return tuple(values[name] for name in FACT.names)


FACTS = [
    posting(1, year="100.00"),
    posting(2, year="300.00"),
    posting(3, company=2, year="300.00", title="u"),
    posting(4, year="200.50", title="dup"),
    posting(5, year="200.50", title="dup"),
    posting(6, title="unpaid"),
    posting(7, title="no skills"),
    posting(8, role="Data Engineer", year="900.00"),
    posting(9, remote=False, place=None, year="800.00"),
    posting(10, remote=False, place="New York, NY"),
    posting(11, remote=False, place="Rome"),
    posting(12, remote=None, place="Anywhere", role=None),
]
COMPANIES = [(1, "Acme"), (2, "Beta"), (3, "Idle")]
SKILLS = [(1, "sql"), (2, "excel"), (3, "unused"), (10, "python")]
PAIRS = [(1, 1), (1, 2), (2, 1), (3, 10), (4, 1), (5, 1), (5, 2), (6, 2), (8, 1), (9, 1)]


def build(spark, facts, pairs=PAIRS, companies=COMPANIES):
    return Star(
        spark.createDataFrame(facts, FACT).repartition(3),
        spark.createDataFrame(companies, COMPANY),
        spark.createDataFrame(SKILLS, SKILL),
        spark.createDataFrame(pairs, BRIDGE).repartition(3),
    )


@pytest.fixture(scope="module")
def star(spark):
    return build(spark, FACTS)


@pytest.fixture(scope="module")
def unpaid(spark, star):
    return star.with_fact(star.fact.withColumn("salary_year_avg", F.lit(None).cast("decimal(12,2)")))


@pytest.fixture(scope="module")
def no_rows(star):
    return star.with_fact(star.fact.where("false"))


def test_top_paying_orders_ties_by_id(star):
    got = as_tuples(pay.top_paying(star, k=3), "job_id", "company_name", "salary_year_avg")
    assert got == [(2, "Acme", 300.0), (3, "Beta", 300.0), (4, "Acme", 200.5)]


def test_demand(star):
    # Postings with skills: 1 to 6 without 7.
    assert as_tuples(demand.skill_demand_all(star)) == [("sql", 4, 66.7), ("excel", 3, 50.0), ("python", 1, 16.7)]
    assert as_tuples(demand.skill_demand_top(star, k=1)) == [("sql", 4, 66.7)]
    assert as_tuples(demand.remote_skill_count(star)) == [(1, "sql", 4), (2, "excel", 3), (10, "python", 1)]
    assert as_tuples(demand.skills_in_top(star, k=3)) == [("sql", 2, 66.7), ("python", 1, 33.3)]


def test_pay(star):
    assert as_tuples(pay.pay_by_skill(star, min_postings=2)) == [("sql", 4, 200.0, 201.0), ("excel", 2, 150.0, 150.0)]
    assert as_tuples(pay.pay_by_skill(star)) == []
    assert as_tuples(pay.demand_and_pay(star, min_postings=1)) == [
        ("sql", 4, 80.0, 200.0, 201.0), ("excel", 2, 40.0, 150.0, 150.0), ("python", 1, 20.0, 300.0, 300.0),
    ]
    assert as_tuples(pay.pay_unguarded(star)) == [("python", 1, 300.0), ("sql", 4, 200.0), ("excel", 2, 150.0)]
    assert as_tuples(pay.pay_distribution(star)) == [(5, 100.0, 200.5, 200.5, 300.0, 300.0)]


def test_outliers(star):
    # Postings 4 and 5 look the same and show once.
    assert as_tuples(pay.salary_outliers(star)) == [
        ("t", "Acme", "v", 300.0, 1.5), ("u", "Beta", "v", 300.0, 1.5), ("dup", "Acme", "v", 200.5, 1.0),
        ("t", "Acme", "v", 100.0, 0.5),
    ]
    assert as_tuples(pay.outlier_effect(star)) == [(5, 220.0, 201.0, 167.0, 300.0)]
    assert as_tuples(pay.outlier_effect(star, cut=200.5)) == [(5, 220.0, 201.0, 100.0, 300.0)]


def test_funnel_and_flags(star):
    assert [row[1] for row in as_tuples(population_funnel(star))] == [12, 10, 7, 5, 6, 5]
    assert as_tuples(quality.flag_equivalence(star)) == [
        (False, False, 2), (False, None, 1), (True, True, 8), (None, True, 1),
    ]
    assert as_tuples(quality.location_buckets(star)) == [(7, "Remote"), (2, "Onsite"), (1, "Local")]


def test_near_duplicates(star):
    # Postings 1, 2, 8 and 12; postings 4 and 5. Both list different skills.
    assert as_tuples(quality.near_duplicates(star)) == [(2, 6, 2, 6)]
    # Postings 4 and 5; postings 10, 11 and 12, which list no skills.
    assert as_tuples(quality.near_duplicates(star, ("salary_year_avg", "job_title"))) == [(2, 5, 1, 2)]


def test_top_without_skills(spark):
    star = build(spark, FACTS, pairs=[(2, 1), (2, 2), (2, 10)])
    assert as_tuples(quality.top_without_skills(star, k=3)) == [("t", 300.0, 3), ("u", 300.0, 0), ("dup", 200.5, 0)]


def test_companies(star):
    counts = as_tuples(quality.company_counts(star))
    assert counts == [("Acme", 11), ("Beta", 1), ("Idle", None)]
    degree = star.with_fact(star.fact.withColumn("job_no_degree_mention", F.col("job_id") == 3))
    assert as_tuples(quality.companies_without_degree(degree)) == [(2, "Beta")]


def test_integrity_counts_violations(spark):
    facts = [*FACTS, posting(1), posting(20, company=99), posting(21, company=99)]
    star = build(spark, facts, pairs=[*PAIRS, (1, 1), (77, 1), (1, 55)], companies=[*COMPANIES, (3, "Twice")])
    report = {tuple(row[:3]): row[3] for row in as_tuples(quality.integrity_report(star))}
    assert {key: n for key, n in report.items() if n} == {
        ("primary key", "company_dim", "company_id"): 1,
        ("primary key", "job_postings_fact", "job_id"): 1,
        ("primary key", "skills_job_dim", "job_id, skill_id"): 1,
        ("foreign key", "job_postings_fact", "company_id"): 2,
        ("foreign key", "skills_job_dim", "job_id"): 1,
        ("foreign key", "skills_job_dim", "skill_id"): 1,
    }


def test_without_pay_the_pay_questions_are_empty_and_the_others_are_not(unpaid):
    for empty in (pay.top_paying, pay.pay_by_skill, pay.demand_and_pay, pay.pay_unguarded, pay.salary_outliers,
                  demand.skills_in_top, quality.top_without_skills):
        assert as_tuples(empty(unpaid)) == []
    assert as_tuples(pay.outlier_effect(unpaid)) == [(0, None, None, None, None)]
    assert as_tuples(pay.outlier_effect(unpaid, cut=5.0)) == [(0, None, None, None, None)]
    assert as_tuples(pay.pay_distribution(unpaid)) == [(0, None, None, None, None, None)]
    assert len(as_tuples(demand.skill_demand_all(unpaid))) == 3
    assert [row[1] for row in as_tuples(population_funnel(unpaid))] == [12, 10, 7, 0, 6, 0]


def test_without_rows(no_rows):
    assert [row[1] for row in as_tuples(population_funnel(no_rows))] == [0] * 6
    assert as_tuples(demand.skill_demand_all(no_rows)) == []
    assert as_tuples(demand.demand_leaders(demand.skill_demand_all(no_rows))) == []
    assert as_tuples(demand.compare_demand(no_rows, no_rows)) == []
    assert as_tuples(quality.near_duplicates(no_rows)) == [(0, None, 0, None)]
    assert as_tuples(pay.quadrants(pay.demand_and_pay(no_rows))) == []
    assert as_tuples(trend.demand_trend(no_rows)) == []


def test_comparison_of_two_datasets(star, unpaid):
    newer = unpaid.with_fact(unpaid.fact.where("job_id in (3, 6, 7)"))
    got = as_tuples(demand.compare_demand(star, newer, excluded=("sql",)))
    assert got == [("excel", 3, 1, 50.0, 50.0, 50.0, 6, 2), ("python", 1, 1, 16.7, 50.0, 50.0, 6, 2)]
    for side, size in ((star, 6), (newer, 2)):
        assert as_tuples(step_size(population_funnel(side), "data analyst, remote, with skills")) == [(size,)]


def test_calendar(spark):
    facts = [
        posting(1, posted=datetime(2023, 1, 31, 23), year="70000.01", job_schedule_type="Full"),
        posting(2, posted=datetime(2022, 3, 1), year="70000.00", job_schedule_type="Full"),
        posting(3, posted=datetime(2023, 4, 1), year="80000.00", job_health_insurance=True),
        posting(4, posted=datetime(2023, 6, 30), company=2, job_health_insurance=True, salary_hour_avg=Decimal("20.50")),
        posting(5, posted=datetime(2023, 6, 1), company=2, job_health_insurance=True, salary_hour_avg=Decimal("30.00")),
    ]
    star = build(spark, facts)
    assert [row[4] for row in as_tuples(calendar.quarter_top(star.fact))] == [70000.01]
    assert sorted(as_tuples(calendar.avg_by_schedule(star)), key=str) == [(None, None, 20.5)]
    assert as_tuples(calendar.insured_in_quarter(star)) == [("Acme", True, 2), ("Beta", True, 2), ("Beta", True, 2)]
    assert as_tuples(calendar.insured_by_company(star)) == [("Acme", 1, 2), ("Beta", 2, 2)]
    assert as_tuples(calendar.postings_per_month(star.fact)) == [(1, 1), (2, 1), (3, 1), (5, 1), (6, 1)]
    assert calendar.month_union(star.fact).count() == 2


def test_month_folders_are_pruned(spark, star, tmp_path):
    path = str(tmp_path / "months")
    calendar.write_by_month(star.fact, path)
    stored = spark.read.parquet(path)
    june = calendar.month_partition(stored, 6)
    assert june.count() == len(FACTS) and calendar.month_partition(stored, 1).count() == 0
    plan = june._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(posted_month" in plan
    assert calendar.quarter_top(stored, above=1, months=(6,)).count() == 6
    assert calendar.month_union(stored, months=(5, 6, 7)).count() == len(FACTS)


def test_invariants(spark, folder):
    star, role = testdata.star(spark, folder), testdata.MAIN_ROLE
    sizes = [row[1] for row in as_tuples(population_funnel(star, role))]
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] >= sizes[5] and sizes[2] >= sizes[4] >= sizes[5]
    assert sum(row[2] for row in as_tuples(quality.flag_equivalence(star))) == sizes[0]
    everything = as_tuples(demand.skill_demand_all(star, role))
    assert as_tuples(demand.skill_demand_top(star, role)) == everything[:10]
    # Pairs are unique: counting rows is counting distinct postings.
    direct = (
        star.fact.where((F.col("job_title_short") == role) & F.col("job_work_from_home"))
        .join(star.bridge, "job_id").join(star.skill, "skill_id")
        .groupBy("skills").agg(F.count_distinct("job_id"))
    )
    assert dict(as_tuples(direct)) == {row[0]: row[1] for row in everything}
    listed = sum(row[2] > 0 for row in as_tuples(quality.top_without_skills(star, role)))
    top = as_tuples(demand.skills_in_top(star, role))
    assert all(share == round(100 * n / listed, 1) for _, n, share in top)
    best = {row[0] for row in as_tuples(pay.pay_by_skill(star, role, min_postings=2, k=1000))}
    assert best == {row[0] for row in as_tuples(pay.demand_and_pay(star, role, min_postings=2, k=1000))}


def test_one_report_for_any_dataset(star, unpaid, tmp_path):
    paid = write_report(star, str(tmp_path / "paid"))
    assert len(paid) == 13
    # Too few postings for the pay floor; every other table has rows.
    assert {name for name, filled in paid.items() if not filled} == {"pay_by_skill", "demand_and_pay"}
    filled = {name for name, rows in write_report(unpaid, str(tmp_path / "unpaid")).items() if rows}
    assert filled == {
        "skill_demand_top", "skill_demand_all", "population_funnel", "flag_equivalence", "outlier_effect", "near_duplicates",
    }
