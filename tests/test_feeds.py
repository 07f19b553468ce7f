import json
from datetime import datetime

import pytest
from rowtools import as_tuples
from pyspark.sql import functions as F

from postprism.functions.dates import posting_time
from postprism.operators import conform
from postprism.schemas import FACT
from postprism.sources.feeds import feed_audit, read_feeds

A1 = {"data": [
    {"title": " Data Analyst ", "company_name": "Acme", "location": "Berlin", "remote": True, "job_types": ["full", "perm"],
     "created_at": 1700000000, "description": "<p>SQL &amp; Python</p>", "url": "a/1"},
    {"title": "Data Engineer", "company_name": " ", "location": "", "remote": None, "job_types": [],
     "created_at": 1700000001, "description": None, "url": "a/2"},
], "links": {"next": "a?page=2"}}
A2 = {"data": [{"title": "Chef", "company_name": "Food", "remote": False, "description": "cook"}]}
B = {"jobs": [{"jobTitle": "data analyst", "companyName": "ACME", "jobGeo": "EU", "jobType": ["full"],
               "pubDate": "2023-11-15 08:00:00", "jobDescription": "excel", "url": "b/1"},
              {"jobTitle": None, "companyName": "X", "jobDescription": "sql"}]}
C = [{"legal": "notice", "position": "Data Analyst"},
     {"position": "BI Developer", "company": "Gamma", "location": "Remote", "date": "2023-11-14T10:00:00+02:00",
      "description": "power bi, sql.", "url": "c/1"}]
D1 = {"jobs": [{"title": "Analytics Lead", "companyName": None, "locationRestrictions": ["DE", "FR"],
                "employmentType": "Full Time", "pubDate": 1699999999, "description": "no skill", "applicationLink": "d/1"}]}
D2 = {"jobs": []}
SKILLS = [(1, "sql"), (2, "python"), (3, "excel"), (4, "power bi"), (5, "r"), (6, "c")]
NOW = datetime(2024, 3, 1, 9, 30)


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    files = {
        "arbeitnow/page1.json": json.dumps(A1, indent=2),
        "arbeitnow/page2.json": json.dumps(A2),
        "jobicy/data-science/all.json": json.dumps(B),
        "remoteok/all.json": json.dumps(C),
        "himalayas/0.json": json.dumps(D1),
        "himalayas/50.json": json.dumps(D2),
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return {name: str(root / name) for name in ("arbeitnow", "jobicy", "remoteok", "himalayas")}


@pytest.fixture(scope="module")
def records(spark, landed):
    return read_feeds(spark, landed)[0]


def test_nine_fields_in_order_of_arrival(records):
    got = as_tuples(records.orderBy("arrival").drop("arrival"))
    assert got == [
        ("arbeitnow", "Data Analyst", "Acme", "Berlin", True, "full|perm", "1700000000", "SQL & Python", "a/1"),
        ("arbeitnow", "Data Engineer", None, None, False, None, "1700000001", "", "a/2"),
        ("arbeitnow", "Chef", "Food", None, False, None, None, "cook", None),
        ("jobicy", "data analyst", "ACME", "EU", True, "full", "2023-11-15 08:00:00", "excel", "b/1"),
        ("jobicy", None, "X", None, True, None, None, "sql", None),
        ("remoteok", "BI Developer", "Gamma", "Remote", True, None, "2023-11-14T10:00:00+02:00", "power bi, sql.", "c/1"),
        ("himalayas", "Analytics Lead", None, "DE|FR", True, "Full Time", "1699999999", "no skill", "d/1"),
    ]


def test_failing_feeds_are_named_and_the_others_read(spark, landed, tmp_path):
    (tmp_path / "broken.json").write_text("<html>busy</html>")
    paths = {**landed, "jobicy": str(tmp_path / "absent"), "himalayas": str(tmp_path / "broken.json")}
    records, skipped = read_feeds(spark, paths)
    assert skipped == {"jobicy": "PATH_NOT_FOUND", "himalayas": "1 of 1 payloads unreadable"}
    assert {row[0] for row in as_tuples(records, "source")} == {"arbeitnow", "remoteok"}
    assert read_feeds(spark, {"jobicy": str(tmp_path / "absent")})[0] is None
    assert as_tuples(feed_audit(spark, paths)) == [
        ("arbeitnow", 2, 0, 3, None), ("jobicy", 0, 0, 0, "PATH_NOT_FOUND"), ("remoteok", 1, 0, 1, None),
        ("himalayas", 1, 1, 0, None),
    ]
    assert as_tuples(feed_audit(spark, landed).where("source = 'himalayas'")) == [("himalayas", 2, 0, 1, None)]


def test_texts_are_no_sort_keys(spark, records):
    unique = conform.keep_first(conform.role_filter(records), conform.posting_key())
    plan = conform.surrogate_key(unique, "job_id", ["arrival"], unique=True)
    read = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "title" not in "".join(line for line in read.splitlines() if "RepartitionByExpression" in line)


def test_arrival_numbers_do_not_run_over(spark):
    from postprism.sources.feeds import arrival_number

    row = spark.range(1).select(arrival_number(1, F.lit(1 << 28), F.lit(0)).alias("n"))
    with pytest.raises(Exception, match="too many files"):
        row.collect()


def test_posting_dates_are_counted(spark):
    df = spark.createDataFrame([("a", "1700000000"), ("a", "soon"), ("a", " "), ("b", None)], "source string, posted string")
    got = sorted(as_tuples(conform.posting_dates(df), "source", "stated", "readable", "unreadable", "missing"))
    assert got == [("a", 2, 1, 1, 1), ("b", 0, 0, 0, 1)]


def test_conformed_star(spark, records):
    skill = spark.createDataFrame(SKILLS, "skill_id long, skills string")
    star = conform.conform_star(records, skill, NOW)
    assert [f.simpleString() for f in star.fact.schema] == [f.simpleString() for f in FACT]
    fact = as_tuples(
        star.fact.orderBy("job_id"),
        "job_id", "company_id", "job_title_short", "job_title", "job_location", "job_via", "job_schedule_type",
        "job_work_from_home", "search_location", "job_posted_date", "salary_year_avg",
    )
    # The second feed's copy of the first posting is gone; company ids follow first appearance.
    assert fact == [
        (1, 1, "Data Analyst", "Data Analyst", "Anywhere", "arbeitnow", "full|perm", True, "Berlin", NOW, None),
        (2, 2, "Data Engineer", "Data Engineer", None, "arbeitnow", None, False, None, NOW, None),
        (3, 3, "Business Analyst", "BI Developer", "Anywhere", "remoteok", None, True, "Remote", NOW, None),
        (4, 2, "Data Analyst", "Analytics Lead", "Anywhere", "himalayas", "Full Time", True, "DE|FR", NOW, None),
    ]
    assert sorted(as_tuples(star.company)) == [(1, "Acme"), (2, "Unknown"), (3, "Gamma")]
    assert sorted(as_tuples(star.bridge)) == [(1, 1), (1, 2), (3, 1), (3, 4)]
    assert sorted(as_tuples(star.skill)) == SKILLS
    assert as_tuples(conform.coverage_report(star)) == [
        ("postings", 4, None), ("with skills", 2, 50.0), ("with salary", 0, 0.0),
        ("source arbeitnow", 2, None), ("source himalayas", 1, None), ("source remoteok", 1, None),
    ]
    assert as_tuples(conform.conform_funnel(records)) == [("fetched", 7), ("role-matched", 5), ("unique", 4)]


def test_true_posting_date_is_kept_on_request(spark, records):
    skill = spark.createDataFrame(SKILLS, "skill_id long, skills string")
    star = conform.conform_star(records, skill, NOW, keep_posted=True)
    assert [row[0] for row in as_tuples(star.fact.orderBy("job_id"), "job_posted_date")] == [
        datetime(2023, 11, 14, 22, 13, 20), datetime(2023, 11, 14, 22, 13, 21), datetime(2023, 11, 14, 8, 0),
        datetime(2023, 11, 14, 22, 13, 19),
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_posting_time_does_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(
            [("1700000000",), ("1700000000000",), ("2023-11-14T22:13:20Z",), ("2023-11-14 22:13:20",), ("soon",), (None,)], "p string"
        )
        got = [row[0] for row in as_tuples(df.select(posting_time(F.col("p"))))]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [datetime(2023, 11, 14, 22, 13, 20)] * 4 + [None, None]


def test_no_postings_give_no_share(spark, records):
    skill = spark.createDataFrame(SKILLS, "skill_id long, skills string")
    star = conform.conform_star(records.where("false"), skill, NOW)
    assert as_tuples(conform.coverage_report(star)) == [
        ("postings", 0, None), ("with skills", 0, None), ("with salary", 0, None),
    ]


def test_keep_first_with_a_hot_key(spark):
    """A third of all records are copies of one posting, in mixed case and order."""
    rows = spark.range(9000).select(
        F.col("id").alias("arrival"),
        F.when(F.col("id") % 3 == 0, "ACME").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("company"),
        F.when(F.col("id") % 2 == 0, "Data Analyst").otherwise("data analyst").alias("title"),
    )
    kept = conform.keep_first(rows.repartition(7), conform.posting_key())
    assert kept.count() == 6001
    assert as_tuples(kept.where("company = 'ACME'"), "arrival", "title") == [(0, "Data Analyst")]


def test_landed_payloads_are_packed(spark):
    """What is landed takes less room than the texts it holds, and every item is read back."""
    from postprism.sources import feeds, testdata

    folder = "/root/testdata/sf0.001"
    landed = testdata.land_payloads(spark, folder)
    size = {name: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).selectExpr("sum(length)").first()[0] for name, path in landed.items()}
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    assert size["jobicy"] < documents.selectExpr("sum(octet_length(text))").first()[0]
    records, problems = feeds.read_feeds(spark, landed)
    assert not problems and records.where("source = 'jobicy'").count() == documents.count()
