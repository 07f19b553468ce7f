from datetime import datetime
from decimal import Decimal

import pytest
from rowtools import as_tuples
from pyspark.sql import functions as F

from postprism.operators import prepare
from postprism.plans.quality import integrity_report
from postprism.schemas import FACT, WIDE
from postprism.sources.postings import read_postings_csv, read_star, run_catalog, save_star_tables, write_star

HEADER = ",".join(WIDE.names)
T1, T2 = datetime(2023, 1, 5, 10, 0), datetime(2023, 2, 1, 0, 0)


def row(title, company="Acme", skills="['sql', 'power bi']", posted=T1, schedule="Full-time", pay=None, place="Anywhere"):
    return (
        "Data Analyst", title, place, "board", schedule, True, "US", posted, False, None, "US",
        "year" if pay else None, Decimal(pay) if pay else None, None, company, skills,
    )


ROWS = [
    row("A"),
    row("A"),  # equal in every column
    row("A", schedule="Part-time"),  # equal on the leading key columns only
    row("B", company=None),
    row("C", skills=None),
    row("D", skills="[]"),
    row("E", skills="['r']", posted=T2, pay="100000.50"),
    row("F", skills="['sql', 'sql', ' excel ']", company="Beta"),
    row("G", skills="['only nameless']", company=None),
    row("H", company="acme", posted=None, place=None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, WIDE).repartition(4)


@pytest.fixture(scope="module")
def built(rows):
    return prepare.build_star(rows)


def test_keys_have_gaps_where_a_company_is_missing(built):
    star, postings = built
    keyed = sorted(as_tuples(postings, "job_id", "job_title", "job_schedule_type"))
    assert keyed == [
        (1, "A", "Full-time"), (2, "A", "Part-time"), (3, "B", "Full-time"), (4, "C", "Full-time"),
        (5, "D", "Full-time"), (6, "F", "Full-time"), (7, "G", "Full-time"), (8, "E", "Full-time"), (9, "H", "Full-time"),
    ]
    assert sorted(row[0] for row in as_tuples(star.fact, "job_id")) == [1, 2, 4, 5, 6, 8, 9]


def test_dimensions(built):
    star, _ = built
    assert sorted(as_tuples(star.company)) == [(1, "Acme"), (2, "Beta"), (3, "acme")]
    # A skill of a dropped posting stays in the dimension.
    assert sorted(as_tuples(star.skill)) == [(1, "excel"), (2, "only nameless"), (3, "power bi"), (4, "r"), (5, "sql")]


def test_bridge_and_fact(built):
    star, _ = built
    assert sorted(as_tuples(star.bridge)) == [
        (1, 3), (1, 5), (2, 3), (2, 5), (6, 1), (6, 5), (8, 4), (9, 3), (9, 5),
    ]
    assert [f.simpleString() for f in star.fact.schema] == [f.simpleString() for f in FACT]
    assert as_tuples(star.fact.where("job_id = 8"), "salary_year_avg") == [(Decimal("100000.50"),)]


def test_single_steps_give_the_same_star(rows, built):
    star, _ = built
    keyed = prepare.key_postings(prepare.full_row_dedup(rows))
    pairs = prepare.explode_skills(keyed)
    assert pairs.where("skills = 'sql' and job_id = 6").count() == 2
    company, skill = prepare.company_dimension(keyed), prepare.skill_dimension(pairs)
    fact = prepare.build_fact(keyed, company)
    bridge = prepare.build_bridge(keyed, skill, fact)
    for mine, other in ((fact, star.fact), (bridge, star.bridge), (company, star.company), (skill, star.skill)):
        assert sorted(map(str, as_tuples(mine))) == sorted(map(str, as_tuples(other)))


def test_audit_span_and_integrity(rows, built):
    star, postings = built
    assert dict(as_tuples(prepare.load_audit(rows, postings, star))) == {
        "source rows": 10,
        "with rejected values": 0,
        "duplicates removed": 1,
        "no company, dropped": 2,
        "company_dim": 3,
        "skills_dim": 5,
        "job_postings_fact": 7,
        "skills_job_dim": 9,
    }
    assert as_tuples(prepare.date_span(star.fact)) == [(T1.date(), T2.date())]
    report = integrity_report(star)
    assert report.count() == 15
    assert report.where("violations > 0").count() == 0


def test_csv_with_quotes_commas_and_line_breaks(spark, tmp_path):
    text = (
        f"{HEADER}\n"
        'Data Analyst,"Analyst, ""senior""",Anywhere,board,Full-time,True,US,2023-01-05 10:00:00,False,,US,year,'
        "90000.0,,Acme,\"['sql', 'power bi']\"\n"
        'Data Analyst,"two\nlines",,,,False,,2023-02-01 00:00:00,,,,,,45.5,Beta,\n'
    )
    (tmp_path / "rows.csv").write_text(text)
    got = as_tuples(
        read_postings_csv(spark, str(tmp_path / "rows.csv")).orderBy("company_name"),
        "job_title", "job_location", "job_work_from_home", "job_posted_date", "salary_year_avg", "salary_hour_avg", "job_skills",
    )
    assert got == [
        ('Analyst, "senior"', "Anywhere", True, T1, Decimal("90000.00"), None, "['sql', 'power bi']"),
        ("two\nlines", None, False, T2, None, Decimal("45.50"), None),
    ]


def test_csv_columns_go_by_name_and_none_is_lost(spark, tmp_path):
    header = ["note", *reversed(WIDE.names)]
    values = {"job_title": "T", "company_name": "Acme", "job_posted_date": "soon", "salary_year_avg": "$90000", "salary_hour_avg": "45.555"}
    lines = [",".join(header)]
    for note in ("a", "b", "b"):
        lines.append(",".join(values.get(name, note if name == "note" else "") for name in header))
    (tmp_path / "rows.csv").write_text("\n".join(lines) + "\n")
    for multi_line in (True, False):
        read = read_postings_csv(spark, str(tmp_path / "rows.csv"), multi_line=multi_line)
        assert read.columns == [*WIDE.names, "note", "_rejected"]
        distinct = prepare.full_row_dedup(read)
        assert distinct.count() == 2
        got = as_tuples(distinct, "job_title", "company_name", "job_posted_date", "salary_year_avg", "salary_hour_avg", "_rejected")
        assert got == [("T", "Acme", None, None, Decimal("45.5550000000"), '{"job_posted_date":"soon","salary_year_avg":"$90000"}')] * 2
        star, postings = prepare.build_star(read)
        assert as_tuples(star.fact, "salary_hour_avg") == [(Decimal("45.56"),)] * 2
        assert dict(as_tuples(prepare.load_audit(read, postings, star)))["with rejected values"] == 3


def test_csv_files_of_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "1.csv").write_text("job_title,job_via\na,b\n")
    (tmp_path / "2.csv").write_text("job_via,job_title\nb,a\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_postings_csv(spark, str(tmp_path), multi_line=False).collect()


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_written_star_reads_back(spark, built, tmp_path, format):
    star, _ = built
    write_star(star, str(tmp_path / "star"), format)
    again = read_star(spark, str(tmp_path / "star"), format)
    for name, table in star.tables().items():
        assert sorted(map(str, as_tuples(again.tables()[name]))) == sorted(map(str, as_tuples(table))), name


def test_bucketed_tables_join_without_a_shuffle(spark, built):
    star, _ = built
    saved = save_star_tables(star, "default", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = saved.fact.select("job_id", "job_title").join(saved.bridge, "job_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_catalog_run_writes_a_header_for_empty_results(built, tmp_path):
    star, _ = built
    analyses = {
        "titles": lambda s: s.fact.select("job_title").orderBy("job_title"),
        "nothing": lambda s: s.fact.select("job_title").where(F.lit(False)),
    }
    assert run_catalog(star, analyses, str(tmp_path / "out")) == {"titles": True, "nothing": False}
    files = [path.read_text() for path in (tmp_path / "out" / "nothing").glob("part-*.csv")]
    assert files == ["job_title\n"]


def test_load_reads_its_source_once_and_no_table_back(spark, rows, tmp_path):
    """The counts are those of the tables, and each source row passes by once."""
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    source = rows.mapInArrow(count, rows.schema)
    audit = prepare.load_star(source, lambda star: write_star(star, str(tmp_path / "star")))
    assert passed.value == len(ROWS)
    star, postings = prepare.build_star(rows)
    assert sorted(as_tuples(audit)) == sorted(as_tuples(prepare.load_audit(rows, postings, star)))
    stored = read_star(spark, str(tmp_path / "star"))
    assert {name: table.count() for name, table in stored.tables().items()} == {
        row.metric: row["rows"] for row in audit.collect() if row.metric in stored.tables()
    }


def test_load_of_nothing(spark, tmp_path):
    audit = prepare.load_star(spark.createDataFrame([], WIDE), lambda star: write_star(star, str(tmp_path / "star")))
    assert audit.count() == 8 and audit.where("rows <> 0").count() == 0
