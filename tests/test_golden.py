"""Results recomputed from published result tables."""

from pathlib import Path

import pytest
from rowtools import as_tuples

from postprism.plans.demand import compare_tables, demand_leaders
from postprism.plans.pay import quadrants
from pyspark.sql import functions as F

# A published demand-and-pay table: skill, postings, demand_pct, avg_salary, med_salary.
DEMAND_AND_PAY = """
sql,401,65.8,97224.0,90000
excel,261,42.9,86921.0,82500
python,236,38.8,101265.0,95000
tableau,233,38.3,98994.0,92500
r,147,24.1,99906.0,90000
power bi,111,18.2,97384.0,95000
sas,62,10.2,98481.0,94000
powerpoint,58,9.5,88960.0,85000
looker,50,8.2,103169.0,95000
word,48,7.9,82628.0,83500
oracle,38,6.2,103493.0,99873
snowflake,37,6.1,112948.0,106479
sql server,36,5.9,97083.0,95000
azure,33,5.4,112474.0,105000
aws,32,5.3,108708.0,104000
sheets,32,5.3,86088.0,81250
go,27,4.4,115320.0,104300
flow,27,4.4,98207.0,95000
vba,25,4.1,88232.0,76559
spss,24,3.9,92170.0,84250
"""

GOLDEN = Path(__file__).parent / "golden"


def rows(text):
    cells = [line.split(",") for line in text.strip().splitlines()]
    return [(row[0], int(row[1]), *map(float, row[2:])) for row in cells]


def test_quadrants(spark):
    table = spark.createDataFrame(
        rows(DEMAND_AND_PAY), "skill string, postings long, demand_pct double, avg_salary double, med_salary double"
    )
    got = {}
    for skill, quadrant, demand_split, pay_split in as_tuples(
        quadrants(table), "skill", "quadrant", "demand_split", "pay_split"
    ):
        got.setdefault(quadrant, set()).add(skill)
        assert (demand_split, pay_split) == (43.0, 98344.0)
    assert got == {
        "High demand, high pay": {"python", "tableau", "r", "sas", "looker"},
        "High demand, lower pay": {"sql", "excel", "power bi", "powerpoint", "word"},
        "Niche, high pay": {"oracle", "snowflake", "azure", "aws", "go"},
        "Niche, lower pay": {"sql server", "sheets", "flow", "vba", "spss"},
    }


@pytest.fixture(scope="module")
def demand(spark):
    # Two published demand tables, whole.
    schema = "skill string, postings long, share_of_pct double"
    texts = [(GOLDEN / f"skill_demand_{name}.csv").read_text().split("\n", 1)[1] for name in ("base", "new")]
    assert [len(rows(text)) for text in texts] == [201, 33]
    return [spark.createDataFrame(rows(text), schema) for text in texts]


def test_comparison(demand):
    merged = compare_tables(*demand)
    assert merged.count() == 185
    top = merged.orderBy(F.desc("rank_on"), "skill").limit(10)
    assert [row[0] for row in as_tuples(top, "skill")] == [
        "sql", "python", "excel", "tableau", "looker", "power bi", "bigquery", "airflow", "git", "snowflake",
    ]
    shares = {row[0]: row[1:] for row in as_tuples(merged, "skill", "postings_base", "share_base", "share_new")}
    assert "r" not in shares and "sas" not in shares and "sheets" not in shares
    assert shares["airflow"] == (225, 2.0, 18.5)
    assert shares["spark"] == (361, 3.1, 0.0)


def test_leaders(demand):
    got = as_tuples(demand_leaders(demand[0]).where("is_leader"), "skill", "is_top", "leaders")
    assert sorted(got) == [("excel", False, 4), ("python", False, 4), ("sql", True, 4), ("tableau", False, 4)]
