"""Denormalised rows to star schema."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postprism.operators.keys import surrogate_key
from postprism.operators.lookup import lookup_join
from postprism.operators.population import with_scalar
from postprism.schemas import FACT, POSTING_COLUMNS
from postprism.star import Star

# Leading sort columns of the posting key; all other columns break ties.
POSTING_ORDER = (
    "job_posted_date",
    "job_title_short",
    "job_title",
    "company_name",
    "job_location",
    "job_via",
    "salary_year_avg",
    "job_skills",
)


def full_row_dedup(rows: DataFrame) -> DataFrame:
    """One copy of rows equal in every column; repeats are dropped map-side before the shuffle."""
    return rows.distinct()


def key_postings(rows: DataFrame, observed: Observation | None = None) -> DataFrame:
    """Distinct rows with a dense, repeatable ``job_id``. Rows without a company keep theirs: ids may have gaps later.

    ``observed`` takes the number of rows (``kept``) and of those without a company (``nameless``) while the rows are placed.
    """
    measures = [F.count(F.lit(1)).alias("kept"), F.count_if(F.col("company_name").isNull()).alias("nameless")]
    return surrogate_key(rows, "job_id", POSTING_ORDER, observed=(observed, measures) if observed else None)


def company_dimension(postings: DataFrame) -> DataFrame:
    """Distinct company names, keyed in name order."""
    names = postings.where(F.col("company_name").isNotNull()).select(F.col("company_name").alias("name")).distinct()
    return surrogate_key(names, "company_id", ["name"])


def _items(listing: Column) -> Column:
    """Items of a list written as text: brackets and quotes go, commas split, blanks and empties go."""
    parts = F.split(F.translate(listing, "[]'", ""), ",")
    return F.filter(F.transform(parts, lambda item: F.trim(item)), lambda item: item != "")


def explode_skills(postings: DataFrame, unique: bool = False) -> DataFrame:
    """One row per posting and listed skill; ``unique`` drops repeats inside a posting's own list, without a shuffle."""
    items = _items(F.col("job_skills"))
    return postings.select("job_id", F.explode(F.array_distinct(items) if unique else items).alias("skills"))


def skill_dimension(pairs: DataFrame) -> DataFrame:
    """Distinct skill names of all postings, also of those not loaded, keyed in name order."""
    return surrogate_key(pairs.select("skills").distinct(), "skill_id", ["skills"])


def build_fact(postings: DataFrame, company: DataFrame) -> DataFrame:
    """Postings with their company id; those without a company drop out.

    A company may hold a third of all postings, hence the lookup join.
    """
    named = company.select("company_id", F.col("name").alias("company_name"))
    columns = [F.col(field.name).cast(field.dataType).alias(field.name) for field in FACT]
    return lookup_join(postings.select("job_id", "company_name", *POSTING_COLUMNS), named, "company_name").select(*columns)


def build_bridge(postings: DataFrame, skill: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    """Unique (posting, skill) ids; with ``fact`` only of the postings it holds.

    Postings are filtered before their lists are decoded, and repeats lie inside one posting's own list, so the
    many pairs are neither shuffled nor compared. Names are unique in the skill dimension.
    """
    lists = postings.select("job_id", "job_skills")
    if fact is not None:
        lists = lists.join(fact.select("job_id"), "job_id", "left_semi")
    return lookup_join(explode_skills(lists, unique=True), skill, "skills").select("job_id", "skill_id")


def build_star(rows: DataFrame, observed: Observation | None = None) -> tuple[Star, DataFrame]:
    """Star of denormalised rows, and the keyed postings it came from.

    Loaded postings are those with a company name, which spares the bridge a join with the fact. ``observed``: see :func:`key_postings`.
    """
    postings = key_postings(full_row_dedup(rows), observed)
    company = company_dimension(postings)
    skill = skill_dimension(explode_skills(postings))
    bridge = build_bridge(postings.where(F.col("company_name").isNotNull()), skill)
    return Star(build_fact(postings, company), company, skill, bridge), postings


def _source_measures(rows: DataFrame) -> list[Column]:
    rejected = F.col("_rejected").isNotNull() if "_rejected" in rows.columns else F.lit(False)
    return [F.count(F.lit(1)).alias("_source"), F.count_if(rejected).alias("_rejected")]


def load_audit(rows: DataFrame, postings: DataFrame, star: Star) -> DataFrame:
    """Row counts of a load from its tables, as they are now: metric, rows. Each table is scanned; :func:`load_star` counts while writing."""
    source = rows.agg(*_source_measures(rows))
    kept = postings.agg(F.count(F.lit(1)).alias("_kept"), F.count_if(F.col("company_name").isNull()).alias("_nameless"))
    # Metric names.
    first = with_scalar(source, kept).select(
        F.stack(
            F.lit(4),
            F.lit("source rows"),
            F.col("_source"),
            F.lit("with rejected values"),
            F.col("_rejected"),
            F.lit("duplicates removed"),
            F.col("_source") - F.col("_kept"),
            F.lit("no company, dropped"),
            F.col("_nameless"),
        ).alias("metric", "rows")
    )
    counts = [
        table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("metric"), "rows")
        for name, table in star.tables().items()
    ]
    return reduce(DataFrame.unionByName, counts, first)


def observed(measures: Observation) -> defaultdict[str, int]:
    """The counts that were taken; all are zero where the optimiser saw that there are no rows, as nothing is run and observed then."""
    try:
        return defaultdict(int, measures.get)
    except Py4JJavaError:
        return defaultdict(int)


def load_star(rows: DataFrame, write: Callable[[Star], None]) -> DataFrame:
    """Build a star, hand it to ``write``, and return the row counts of the load: metric, rows.

    All counts are observed on rows that pass by anyway: the source before its duplicates go, the postings while they are keyed,
    each table while it is written. So the source is read once and no stored table is read back. The source's counts come from
    a stage before a shuffle: if a lost executor's part of it is run again, its rows count again. :func:`load_audit` does not have that.
    """
    source, kept = Observation(), Observation()
    star, _ = build_star(rows.observe(source, *_source_measures(rows)), kept)
    tables = {name: Observation() for name in star.tables()}
    counted = [table.observe(tables[name], F.count(F.lit(1)).alias("rows")) for name, table in star.tables().items()]
    company, skill, fact, bridge = counted
    write(Star(fact, company, skill, bridge))
    read, placed = observed(source), observed(kept)
    # Metric names.
    found = {
        "source rows": read["_source"],
        "with rejected values": read["_rejected"],
        "duplicates removed": read["_source"] - placed["kept"],
        "no company, dropped": placed["nameless"],
    }
    found |= {name: observed(table)["rows"] for name, table in tables.items()}
    return rows.sparkSession.createDataFrame(list(found.items()), "metric string, rows bigint")


def date_span(fact: DataFrame) -> DataFrame:
    """First and last posting date, one row."""
    return fact.agg(
        F.min("job_posted_date").cast("date").alias("first_date"), F.max("job_posted_date").cast("date").alias("last_date")
    )
