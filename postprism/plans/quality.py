"""Checks behind the figures: flags, missing skills, near-duplicates, integrity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postprism.operators.population import MAIN_ROLE
from postprism.plans.pay import few, top_paid
from postprism.star import Star

# Postings alike on these columns are near-duplicates.
ALIKE = ("job_title", "company_id", "job_location", "job_via", "job_posted_date")


def flag_equivalence(star: Star, anywhere: str = "Anywhere") -> DataFrame:
    """Cross table of the remote flag and the location text; an unknown location is its own group."""
    return (
        star.fact.groupBy("job_work_from_home", (F.col("job_location") == anywhere).alias("location_is_anywhere"))
        .agg(F.count(F.lit(1)).alias("postings"))
        .orderBy(F.asc_nulls_last("job_work_from_home"), F.asc_nulls_last("location_is_anywhere"))
    )


def top_without_skills(star: Star, role: str = MAIN_ROLE, k: int = 10) -> DataFrame:
    """The k best-paid postings with their number of skills, 0 included.

    The k ids are broadcast to the bridge, so the bridge is scanned, not shuffled.
    """
    top = top_paid(star, role, k).select("job_id", "job_title", "salary_year_avg")
    listed = (
        star.bridge.join(few(top.select("job_id"), k), "job_id")
        .groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("_listed"))
    )
    return (
        top.join(listed, "job_id", "left")
        .orderBy(F.desc("salary_year_avg"), F.asc("job_id"))
        .select(
            "job_title",
            F.col("salary_year_avg").cast("double").alias("salary_year_avg"),
            F.coalesce("_listed", F.lit(0)).cast("bigint").alias("skills_listed"),
        )
    )


def near_duplicates(star: Star, alike: Sequence[str] = ALIKE) -> DataFrame:
    """Groups of postings alike on some columns, and how many of them disagree on skills; one row.

    Only postings of groups with more than one have their skills gathered: as a rule few. They are first counted per
    (group, skill set): a group that holds a third of all postings is spread over its skill sets and combined map-side
    before the groups are counted.
    """
    repeated = star.fact.groupBy(*alike).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
    repeated = repeated.select(*[F.col(name).alias(f"_{name}") for name in alike])
    together = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in alike])
    fact = star.fact.select("job_id", *alike).join(repeated, together, "left_semi")
    sets = star.bridge.join(fact.select("job_id"), "job_id", "left_semi").groupBy("job_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("skill_id")), lambda c: c.cast("string")), ",").alias("_set")
    )
    same = (
        fact.join(sets, "job_id", "left")
        .groupBy(*alike, F.coalesce("_set", F.lit("")).alias("_set"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    groups = (
        same.groupBy(*alike)
        .agg(F.sum("_rows").alias("_rows"), F.count(F.lit(1)).alias("_sets"))
        .where(F.col("_rows") > 1)
    )
    differ = F.col("_sets") > 1
    return groups.agg(
        F.count(F.lit(1)).alias("near_duplicate_groups"),
        F.sum("_rows").alias("near_duplicate_postings"),
        F.count_if(differ).alias("groups_with_differing_skills"),
        F.sum(F.when(differ, F.col("_rows"))).alias("postings_with_differing_skills"),
    )


# Keys, references and required columns of the star.
PRIMARY_KEYS = {
    "company_dim": ("company_id",),
    "skills_dim": ("skill_id",),
    "job_postings_fact": ("job_id",),
    "skills_job_dim": ("job_id", "skill_id"),
}
FOREIGN_KEYS = (
    ("job_postings_fact", "company_id", "company_dim"),
    ("skills_job_dim", "job_id", "job_postings_fact"),
    ("skills_job_dim", "skill_id", "skills_dim"),
)
REQUIRED = {
    "company_dim": ("company_id", "name"),
    "skills_dim": ("skill_id", "skills"),
    "job_postings_fact": ("job_id", "company_id"),
    "skills_job_dim": ("job_id", "skill_id"),
}


def integrity_report(star: Star) -> DataFrame:
    """Violations of the declared keys: check, table_name, column_name, violations.

    primary key: keys that occur more than once; foreign key: rows whose reference resolves nowhere;
    not null: rows with a missing value. References are counted per value before they are looked up,
    so a company on a third of all postings is one row in the join.
    """
    tables = star.tables()
    checks = []
    for name, key in PRIMARY_KEYS.items():
        repeated = tables[name].groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
        checks.append(_check(repeated.agg(F.count(F.lit(1)).alias("violations")), "primary key", name, ", ".join(key)))
    for name, column, target in FOREIGN_KEYS:
        used = tables[name].groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
        lost = used.join(tables[target].select(column), column, "left_anti")
        # A missing reference is a matter of the not-null check.
        total = F.coalesce(F.sum(F.when(F.col(column).isNotNull(), F.col("_rows"))), F.lit(0)).alias("violations")
        checks.append(_check(lost.agg(total), "foreign key", name, column))
    for name, columns in REQUIRED.items():
        nulls = tables[name].agg(*[F.count_if(F.col(column).isNull()).alias(column) for column in columns])
        pairs = [item for column in columns for item in (F.lit(column), F.col(column))]
        rows = nulls.select(F.stack(F.lit(len(columns)), *pairs).alias("column_name", "violations"))
        checks.append(
            rows.select(F.lit("not null").alias("check"), F.lit(name).alias("table_name"), "column_name", "violations")
        )
    return reduce(DataFrame.unionByName, checks)


def _check(one_row: DataFrame, check: str, table: str, column: str) -> DataFrame:
    return one_row.select(
        F.lit(check).alias("check"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "violations"
    )


def location_buckets(
    star: Star, role: str = MAIN_ROLE, remote: str = "Anywhere", local: str = "New York, NY"
) -> DataFrame:
    """Postings of a role by remote, local and on-site; an unknown location counts as on-site."""
    bucket = (
        F.when(F.col("job_location") == remote, "Remote")
        .when(F.col("job_location") == local, "Local")
        .otherwise("Onsite")
    )
    return (
        star.fact.where(F.col("job_title_short") == role)
        .groupBy(bucket.alias("location_category"))
        .agg(F.count("job_id").alias("number_of_jobs"))
        .select("number_of_jobs", "location_category")
        .orderBy(F.desc("number_of_jobs"), F.asc("location_category"))
    )


def companies_without_degree(star: Star) -> DataFrame:
    """Companies with at least one posting that asks for no degree.

    Ids are made distinct before the semi-join, so a heavy company travels once per task.
    """
    ids = star.fact.where(F.col("job_no_degree_mention")).select("company_id").distinct()
    return (
        star.company.join(ids, "company_id", "left_semi")
        .select("company_id", F.col("name").alias("company_name"))
        .orderBy(F.asc("company_name"), F.asc("company_id"))
    )


def company_counts(star: Star) -> DataFrame:
    """Postings per company, counted before the join; companies without postings stay with NULL."""
    counts = star.fact.groupBy("company_id").agg(F.count(F.lit(1)).alias("total_jobs"))
    return (
        star.company.join(counts, "company_id", "left")
        .select(F.col("name").alias("company_name"), "total_jobs")
        .orderBy(F.desc_nulls_last("total_jobs"), F.asc("company_name"))
    )
