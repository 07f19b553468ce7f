"""Calendar analyses and the month-partitioned layout."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postprism.functions.dates import part, shifted
from postprism.functions.measures import cents, mean_money
from postprism.operators.population import MAIN_ROLE
from postprism.operators.table_changes import update_by_key
from postprism.session import materialise
from postprism.star import Star

FIRST_QUARTER = (1, 2, 3)


def avg_by_schedule(star: Star, after: str = "2023-06-01") -> DataFrame:
    """Mean yearly and hourly pay per schedule type of postings after a date; unknown is its own group."""
    since = F.lit(f"{date.fromisoformat(after)} 00:00:00").cast("timestamp_ntz")
    paid = star.fact.where(F.col("job_posted_date") > since).select(
        "job_schedule_type", cents("salary_year_avg").alias("year"), cents("salary_hour_avg").alias("hour")
    )
    sums = paid.groupBy("job_schedule_type").agg(
        F.sum("year").alias("year"), F.count("year").alias("n_year"), F.sum("hour").alias("hour"), F.count("hour").alias("n_hour")
    )
    return sums.select(
        "job_schedule_type",
        mean_money(F.col("year"), F.col("n_year")).alias("avg_salary_year"),
        mean_money(F.col("hour"), F.col("n_hour")).alias("avg_salary_hour"),
    )


def postings_per_month(postings: DataFrame, posted: str = "job_posted_date", zone: str = "America/New_York") -> DataFrame:
    """Rows per calendar month of the local time in a zone."""
    return (
        postings.groupBy(part("MONTH", shifted(F.col(posted), zone)).alias("job_posted_month"))
        .agg(F.count(F.lit(1)).alias("job_count"))
        .orderBy(F.asc_nulls_last("job_posted_month"))
    )


def first_rows(postings: DataFrame, columns: Sequence[str], order_by: Sequence[str], k: int = 10) -> DataFrame:
    """A look at the first k rows in a stated order."""
    return postings.select(*columns).orderBy(*[F.asc_nulls_last(name) for name in order_by]).limit(k)


def date_parts(postings: DataFrame, posted: str = "job_posted_date", zone: str = "EST") -> DataFrame:
    """The rows with local time in a zone and week, month and year of the recorded time."""
    ts = F.col(posted)
    return postings.select(
        "*",
        shifted(ts, zone).alias("date_time"),
        part("WEEK", ts).alias("date_week"),
        part("MONTH", ts).alias("date_month"),
        part("YEAR", ts).alias("date_year"),
    )


def _insured(star: Star, quarter: int) -> DataFrame:
    return star.fact.where(F.col("job_health_insurance") & (F.quarter("job_posted_date") == quarter))


def insured_in_quarter(star: Star, quarter: int = 2) -> DataFrame:
    """Postings with health insurance in a quarter of any year, one row per posting, by company name."""
    return (
        _insured(star, quarter)
        .select("company_id", "job_health_insurance", part("QUARTER", F.col("job_posted_date")).alias("job_posted_quarter"))
        .join(star.company, "company_id")
        .select("name", "job_health_insurance", "job_posted_quarter")
        .orderBy("name")
    )


def insured_by_company(star: Star, quarter: int = 2) -> DataFrame:
    """The same, counted per company: the ids are counted before the names are joined."""
    counts = (
        _insured(star, quarter)
        .groupBy("company_id", part("QUARTER", F.col("job_posted_date")).alias("job_posted_quarter"))
        .agg(F.count("job_id").alias("job_count"))
    )
    return (
        counts.join(star.company, "company_id")
        .groupBy("name", "job_posted_quarter")
        .agg(F.sum("job_count").alias("job_count"))
        .select("name", "job_count", "job_posted_quarter")
        .orderBy("name")
    )


def write_by_month(fact: DataFrame, path: str) -> None:
    """Store postings in one folder per calendar month, so that a month filter prunes folders.

    A further load replaces the months it holds and leaves the other folders as they are.
    """
    months = fact.withColumn("posted_month", F.month("job_posted_date")).write.partitionBy("posted_month")
    months.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def update_by_month(stored: DataFrame, path: str, updates: DataFrame, key: str, column: str) -> list[int]:
    """Set ``column`` of the stored postings named in ``updates(key, column)``; returns the months that were rewritten.

    ``stored`` is the table at ``path`` from :func:`write_by_month`. The keys are looked up first, so only the folders of months that
    hold one are read whole and replaced; all other files stay. The new rows are written aside before any folder is replaced. Postings
    that are not stored are no change.
    """
    months = stored.join(updates.select(key), key, "left_semi").select("posted_month").distinct()
    touched = sorted((row["posted_month"] for row in months.collect()), key=lambda month: (month is None, month))  # twelve and NULL at most
    if not touched:
        return []
    known = [month for month in touched if month is not None]
    in_touched = F.col("posted_month").isin(known) | (F.col("posted_month").isNull() if None in touched else F.lit(False))
    changed = materialise(update_by_key(stored.where(in_touched), updates, key, column), "updated-months")
    changed.write.partitionBy("posted_month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return touched


def month_partition(fact: DataFrame, month: int) -> DataFrame:
    """Postings of one calendar month of any year; prunes folders on a table from :func:`write_by_month`."""
    if "posted_month" in fact.columns:
        return fact.where(F.col("posted_month") == month)
    return fact.where(F.month("job_posted_date") == month)


def month_union(fact: DataFrame, months: Sequence[int] = FIRST_QUARTER) -> DataFrame:
    """Role, company and location of the postings of several months, one table per month below the other."""
    parts = [
        month_partition(fact, month).select("job_title_short", "company_id", "job_location") for month in months
    ]
    return reduce(DataFrame.unionByName, parts)


def quarter_top(
    fact: DataFrame, role: str = MAIN_ROLE, above: float = 70000, months: Sequence[int] = FIRST_QUARTER
) -> DataFrame:
    """Postings of a role in the given months above a pay level, best-paid first.

    Months do not overlap, so their union is one filter: the table is scanned once.
    """
    month = F.col("posted_month") if "posted_month" in fact.columns else F.month("job_posted_date")
    return (
        fact.where(
            month.isin(list(months)) & (F.col("job_title_short") == role) & (F.col("salary_year_avg") > above)
        )
        .select(
            "job_title_short",
            "job_location",
            "job_via",
            F.col("job_posted_date").cast("date").alias("job_posted_date"),
            F.col("salary_year_avg").cast("double").alias("salary_year_avg"),
        )
        .orderBy(F.desc("salary_year_avg"))
    )
