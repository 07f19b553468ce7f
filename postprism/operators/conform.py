"""Feed records to the star schema of the base dataset."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postprism.functions.dates import posting_time
from postprism.functions.measures import ratio_pct
from postprism.functions.text import OTHER_ROLE, ROLE_TERMS, TITLE_RULES, classify_title, matches_role
from postprism.operators.keys import first_seen_dimension, surrogate_key
from postprism.operators.lookup import lookup_join
from postprism.operators.population import with_scalar
from postprism.operators.terms import extract_terms, usable_vocabulary
from postprism.schemas import FACT
from postprism.star import Star


def role_filter(records: DataFrame, terms: Sequence[str] = ROLE_TERMS) -> DataFrame:
    """Records whose title holds one of the role terms as a whole word."""
    return records.where(matches_role(F.col("title"), terms))


def posting_key() -> list[Column]:
    """Company and title, case-blind: records equal on these are one posting."""
    return [
        F.lower(F.coalesce(F.col("company"), F.lit(""))).alias("_company"),
        F.lower(F.col("title")).alias("_title"),
    ]


def keep_first(records: DataFrame, keys: Sequence[Column], order: str = "arrival") -> DataFrame:
    """The record with the lowest ``order`` of each key. ``order`` is a unique number.

    Only keys and order numbers are grouped, combined map-side, so a posting copied over a third of all
    records is one row per task; the records are then picked by their own unique number, which has no skew.
    """
    firsts = records.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return records.join(firsts, order, "left_semi")


def conform_funnel(records: DataFrame, terms: Sequence[str] = ROLE_TERMS) -> DataFrame:
    """Fetched, role-matched and unique records: stage, postings. One pass and one map-side combined count."""
    matched = matches_role(F.col("title"), terms)
    counts = records.agg(F.count(F.lit(1)).alias("n1"), F.count_if(matched).alias("n2"))
    unique = records.where(matched).select(*posting_key()).distinct().agg(F.count(F.lit(1)).alias("n3"))
    # Stage names.
    return with_scalar(counts, unique).select(
        F.stack(
            F.lit(3), F.lit("fetched"), F.col("n1"), F.lit("role-matched"), F.col("n2"), F.lit("unique"), F.col("n3")
        ).alias("stage", "postings")
    )


def number_postings(records: DataFrame) -> DataFrame:
    """Records with a dense ``job_id`` in order of arrival, which is unique."""
    return surrogate_key(records, "job_id", ["arrival"], unique=True)


def conform_fact(
    postings: DataFrame,
    company: DataFrame,
    collected_at: datetime,
    rules: Sequence[tuple[str, str]] = TITLE_RULES,
    other: str = OTHER_ROLE,
    keep_posted: bool = False,
) -> DataFrame:
    """Numbered records as fact rows; measures the feeds do not state are NULL.

    ``collected_at`` stamps every row, so a run can be repeated. With ``keep_posted`` the posting date is the one
    the feed states, and NULL where it states none that can be read; ``posting_dates`` counts these.
    """
    stamp = F.lit(collected_at.isoformat(sep=" ")).cast("timestamp_ntz")
    columns = {
        "job_id": F.col("job_id"),
        "company_id": F.col("company_id"),
        "job_title_short": classify_title(F.col("title"), rules, other),
        "job_title": F.col("title"),
        # Fixed value: location text of remote postings.
        "job_location": F.when(F.col("remote"), "Anywhere").otherwise(F.col("location")),
        "job_via": F.col("source"),
        "job_schedule_type": F.col("schedule"),
        "job_work_from_home": F.col("remote"),
        "search_location": F.col("location"),
        "job_posted_date": posting_time(F.col("posted")) if keep_posted else stamp,
    }
    named = lookup_join(
        postings.drop("text").withColumn("name", F.coalesce("company", F.lit("Unknown"))), company, "name"
    )
    return named.select(
        *[columns.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name) for field in FACT]
    )


def posting_dates(records: DataFrame) -> DataFrame:
    """How the feeds state posting dates: source, stated, readable, unreadable, missing."""
    stated = F.trim(F.coalesce("posted", F.lit(""))) != ""
    readable = posting_time(F.col("posted")).isNotNull()
    return records.groupBy("source").agg(
        F.count_if(stated).alias("stated"),
        F.count_if(stated & readable).alias("readable"),
        F.count_if(stated & ~readable).alias("unreadable"),
        F.count_if(~stated).alias("missing"),
    )


def conform_star(
    records: DataFrame,
    skill: DataFrame,
    collected_at: datetime,
    terms: Sequence[str] = ROLE_TERMS,
    rules: Sequence[tuple[str, str]] = TITLE_RULES,
    other: str = OTHER_ROLE,
    keep_posted: bool = False,
) -> Star:
    """Feed records as a dataset of the same schema and with the same skill ids as the base dataset.

    Records are filtered, reduced and numbered without their texts; the texts of those that stay are joined once.
    """
    unique = keep_first(role_filter(records.drop("text"), terms), posting_key())
    postings = number_postings(unique)
    texts = records.select("arrival", "text").join(postings.select("arrival", "job_id"), "arrival").select("job_id", "text")
    company = first_seen_dimension(postings, "company", "job_id", "company_id")
    return Star(
        fact=conform_fact(postings, company, collected_at, rules, other, keep_posted),
        company=company,
        skill=skill,
        bridge=extract_terms(texts, usable_vocabulary(skill), "job_id"),
    )


def coverage_report(star: Star) -> DataFrame:
    """Rows, rows per feed, rows with skills and with pay: metric, postings, pct (of all rows, NULL if none)."""
    fact = star.fact.select("job_id", "job_via", "salary_year_avg")
    listed = star.bridge.select("job_id")
    # One small row per feed; totals are taken from these.
    feeds = fact.groupBy("job_via").agg(F.count(F.lit(1)).alias("n"), F.count("salary_year_avg").alias("paid"))
    totals = feeds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum("paid"), F.lit(0)).alias("paid"))
    with_skills = fact.join(listed, "job_id", "left_semi").agg(F.count(F.lit(1)).alias("listed"))
    # Metric names.
    summary = with_scalar(totals, with_skills).select(
        F.stack(
            F.lit(3),
            F.lit("postings"), F.col("all"), F.lit(None).cast("double"),
            F.lit("with skills"), F.col("listed"), ratio_pct(F.col("listed"), F.col("all")),
            F.lit("with salary"), F.col("paid"), ratio_pct(F.col("paid"), F.col("all")),
        ).alias("metric", "postings", "pct")
    )
    per_feed = feeds.orderBy(F.desc("n"), F.asc("job_via")).select(
        F.concat(F.lit("source "), F.coalesce("job_via", F.lit(""))).alias("metric"),
        F.col("n").alias("postings"),
        F.lit(None).cast("double").alias("pct"),
    )
    return summary.unionByName(per_feed)
