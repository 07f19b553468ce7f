"""Populations: named filters on postings, and their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postprism.star import Star

MAIN_ROLE = "Data Analyst"


def population(fact: DataFrame, role: str = MAIN_ROLE, paid: bool = False) -> DataFrame:
    """Remote postings of one role, optionally only those that state an annual pay."""
    chosen = fact.where((F.col("job_title_short") == role) & F.col("job_work_from_home"))
    return chosen.where(F.col("salary_year_avg").isNotNull()) if paid else chosen


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate (a denominator) to every row.

    The right side is an ungrouped aggregate, one row by construction, so no pairs are formed.
    """
    return df.crossJoin(F.broadcast(one_row))


def population_funnel(star: Star, role: str = MAIN_ROLE) -> DataFrame:
    """Six population sizes, from all postings down to paid ones with skills: step, postings.

    One pass over the fact counts the first four steps; one semi-join counts the two with skills.
    """
    is_role = F.col("job_title_short") == role
    is_remote = is_role & F.col("job_work_from_home")
    is_paid = is_remote & F.col("salary_year_avg").isNotNull()
    sizes = star.fact.agg(
        F.count(F.lit(1)).alias("n1"),
        F.count_if(is_role).alias("n2"),
        F.count_if(is_remote).alias("n3"),
        F.count_if(is_paid).alias("n4"),
    )
    listed = (
        population(star.fact, role)
        .select("job_id", "salary_year_avg")
        .join(star.bridge.select("job_id"), "job_id", "left_semi")
        .agg(F.count(F.lit(1)).alias("n5"), F.count("salary_year_avg").alias("n6"))
    )
    name = role.lower()
    steps = [
        "all postings",
        name,
        f"{name}, remote",
        f"{name}, remote, salaried",
        f"{name}, remote, with skills",
        f"{name}, remote, salaried, with skills",
    ]
    pairs = [c for i, step in enumerate(steps, 1) for c in (F.lit(step), F.col(f"n{i}"))]
    return with_scalar(sizes, listed).select(F.stack(F.lit(len(steps)), *pairs).alias("step", "postings"))


def step_size(funnel: DataFrame, step: str) -> DataFrame:
    """The size of one funnel step as a one-row frame with column ``postings``."""
    return funnel.where(F.col("step") == step).agg(F.max("postings").alias("postings"))
