"""Pay analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postprism.functions.measures import cents, mean_money, money, share_pct
from postprism.operators.population import MAIN_ROLE, population, with_scalar
from postprism.operators.quantiles import grouped_quantiles, value_counts
from postprism.star import Star

MIN_POSTINGS = 10

# A top-k of up to this many rows is sent to every executor; a longer one is joined like any table.
BROADCAST_TOP = 100_000


def few(top: DataFrame, k: int) -> DataFrame:
    """A top-k with a broadcast hint where k bounds its size."""
    return F.broadcast(top) if k <= BROADCAST_TOP else top


def top_paid(star: Star, role: str = MAIN_ROLE, k: int = 10) -> DataFrame:
    """The k best-paid postings of the population, fact columns; equal pay is ordered by job id."""
    return population(star.fact, role, paid=True).orderBy(F.desc("salary_year_avg"), F.asc("job_id")).limit(k)


def top_paying(star: Star, role: str = MAIN_ROLE, k: int = 10) -> DataFrame:
    """The k best-paid postings with company, schedule and date.

    The limit comes before the join, so the companies are matched against k rows.
    """
    columns = ["job_id", "job_title", "company_id", "job_schedule_type", "salary_year_avg", "job_posted_date"]
    top = top_paid(star.with_fact(star.fact.select(*columns, "job_title_short", "job_work_from_home")), role, k)
    return (
        star.company.join(few(top, k), "company_id")
        .select(
            "job_id",
            "job_title",
            F.col("name").alias("company_name"),
            "job_schedule_type",
            F.col("salary_year_avg").cast("double").alias("salary_year_avg"),
            F.col("job_posted_date").cast("date").alias("job_posted_date"),
        )
        .orderBy(F.desc("salary_year_avg"), F.asc("job_id"))
    )


def _paid_pairs(star: Star, role: str) -> DataFrame:
    paid = population(star.fact, role, paid=True).select("job_id", cents("salary_year_avg").alias("cents"))
    return paid.join(star.bridge, "job_id").select("skill_id", "cents")


def _skill_pay(star: Star, role: str, min_postings: int) -> DataFrame:
    counts = value_counts(_paid_pairs(star, role), ["skill_id"], "cents")
    summary = grouped_quantiles(counts, ["skill_id"], "cents", {"median": 0.5}).where(F.col("n") >= min_postings)
    return summary.join(star.skill, "skill_id").select(
        F.col("skills").alias("skill"),
        F.col("n").alias("postings"),
        F.round(mean_money(F.col("total"), F.col("n")), 0).alias("avg_salary"),
        F.round(F.col("median") / 100, 0).alias("med_salary"),
    )


def pay_by_skill(
    star: Star, role: str = MAIN_ROLE, min_postings: int = MIN_POSTINGS, k: int = 10
) -> DataFrame:
    """Best-paid skills among those with enough paid postings: count, mean and exact median."""
    return _skill_pay(star, role, min_postings).orderBy(F.desc("avg_salary"), F.asc("skill")).limit(k)


def demand_and_pay(
    star: Star, role: str = MAIN_ROLE, min_postings: int = MIN_POSTINGS, k: int = 20
) -> DataFrame:
    """Demand next to pay; the share is of all paid postings, also those that list no skill."""
    whole = population(star.fact, role, paid=True).agg(F.count(F.lit(1)).alias("_whole"))
    return (
        with_scalar(_skill_pay(star, role, min_postings), whole)
        .select(
            "skill",
            "postings",
            share_pct(F.col("postings"), F.col("_whole")).alias("demand_pct"),
            "avg_salary",
            "med_salary",
        )
        .orderBy(F.desc("postings"), F.desc("avg_salary"), F.asc("skill"))
        .limit(k)
    )


def pay_unguarded(star: Star, role: str = MAIN_ROLE, k: int = 10) -> DataFrame:
    """The ranking of :func:`pay_by_skill` without its floor, to show why the floor is needed."""
    means = (
        _paid_pairs(star, role)
        .groupBy("skill_id")
        .agg(F.count(F.lit(1)).alias("postings"), F.sum("cents").alias("total"))
    )
    return (
        means.join(star.skill, "skill_id")
        .select(
            F.col("skills").alias("skill"),
            "postings",
            F.round(mean_money(F.col("total"), F.col("postings")), 0).alias("avg_salary"),
        )
        .orderBy(F.desc("avg_salary"), F.asc("skill"))
        .limit(k)
    )


def quadrants(table: DataFrame) -> DataFrame:
    """Split a demand-and-pay table at the median of each axis; a value on the line counts as high.

    The table is a top-k report, so its medians are taken in one task.
    """
    splits = table.agg(
        F.percentile("postings", 0.5).alias("demand_split"), F.percentile("avg_salary", 0.5).alias("pay_split")
    )
    wanted = F.col("postings") >= F.col("demand_split")
    paid = F.col("avg_salary") >= F.col("pay_split")
    # Quadrant names.
    label = (
        F.when(wanted & paid, "High demand, high pay")
        .when(wanted, "High demand, lower pay")
        .when(paid, "Niche, high pay")
        .otherwise("Niche, lower pay")
    )
    return with_scalar(table, splits).select(
        "skill", "postings", "avg_salary", "demand_split", "pay_split", label.alias("quadrant")
    )


def _pay_counts(star: Star, role: str) -> DataFrame:
    paid = population(star.fact, role, paid=True).select(cents("salary_year_avg").alias("cents"))
    return value_counts(paid, [], "cents")


def pay_distribution(star: Star, role: str = MAIN_ROLE) -> DataFrame:
    """Five-number summary of pay, exact, one row."""
    summary = grouped_quantiles(_pay_counts(star, role), [], "cents", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return summary.select(
        F.col("n").alias("postings"),
        money(F.col("low")).alias("min_salary"),
        (F.col("q1") / 100).alias("q1_salary"),
        (F.col("q2") / 100).alias("median_salary"),
        (F.col("q3") / 100).alias("q3_salary"),
        money(F.col("high")).alias("max_salary"),
    )


def salary_outliers(star: Star, role: str = MAIN_ROLE, k: int = 5) -> DataFrame:
    """The k highest values, exact repeats shown once, as multiples of the population median."""
    median = grouped_quantiles(_pay_counts(star, role), [], "cents", {"median": 0.5}).select("median")
    shown = (
        population(star.fact, role, paid=True)
        .select("job_title", "company_id", "job_via", "salary_year_avg")
        .join(star.company, "company_id")
        .select("job_title", F.col("name").alias("company_name"), "job_via", "salary_year_avg")
        .distinct()
        .orderBy(F.desc("salary_year_avg"), *[F.asc_nulls_last(c) for c in ("job_title", "company_name", "job_via")])
        .limit(k)
    )
    multiple = F.round(cents("salary_year_avg").cast("double") / F.col("median"), 1)
    return (
        with_scalar(shown, median)
        .select(
            "job_title",
            "company_name",
            "job_via",
            F.col("salary_year_avg").cast("double").alias("salary_year_avg"),
            multiple.alias("multiple_of_median"),
        )
        .orderBy(F.desc("salary_year_avg"), *[F.asc_nulls_last(c) for c in ("job_title", "company_name", "job_via")])
    )


def outlier_effect(star: Star, role: str = MAIN_ROLE, cut: float | None = None) -> DataFrame:
    """Mean, median and maximum, and the mean of values below ``cut`` (default: below the maximum).

    One row also for an empty population: count 0, the rest NULL.
    """
    counts = _pay_counts(star, role)
    summary = grouped_quantiles(counts, [], "cents", {"median": 0.5})
    if cut is None:
        # Rows at the maximum are one entry of the value counts.
        top = counts.agg(F.max_by("n", "cents").alias("_n_top"), F.max("cents").alias("_top"))
        n_below = F.col("n") - F.col("_n_top")
        sum_below = F.col("total") - F.col("_n_top") * F.col("_top")
    else:
        below = F.col("cents") < int(round(cut * 100))
        top = counts.agg(
            F.sum(F.when(below, F.col("n"))).alias("_n_below"),
            F.sum(F.when(below, F.col("n") * F.col("cents"))).alias("_sum_below"),
        )
        n_below, sum_below = F.col("_n_below"), F.col("_sum_below")
    return with_scalar(summary, top).select(
        F.col("n").alias("postings"),
        F.round(mean_money(F.col("total"), F.col("n")), 0).alias("avg_all"),
        F.round(F.col("median") / 100, 0).alias("median_all"),
        F.round(mean_money(sum_below, n_below), 0).alias("avg_excl_top"),
        F.round(money(F.col("high")), 0).alias("max_salary"),
    )
