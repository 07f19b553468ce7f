"""Skill demand and its comparison between datasets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postprism.functions.measures import share_pct
from postprism.operators.population import MAIN_ROLE, population, with_scalar
from postprism.operators.terms import AMBIGUOUS
from postprism.plans.pay import few, top_paid
from postprism.star import Star

# Share of a leading skill in percent, postings of a common one.
LEADER_SHARE = 30.0
COMMON_POSTINGS = 4


def _demand(postings: DataFrame, star: Star, share: str, whole: str | None = None) -> DataFrame:
    """Postings per skill and their share of the postings that list any skill: skill, postings, ``share``.

    The bridge is read and shuffled once for both numbers: a posting's skills are gathered (a list no
    longer than the vocabulary), and each posting adds one NULL entry that counts the posting itself.
    Pairs are unique, so counting rows equals counting distinct postings. Counts are per skill id;
    the name is joined to the finished counts. ``whole`` keeps the denominator as a column of that name.
    """
    listed = postings.select("job_id").join(star.bridge, "job_id").groupBy("job_id").agg(F.collect_list("skill_id").alias("ids"))
    counts = (
        listed.select(F.explode(F.array_append("ids", F.lit(None).cast("bigint"))).alias("skill_id"))
        .groupBy("skill_id")
        .agg(F.count(F.lit(1)).alias("postings"))
    )
    # One row per skill: the single-task window sees the vocabulary, never the postings.
    size = F.max(F.when(F.col("skill_id").isNull(), F.col("postings"))).over(Window.partitionBy())
    return (
        counts.withColumn("_whole", size)
        .join(star.skill, "skill_id")
        .select(
            F.col("skills").alias("skill"),
            "postings",
            share_pct(F.col("postings"), F.col("_whole")).alias(share),
            *([F.col("_whole").alias(whole)] if whole else []),
        )
    )


def skill_demand_all(star: Star, role: str = MAIN_ROLE) -> DataFrame:
    """Demand of every skill in the remote population, most wanted first."""
    return _demand(population(star.fact, role), star, "share_of_pct").orderBy(F.desc("postings"), F.asc("skill"))


def skill_demand_top(star: Star, role: str = MAIN_ROLE, k: int = 10) -> DataFrame:
    """The k most wanted skills."""
    return skill_demand_all(star, role).limit(k)


def skills_in_top(star: Star, role: str = MAIN_ROLE, k: int = 10, k_skills: int = 15) -> DataFrame:
    """Skills of the k best-paid postings; the share is of those among them that list any skill."""
    # With k rows broadcast the bridge is scanned without a shuffle.
    top = few(top_paid(star, role, k).select("job_id"), k)
    return _demand(top, star, "coverage_pct").orderBy(F.desc("postings"), F.asc("skill")).limit(k_skills)


def remote_skill_count(star: Star, role: str = MAIN_ROLE, k: int = 5) -> DataFrame:
    """The k most wanted skills with id and name, counted on the id before the name is joined."""
    counts = (
        population(star.fact, role)
        .select("job_id")
        .join(star.bridge, "job_id")
        .groupBy("skill_id")
        .agg(F.count(F.lit(1)).alias("skill_count"))
    )
    top = counts.join(star.skill, "skill_id").select("skill_id", F.col("skills").alias("skill_name"), "skill_count")
    return top.orderBy(F.desc("skill_count"), F.asc("skill_id")).limit(k)


def mark_top(table: DataFrame, column: str) -> DataFrame:
    """A result table with its highest rows by a column marked ``is_top``."""
    return with_scalar(table, table.agg(F.max(column).alias("_most"))).select(
        *table.columns, (F.col(column) == F.col("_most")).alias("is_top")
    )


def mark_common(table: DataFrame, at_least: int = COMMON_POSTINGS) -> DataFrame:
    """A result table with the skills of enough postings marked ``is_common``."""
    return table.withColumn("is_common", F.col("postings") >= at_least)


def demand_leaders(table: DataFrame, cut: float = LEADER_SHARE) -> DataFrame:
    """Mark the skills of a demand table at or above a share, and the most wanted one.

    ``leaders`` is the number of marked skills, repeated on each row for use in a headline.
    """
    leads = F.col("share_of_pct") >= cut
    marks = table.agg(F.count_if(leads).alias("leaders"), F.max("postings").alias("_most"))
    return with_scalar(table, marks).select(
        "skill",
        "postings",
        "share_of_pct",
        leads.alias("is_leader"),
        (F.col("postings") == F.col("_most")).alias("is_top"),
        "leaders",
    )


def compare_tables(base: DataFrame, new: DataFrame, excluded: Iterable[str] = AMBIGUOUS) -> DataFrame:
    """Two demand tables side by side; a skill on one side only has share 0 on the other.

    Excluded terms are left out of both sides, as one side's method cannot see them. Further columns of the
    tables are kept.
    """
    drop = sorted(excluded)

    def side(table: DataFrame, name: str) -> DataFrame:
        kept = table.where(~F.col("skill").isin(drop)) if drop else table
        return kept.withColumnsRenamed({"postings": f"postings_{name}", "share_of_pct": f"share_{name}"})

    both = side(base, "base").join(side(new, "new"), "skill", "full_outer")
    shares = {f"share_{name}": F.coalesce(F.col(f"share_{name}"), F.lit(0.0)) for name in ("base", "new")}
    return both.withColumns(shares).withColumn("rank_on", F.greatest("share_base", "share_new"))


def compare_demand(
    base: Star, new: Star, role: str = MAIN_ROLE, excluded: Iterable[str] = AMBIGUOUS, k: int = 10
) -> DataFrame:
    """The k skills with the larger share on either side, with both denominators.

    The denominators are the funnels' "remote, with skills" sizes. Each dataset's bridge is read once: the sizes
    come with the demand tables.
    """
    sides = [
        _demand(population(star.fact, role), star, "share_of_pct", whole=size)
        for star, size in ((base, "n_base"), (new, "n_new"))
    ]
    every = Window.partitionBy()  # one row per skill
    merged = compare_tables(*sides, excluded)
    sizes = {size: F.coalesce(F.max(size).over(every), F.lit(0)) for size in ("n_base", "n_new")}
    columns = ["skill", "postings_base", "postings_new", "share_base", "share_new", "rank_on", "n_base", "n_new"]
    return merged.withColumns(sizes).select(*columns).orderBy(F.desc("rank_on"), F.asc("skill")).limit(k)
