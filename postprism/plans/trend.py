"""Demand over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postprism.functions.measures import share_pct
from postprism.operators.population import MAIN_ROLE, population
from postprism.star import Star


def demand_trend(star: Star, role: str = MAIN_ROLE, width: str = "7 days") -> DataFrame:
    """Skill demand per window of the true posting date: window_start, skill, postings, share_of_pct.

    The share is of the window's remote postings of the role that list any skill. One pass over the bridge:
    each posting adds one NULL entry that counts the posting itself.
    """
    dated = population(star.fact, role).select("job_id", F.window("job_posted_date", width)["start"].alias("window_start"))
    listed = (
        dated.join(star.bridge, "job_id").groupBy("job_id", "window_start").agg(F.collect_list("skill_id").alias("ids"))
    )
    counts = (
        listed.select("window_start", F.explode(F.array_append("ids", F.lit(None).cast("bigint"))).alias("skill_id"))
        .groupBy("window_start", "skill_id")
        .agg(F.count(F.lit(1)).alias("postings"))
    )
    # One window's rows are at most the vocabulary.
    whole = F.max(F.when(F.col("skill_id").isNull(), F.col("postings"))).over(Window.partitionBy("window_start"))
    return (
        counts.withColumn("_whole", whole)
        .join(star.skill, "skill_id")
        .select(
            "window_start",
            F.col("skills").alias("skill"),
            "postings",
            share_pct(F.col("postings"), F.col("_whole")).alias("share_of_pct"),
        )
        .orderBy("window_start", F.desc("postings"), F.asc("skill"))
    )
