"""The standard report: the same set of result tables for any dataset."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from postprism.operators.population import MAIN_ROLE, population_funnel
from postprism.plans import demand, pay, quality
from postprism.sources.postings import run_catalog
from postprism.star import Star


def analyses(role: str = MAIN_ROLE) -> dict[str, Callable[[Star], DataFrame]]:
    """Result tables by name. Pay tables of a dataset without pay are empty, the others are not affected."""
    return {
        "top_paying": partial(pay.top_paying, role=role),
        "skills_in_top": partial(demand.skills_in_top, role=role),
        "skill_demand_top": partial(demand.skill_demand_top, role=role),
        "pay_by_skill": partial(pay.pay_by_skill, role=role),
        "demand_and_pay": partial(pay.demand_and_pay, role=role),
        "population_funnel": partial(population_funnel, role=role),
        "flag_equivalence": quality.flag_equivalence,
        "salary_outliers": partial(pay.salary_outliers, role=role),
        "outlier_effect": partial(pay.outlier_effect, role=role),
        "pay_unguarded": partial(pay.pay_unguarded, role=role),
        "top_without_skills": partial(quality.top_without_skills, role=role),
        "near_duplicates": quality.near_duplicates,
        "skill_demand_all": partial(demand.skill_demand_all, role=role),
    }


def write_report(star: Star, path: str, role: str = MAIN_ROLE) -> dict[str, bool]:
    """Write the report of a dataset as one CSV folder per table; tells which tables have rows."""
    return run_catalog(star, analyses(role), path)
