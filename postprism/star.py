"""The four-table dataset every analysis takes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Star:
    """One dataset: postings, companies, skills, and the posting-skill bridge with unique pairs.

    An analysis never asks which dataset it got: the same function runs on any Star.
    """

    fact: DataFrame
    company: DataFrame
    skill: DataFrame
    bridge: DataFrame

    def with_fact(self, fact: DataFrame) -> Star:
        """The same dataset seen through other postings, e.g. a date range."""
        return replace(self, fact=fact)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "company_dim": self.company,
            "skills_dim": self.skill,
            "job_postings_fact": self.fact,
            "skills_job_dim": self.bridge,
        }
