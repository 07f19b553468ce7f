"""Connected components of links between numbered nodes, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postprism.session import materialise


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``; component is the smallest node reachable.

    Each round points every node at the smallest of its neighbours and itself, follows that pointer four steps,
    and moves the links to where their ends point. Links inside one node vanish, so the graph shrinks by a
    factor each round, long chains included. Only counts reach the driver; each round is written to the shared
    folder, so a lost executor costs no earlier round. Rows with a NULL end are not links. No links: no rows.
    """
    edges = materialise(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") < F.col("b")))
        .distinct(),
        f"{label}-links",
    )
    found = None
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        step = materialise(
            ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to")),
            f"{label}-step",
        )
        twice = materialise(_follow(step, step), f"{label}-twice")
        jump = materialise(_follow(twice, twice), f"{label}-jump")
        if found is None:
            found = jump
        else:
            found = materialise(
                found.join(jump.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select(
                    "node", F.coalesce("next", "to").alias("to")
                ),
                f"{label}-found",
            )
        left = jump.select(F.col("node").alias("a"), F.col("to").alias("a_to"))
        right = jump.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        moved = edges.join(left, "a").join(right, "b")
        edges = materialise(
            moved.where(F.col("a_to") != F.col("b_to"))
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .distinct(),
            f"{label}-links",
        )
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.select("node", F.col("to").alias("component"))


def _follow(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.join(second.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select(
        "node", F.col("next").alias("to")
    )
