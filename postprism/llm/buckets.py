"""Groups of near copies from shared bucket keys, without forming all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postprism.llm.components import connected_components
from postprism.session import materialise

_BEFORE = 1, 2, 3, 4  # a member's buckets before its own that are looked at
_TILE = 64  # members of a bucket, on one side, that a task compares with all others


def groups_in_buckets(
    keys: DataFrame,
    near: Callable[[Column, Column], Column],
    codes: DataFrame | None = None,
    verify: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    label: str = "buckets",
) -> DataFrame:
    """Components of the links between nodes that share a bucket and are near: ``(node, component)``.

    ``keys (bucket, node)``: each node's bucket keys. ``codes (node, code)`` are compared by ``near``; without them a node is
    its own code. Two nodes link if they share a bucket, their codes are near and ``verify`` keeps their pair
    ``(a, b)``. Nodes without links give no row.

    How the pairs are looked at says ``groups_of_members``.
    """
    hubs = (
        keys.groupBy("bucket")
        .agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n"))
        .where(F.col("hub") < F.col("last"))
        .select("bucket", "hub", (F.col("n") > 2).alias("more"))
    )
    members = keys.join(hubs, "bucket").where(F.col("node") != F.col("hub")).select("bucket", "node", "hub", "more")
    return groups_of_members(materialise(members, f"{label}-members"), near, codes, verify, label)


def groups_of_members(
    members: DataFrame,
    near: Callable[[Column, Column], Column],
    codes: DataFrame | None = None,
    verify: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    label: str = "buckets",
    values: tuple[Callable[[DataFrame], DataFrame], Callable[[str, str], Column]] | None = None,
) -> DataFrame:
    """The same from stored ``members (bucket, node, hub, more)``: the nodes of each bucket but its smallest, which is the hub,
    and whether the bucket may hold further ones.

    A bucket of n copies would hold n * n pairs. So each member is first compared with the bucket's smallest node
    only; what that connects needs no further look, nor does a bucket of two. Then only members of *different* components of a bucket are
    compared, each with each. Every link left out lies within one component, so the components are those of all links.

    ``values``, with ``codes``: a function from nodes to ``(node, value)``, and a test of two values by their names that says the same as
    ``verify``. Members then meet with their values, and only pairs that link leave the join: unlike pairs, whose number grows with the square
    of a bucket, are never listed.
    """

    def linked(pairs: DataFrame) -> DataFrame:
        if codes is None:
            return verify(pairs.where(near(F.col("a"), F.col("b"))))
        for end in ("a", "b"):
            pairs = pairs.join(codes.select(F.col("node").alias(end), F.col("code").alias(f"{end}_code")), end)
        return verify(pairs.where(near(F.col("a_code"), F.col("b_code"))).select("a", "b"))

    first = members.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = materialise(linked(first), f"{label}-first")
    groups = connected_components(links, label)

    named = members.where("more").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (
        named.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where(F.col("low") < F.col("high"))
        .select("bucket")
    )
    named = named.join(mixed, "bucket", "left_semi").select("bucket", "component", "node")
    if codes is not None:  # a pair that is not near never leaves the join
        # nor does one that shares one of its last buckets before this: it left the join there, or before
        last = Window.partitionBy("node").orderBy("bucket")
        before = [F.coalesce(F.lag("bucket", n).over(last), F.lit(-1)).alias(f"before{n}") for n in _BEFORE]
        short = named.select(F.hash("bucket").cast("long").bitwiseAND(F.lit((1 << 32) - 1)).alias("bucket"), "component", "node").distinct()
        named = materialise(short.join(codes.select("node", "code"), "node").select("*", *before), f"{label}-mixed")
        side = lambda end: [F.col(name).alias(f"{end}_{name}") for name in named.columns]
        shared = [(F.col(f"a_before{m}") == F.col(f"b_before{n}")) & (F.col(f"a_before{m}") >= 0) for m in _BEFORE for n in _BEFORE]
        meet = (F.col("a_bucket") == F.col("b_bucket")) & near(F.col("a_code"), F.col("b_code")) & ~reduce(or_, shared)
        lower = F.col("a_component") < F.col("b_component")
        if values is None:
            met = named.select(*side("a")).join(named.select(*side("b")), lower & meet)
            pairs = met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
            more = materialise(verify(pairs), f"{label}-across")
        else:
            value_of, alike = values
            other = F.col("a_component") != F.col("b_component")
            facing = named.select(*side("a")).join(named.select(*side("b")), other & meet, "left_semi")
            facing = materialise(facing.select(*[F.col(f"a_{name}").alias(name) for name in ("bucket", "component", "node", "code")]), f"{label}-facing")
            full = facing.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(_TILE)).cast("int").alias("tiles")).where("tiles > 1")
            tiled = facing.join(full, "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
            own = materialise(facing.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("buckets")), f"{label}-ends")
            valued = tiled.join(own.join(value_of(own.select("node")), "node"), "node")
            named = valued.withColumn("tile", F.pmod(F.hash("node"), "tiles"))
            left = named.select(*side("a"))
            named = valued.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            right = named.select(*side("b"))
            meet = (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_tile") == F.col("b_tile")) & lower & near(F.col("a_code"), F.col("b_code"))
            once = F.array_min(F.array_intersect("a_buckets", "b_buckets")) == F.col("a_bucket")  # in the first bucket that both are in
            met = left.join(right, meet & once & alike("a_value", "b_value"))
            more = materialise(met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct(), f"{label}-across")
        return groups if more.isEmpty() else connected_components(links.union(more), label)
    named = materialise(named, f"{label}-mixed")
    parts = named.select("bucket", "component").distinct()
    facing = parts.join(parts.select("bucket", F.col("component").alias("other")), "bucket").where(
        F.col("component") < F.col("other")
    )
    across = (
        named.join(facing, ["bucket", "component"])
        .select("bucket", F.col("other").alias("component"), F.col("node").alias("a"))
        .join(named, ["bucket", "component"])
        .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        .distinct()
    )
    more = materialise(linked(across), f"{label}-across")
    if more.isEmpty():
        return groups
    return connected_components(links.union(more), label)
