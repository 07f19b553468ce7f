"""Near-equal vectors: cells of spherical k-means, blocked cosine products within a cell, one representative per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postprism.llm.components import connected_components
from postprism.session import materialise

COSINE = 0.95  # least cosine of a link
CELL_ROWS = 4_096  # vectors per cell, about
MOST_CELLS = 1_024
SAMPLE_VALUES = 4 << 20  # most numbers of the sample that the cells' centres are found from
BLOCK_ROWS = 4_096  # most rows, about, of either side of a product
_ROWS = 512  # of a product's left side at a time


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of unit vectors, from evenly spaced first centres; a cell left without vectors keeps its centre."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.maximum(lengths, 1e-300), centres)
    return centres


def cells_of(units: np.ndarray, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cells, table of all cells where a vector must be compared).

    Let a be the home of x and c that of y. Then y(a - c) <= 0, so x(a - c) <= (x - y)(a - c) <= |x - y| |a - c|. Linked unit
    vectors are at most sqrt(2 - 2 cosine) apart, so x need only visit cells c with x(a - c) <= that times |a - c|.
    """
    near = units @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
    gap = near[np.arange(len(units)), home][:, None] - near
    visits = gap <= np.sqrt(2 - 2 * cosine) * apart[home] + 1e-9
    return home, visits


def _units(packed: pd.Series, kind: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(value, dtype=kind) for value in packed]).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # against overflow of the squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _join_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Give the ends of all pairs one label, the smallest; labels point at places and are followed to their end."""
    while True:
        a, b = labels[left], labels[right]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(labels, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not np.array_equal(labels, labels[labels]):
            labels[:] = labels[labels]


def _compare(kind: str, cosine: float):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        """Counts of each own vector's links to the others of this unit, and links that connect what is connected here."""
        rows = rows.sort_values("node", kind="stable")
        own, others = rows[rows["own"]], rows[~rows["own"]]
        if own.empty or others.empty:
            return pd.DataFrame({"node": [], "links": [], "to": []})
        left, right = _units(own["vector"], kind), _units(others["vector"], kind)
        nodes = np.unique(rows["node"].to_numpy())
        at_left, at_right = (np.searchsorted(nodes, part["node"].to_numpy()) for part in (own, others))
        weights, labels = others["copies"].to_numpy(dtype=np.int64), np.arange(len(nodes))
        links = np.zeros(len(own), dtype=np.int64)
        for i in range(0, len(own), _ROWS):
            linked = left[i : i + _ROWS] @ right.T >= cosine
            linked &= at_left[i : i + _ROWS][:, None] != at_right[None, :]
            a, b = np.nonzero(linked)
            np.add.at(links, i + a, weights[b])
            _join_labels(labels, at_left[i + a], at_right[b])
        moved = np.flatnonzero(labels != np.arange(len(nodes)))
        counted = pd.DataFrame({"node": own["node"].to_numpy()[links > 0], "links": links[links > 0], "to": None})
        joined = pd.DataFrame({"node": nodes[moved], "links": 0, "to": nodes[labels[moved]]})
        return pd.concat([part for part in (counted, joined) if len(part)] or [counted]).astype({"to": "Int64"})

    return of


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for each row.

    Rows link if the cosine of their vectors, in double precision, is ``cosine`` or more. n_links counts the other rows linked
    directly, component_id is the smallest key reachable, and the row of that key is kept. A vector that is NULL, empty,
    zero, or holds a NULL or non-finite component links with nothing, as do vectors of different lengths. Equal vectors are
    compared once. A NULL key is never the smallest unless its component has no other; such a row is not kept.

    Every vector is compared in its home cell and in each cell where a linked vector could be at home, so no link is lost.
    Cells are cut into blocks, and each product of two blocks is a task's work: a cell of any size is spread out. Vectors without
    cluster structure visit most cells; the work is then that of all products.
    """
    element = vectors.schema[vector].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    value = F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")
    finite = F.forall(value, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.coalesce(finite & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.when(usable, value).alias("vector"))
    rows = rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    distinct = materialise(
        rows.where(F.col("node").isNotNull())
        .groupBy("node", "vector")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("smallest"))
        .withColumn("width", F.size("vector")),
        "vectors",
    )

    widths = [row["width"] for row in distinct.select("width").distinct().collect()]  # vectors of a table have one length, or few
    results = None
    for width in sorted(widths):
        part = distinct.where(F.col("width") == width)
        found = _unit_results(part, width, kind, cosine)
        results = found if results is None else results.union(found)
    if results is None:
        named = distinct.select("node", F.lit(0).cast("long").alias("links"), F.col("smallest").alias("component_id"), "copies")
    else:
        results = materialise(results, "vector-links")
        links = results.where(F.col("to").isNull()).groupBy("node").agg(F.sum("links").alias("links"))
        groups = connected_components(results.where(F.col("to").isNotNull()).select(F.col("node").alias("a"), F.col("to").alias("b")), "vectors")
        slim = distinct.select("node", "copies", "smallest").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = slim.groupBy("component").agg(F.min("smallest").alias("component_id"))
        named = slim.join(least, "component").join(links, "node", "left").select("node", F.coalesce("links", F.lit(0)).alias("links"), "component_id", "copies")
    return (
        rows.drop("vector")
        .join(named, "node", "left")
        .select(
            F.col("key").alias(key),
            F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
    )


def _unit_results(distinct: DataFrame, width: int, kind: str, cosine: float) -> DataFrame:
    """``(node, links, to)``: link counts of vectors of one length, and links that connect them."""
    spark = distinct.sparkSession
    count = distinct.count()
    cells = min(MOST_CELLS, max(1, -(-count // CELL_ROWS)))
    most = max(cells, SAMPLE_VALUES // max(1, width))
    taken = distinct.orderBy("node").limit(most).select("vector").toPandas()  # SAMPLE_VALUES numbers at most
    sample = _units(pd.Series([np.asarray(row, dtype=kind).tobytes() for row in taken["vector"]]), kind)
    centres = spark.sparkContext.broadcast(spherical_kmeans(sample, cells))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), 2_048):
                own = part.iloc[i : i + 2_048]
                packed = pd.Series([np.asarray(row, dtype=kind).tobytes() for row in own["vector"]])
                home, visits = cells_of(_units(packed, kind), centres.value, cosine)
                row, cell = np.nonzero(visits)
                yield pd.DataFrame(
                    {"cell": cell, "home": home[row] == cell, "node": own["node"].to_numpy()[row], "copies": own["copies"].to_numpy()[row], "vector": packed.to_numpy()[row]}
                )

    placed = materialise(
        distinct.select("node", "copies", "vector").mapInPandas(assign, "cell int, home boolean, node long, copies long, vector binary"), "vector-cells"
    )
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("all"), F.count_if("home").alias("own")).select(
        "cell", F.ceil(F.col("own") / BLOCK_ROWS).cast("int").alias("lefts"), F.ceil(F.col("all") / BLOCK_ROWS).cast("int").alias("rights")
    )
    cut = placed.join(F.broadcast(sizes.where("lefts > 0")), "cell")  # at most MOST_CELLS rows
    block = lambda blocks: F.pmod(F.xxhash64("node", F.lit(3)), F.col(blocks)).cast("int")
    columns = ["cell", "left", "right", "own", "node", "copies", "vector"]
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    own = cut.where("home").select("*", F.lit(True).alias("own"), block("lefts").alias("left"), every("rights").alias("right"))
    others = cut.select("*", F.lit(False).alias("own"), block("rights").alias("right"), every("lefts").alias("left"))
    units = own.select(*columns).union(others.select(*columns))
    return units.groupBy("cell", "left", "right").applyInPandas(_compare(kind, cosine), "node long, links long, to long")
