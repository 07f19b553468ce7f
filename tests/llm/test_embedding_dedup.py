import numpy as np
import pytest

from postprism.llm import embedding_dedup
from tests.llm.conftest import smallest_reachable


def brute(rows):
    def cosine(a, b):
        if len(a) != len(b):
            return -1.0
        a, b = np.array(a, float), np.array(b, float)
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b))

    def usable(v):
        return bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v)

    linked = {
        (i, j): usable(a) and usable(b) and cosine(a, b) >= 0.95
        for i, (_, a) in enumerate(rows)
        for j, (_, b) in enumerate(rows)
        if i != j
    }
    tops = smallest_reachable(range(len(rows)), lambda i, j: linked[i, j])
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in tops if tops[j] == tops[i] and rows[j][0] is not None]
        least = min(keys, default=None)
        out.append((key, sum(linked[i, j] for j in range(len(rows)) if j != i), least, key is not None and key == least))
    return sorted(out, key=str)


def found(vectors):
    return sorted([tuple(row) for row in embedding_dedup.near_vectors(vectors).collect()], key=str)


def made(seed, count, width=8):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(12, width))
    return [(i, (centres[i % 12] + pick.normal(size=width) * pick.choice([0.05, 0.3, 2])).astype(np.float32).tolist()) for i in range(count)]


@pytest.mark.parametrize("cell_rows,block_rows", [(4_096, 4_096), (40, 16)])
def test_equals_brute_force(spark, monkeypatch, cell_rows, block_rows):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block_rows)
    rows = made(1, 260)
    rows += [(1_000 + i, rows[5][1]) for i in range(40)] + [(2_000, [2 * x for x in rows[5][1]])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(vectors) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [nan, 1.0]),
        (8, [inf, 0.0]), (None, [1.0, 0.01]), (9, [1.0, 0.0, 0.0]), (10, [1e300, 1e290]), (11, [1e-300, 0.0]), (12, [-1.0, 0.0]), (None, None),
    ]
    vectors = spark.createDataFrame([(*row, 1, 2) for row in rows], "vec_id long, embedding array<double>, node long, cell int")
    expected = [(k, n, c, kept) for k, n, c, kept in brute([r for r in rows if r[0] not in (10, 11)])]
    got = found(vectors)
    tiny = {row[0]: row for row in got if row[0] in (10, 11)}
    assert tiny[10][2] == 1 and tiny[11][2] == 1 and tiny[10][1] == 5  # scaled by their largest part first
    assert [(k, n - 2 * (k in (1, 2) or (k is None and c == 1)), c, kept) for k, n, c, kept in got if k not in (10, 11)] == expected


def test_no_rows(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    only = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert found(only) == [(1, 0, 1, True)]


def test_cells_lose_no_link():
    pick = np.random.default_rng(2)
    units = pick.normal(size=(400, 6))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    centres = embedding_dedup.spherical_kmeans(units, 9)
    home, visits = embedding_dedup.cells_of(units, centres, 0.95)
    a, b = np.nonzero(units @ units.T >= 0.95)
    assert visits[a, home[b]].all() and not visits.all()
