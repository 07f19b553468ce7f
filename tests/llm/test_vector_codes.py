import hashlib
import math
import random

from pyspark.sql import functions as F

from postprism.llm import catalog, vector_codes


def brute(rows):
    kept = []
    for key, vector, label in rows:
        if vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((key, [max(-(1 << 26), min(1 << 26, math.floor(256 * x))) for x in vector], label))
    kept.sort(key=lambda row: (row[0] is None, row[0] or 0, row[1]))
    cut = lambda v: [tuple(v[i * len(v) // 16 : (i + 1) * len(v) // 16]) for i in range(16)]
    parts = [cut(row[1]) for row in kept]
    books = [[part[p] for part in parts[:64]] for p in range(16)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(p, x):
        return min((apart(x, entry), e) for e, entry in enumerate(books[p]))

    for _ in range(2):
        chosen = [[nearest(p, part[p])[1] for p in range(16)] for part in parts]
        for p in range(16):
            for e in range(len(books[p])):
                own = [part[p] for part, codes in zip(parts, chosen, strict=True) if codes[p] == e]
                if own:
                    books[p][e] = tuple(sum(column) // len(own) for column in zip(*own, strict=True))
    last = [[nearest(p, part[p]) for p in range(16)] for part in parts]
    errors = [sum(d for d, _ in row) for row in last]
    of_label = {}
    for (_, _, label), error in zip(kept, errors, strict=True):
        of_label[label] = of_label.get(label, 0) + error
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    out = [(key, "".join(f"{e:02x}" for _, e in row), error, of_label[label], digest) for (key, _, label), row, error in zip(kept, last, errors, strict=True)]
    return sorted(out, key=str)


def check(spark, tmp_path, rows, kind="float"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    path = str(tmp_path / "in")
    table.withColumns({"row": F.lit(1), "entry": F.lit(2), "key": F.lit("x"), "position": F.lit(3)}).write.parquet(f"{path}/embeddings.parquet")
    got = catalog.op11_vector_codes(spark, path)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [tuple(row) for row in table.collect()]  # floats as they are stored
    assert sorted((tuple(row) for row in got.collect()), key=str) == brute(rows)


def vectors(seed, n, width=32, spread=0.4):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(width)] for _ in range(20)]
    return [(i * 3 % 1_009, [x + pick.gauss(0, spread) for x in pick.choice(centres)], pick.choice([0, 0, 0, 1, 2, None])) for i in range(n)]


def test_equals_brute_force(spark, tmp_path):
    check(spark, tmp_path, vectors(1, 400))


def test_hot_group_and_ties(spark, tmp_path, monkeypatch):
    """Half of the rows are one vector, entries of the first codebook are equal, and owners hold few members."""
    monkeypatch.setattr(vector_codes, "MEMBERS", 5)
    rows = vectors(2, 150, 16)
    check(spark, tmp_path, rows + [(2_000 + i, rows[0][1], 7) for i in range(150)] + [(-i, rows[1][1], None) for i in range(1, 20)])


def test_odd_rows(spark, tmp_path):
    rows = vectors(3, 30, 16)
    nan, inf = float("nan"), float("inf")
    odd = [(900, None, 1), (901, [nan] * 16, 1), (902, [None] + [0.0] * 15, 1), (903, [inf] + [0.0] * 15, None), (904, [-inf] * 16, 1)]
    check(spark, tmp_path, rows + odd + rows[:3] + [(None, [0.25] * 16, 1), (905, [3e38] + [0.0] * 15, 1), (906, [0.0] * 16, 1), (906, [-0.0] * 16, 1)], "double")


def test_fewer_vectors_than_entries_and_none(spark, tmp_path):
    check(spark, tmp_path / "few", vectors(4, 5, 16))
    check(spark, tmp_path / "one", vectors(4, 1, 16))
    check(spark, tmp_path / "none", [(1, None, 1)])


def test_other_lengths_are_left_out(spark):
    rows = [(5, [1.0] * 32, 1), (1, [1.0] * 17, 1), (2, [], 1), (7, [1.0] * 16, 1), (6, [2.0] * 32, 1)]
    found, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(row.vec_id for row in found.collect()) == [5, 6] and books.shape == (16, 2, 2)


def test_decode(spark):
    rows = vectors(5, 40, 16)
    found, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    for row in found.select("entries", vector_codes.decode(F.col("entries"), books).alias("vector")).collect():
        assert row.vector == [x / 256 for p, e in enumerate(row.entries) for x in books[p, e].tolist()]
