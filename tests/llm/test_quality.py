import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from postprism.llm import quality
from tests.llm.conftest import prose


def junk(seed):
    pick = random.Random(seed)
    return "".join(f"{word.upper()}{pick.choice(['!!', '$$$', '***'])} " for word in prose(seed, 60).split())


def tables(spark, rows):
    docs = spark.createDataFrame([(i, junk(i) if i % 4 == 0 else prose(i, 80)) for i in range(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(rows)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = tables(spark, 400)
    model = quality.fit(docs, labels)
    assert len(model.labels) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(400))
    scored = docs.select("doc_id", quality.held_out().alias("held"), quality.score(docs, model).alias("score")).toPandas()
    held = scored[scored["held"]]
    assert len(held) > 50 and (((held["score"] >= quality.THRESHOLD) == (held["doc_id"] % 4 != 0)).mean()) > 0.98
    assert scored["score"].between(0, 1).all()


def test_held_out_rule(spark):
    out = spark.range(200).select("id", quality.held_out("id").alias("held")).collect()
    assert all(row.held == (zlib.crc32(str(row.id).encode()) % 5 == 0) for row in out)


def test_held_out_labels_change_nothing(spark):
    docs, labels = tables(spark, 200)
    wrong = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, wrong)
    assert np.array_equal(a.labels, b.labels) and np.allclose(a.vectors, b.vectors)


def test_votes_equal_brute_force(spark):
    docs, labels = tables(spark, 120)
    model = quality.fit(docs, labels)
    rows = np.stack([quality.features(row.text.encode()) for row in docs.limit(15).collect()])
    for got, own in zip(model.scores(rows), model.project(rows), strict=True):
        cosines = [float(own @ other) for other in model.vectors]
        near = sorted(range(len(cosines)), key=lambda i: -cosines[i])[: quality.NEIGHBOURS]
        votes = [max(cosines[i], 1e-6) ** quality.SHARPNESS * model.weights[i] for i in near]
        assert abs(got - sum(v for v, i in zip(votes, near) if model.labels[i]) / sum(votes)) < 1e-6


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_PER_LABEL", 10)
    docs, labels = tables(spark, 200)
    assert sorted(quality.fit(docs, labels).labels) == [0.0] * 10 + [1.0] * 10


def test_whole_texts_in_pieces(monkeypatch):
    text = prose(3, 500).encode()
    whole = quality.features(text)
    monkeypatch.setattr(quality, "_PIECE", 97)
    assert np.allclose(quality.features(text), whole)


def test_odd_rows(spark, odd_docs, no_docs):
    docs, labels = tables(spark, 100)
    model = quality.fit(docs, labels.withColumn("text", F.lit("clash")))
    out = odd_docs.select("doc_id", "text", quality.score(odd_docs, model).alias("quality_score")).toPandas()
    assert out["quality_score"].between(0, 1).all()
    same = out[out["doc_id"].isin([3, 4])]["quality_score"]
    assert same.nunique() == 1
    assert no_docs.select(quality.score(no_docs, model)).count() == 0
    for texts, marks in ((no_docs, labels), (docs, labels.limit(0)), (docs, labels.withColumn("quality", F.lit(None).cast("int")))):
        bare = quality.fit(texts, marks)
        assert set(odd_docs.select(quality.score(odd_docs, bare).alias("s")).toPandas()["s"]) == {0.5}
