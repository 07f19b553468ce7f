import zlib

import pandas as pd

from postprism.llm import sharding
from tests.llm.conftest import prose


def test_longest_first_takes_the_least_loaded():
    units = pd.Series([7, 5, 4, 3, 2, 2], index=pd.Index(list("abcdef"), name="unit"), name="size")
    assert sharding.longest_first(units, 2).to_dict() == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1, "f": 0}


def check(rows, out, shards):
    out["text"] = out["doc_id"].map(dict(rows)).where(out["doc_id"].notna(), None)
    assert len(out) == len(rows)
    assert all(sorted(group["slot"]) == list(range(len(group))) for _, group in out.groupby("shard"))
    assert out["shard"].between(0, shards - 1).all() and (out["law"] == "bytes").all() and out["grown_shard"].isna().all()
    known = out[out["text"].notna()]
    assert (known.groupby("text")["shard"].nunique() == 1).all()
    assert (known["size"] == known["text"].map(lambda text: len(text.encode()) + 8)).all()
    assert (known["text_crc32"] == known["text"].map(lambda text: zlib.crc32(text.encode()))).all()


def test_near_equal_and_together(spark):
    rows = [(i, prose(i // 3, 20 + i % 50)) for i in range(3_000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    check(rows, out, 24)
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 24 and loads.max() <= 1.02 * loads.min()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(row.doc_id, row.text) for row in odd_docs.collect()]
    out = sharding.shard(odd_docs, 5).toPandas()
    check(rows, out, 5)
    assert out.loc[out["doc_id"] == 3, ["size", "text_crc32"]].values.tolist() == [[8, 0]]
    assert sharding.shard(no_docs).count() == 0


def test_one_text_on_a_third_of_all_rows(spark):
    rows = [(i, "copied " * 30 if i % 3 == 0 else prose(i, 30)) for i in range(1_200)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).toPandas()
    check(rows, out, 4)
    assert out.loc[out["doc_id"] % 3 == 0, "shard"].nunique() == 1


def test_runs_are_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RUN", 7)
    rows = [(i, prose(i, 12)) for i in range(400)]
    check(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 3).toPandas(), 3)
