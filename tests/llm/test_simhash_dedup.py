import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postprism.llm import simhash_dedup
from postprism.llm.buckets import groups_in_buckets
from postprism.llm.components import connected_components
from tests.llm.conftest import prose, smallest_reachable


def brute_fingerprint(text):
    lowered = re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(shingle, 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(value >> bit & 1 for value in hashes) > len(hashes))


def test_golay_reaches_every_word_two_bits_away():
    code, pick = simhash_dedup.Golay(), random.Random(3)
    words = np.array([pick.getrandbits(23) for _ in range(300)])
    keys = code.keys(words)
    assert {len(set(row)) for row in keys.tolist()} <= {1, 6}
    for a in range(23):
        for b in range(a, 23):
            others = code.keys(words ^ (1 << a) ^ (1 << b if b > a else 0))
            assert all(set(x) & set(y) for x, y in zip(keys.tolist(), others.tolist()))


def test_keys_meet_within_two_bits(spark):
    pick = random.Random(5)
    base = [pick.getrandbits(64) for _ in range(40)]
    near = [value ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) for value in base]
    signed = [(value - (1 << 64) if value >> 63 else value,) for value in (*base, *near)]
    found = simhash_dedup.golay_keys(spark.createDataFrame(signed, "fingerprint long")).toPandas()
    keys = found.groupby("node")["bucket"].agg(set)
    assert all(keys[a] & keys[b] for (a,), (b,) in zip(signed[:40], signed[40:]))


def test_equals_brute_force(spark, odd_docs):
    pick = random.Random(9)
    rows = [(100 + i, prose(50, 400) + " " + prose(60 + i, pick.randrange(4))) for i in range(60)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = [(row.doc_id, row.text) for row in docs.collect()]
    prints = [brute_fingerprint(text) for _, text in texts]
    tops = smallest_reachable(range(len(texts)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    expected = []
    for i, (key, _) in enumerate(texts):
        keys = [texts[j][0] for j in tops if tops[j] == tops[i] and texts[j][0] is not None]
        expected.append((key, prints[i], min(keys, default=None)))
    got = [(row.doc_id, row.fingerprint % (1 << 64), row.component_id) for row in simhash_dedup.simhash_groups(docs).collect()]
    order = lambda row: str(row)
    assert sorted(got, key=order) == sorted(expected, key=order)


def test_further_columns_and_no_rows(odd_docs, no_docs):
    assert simhash_dedup.simhash_groups(odd_docs).count() == odd_docs.count()
    assert simhash_dedup.simhash_groups(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    pick = random.Random(seed)
    chain = [(i, i + 1) for i in range(0, 200)]
    links = chain + [(pick.randrange(300, 500), pick.randrange(300, 500)) for _ in range(120)] + [(700, 600), (None, 3), (9, 9)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = {frozenset(link) for link in links if None not in link and link[0] != link[1]}
    nodes = {node for link in real for node in link}
    assert found == smallest_reachable(nodes, lambda a, b: frozenset((a, b)) in real)


def test_hot_bucket_is_not_paired(spark):
    """Three thousand near-equal codes of one bucket: compared with the smallest node, not with each other."""
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        return pairs

    keys = spark.range(3_000).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("node"))
    codes = spark.range(3_000).select(F.col("id").alias("node"), (F.col("id") % 2).alias("code"))
    groups = groups_in_buckets(keys, simhash_dedup.within(1), codes, verify)
    assert groups.select("component").distinct().count() == 1 and groups.count() == 3_000
    assert seen == [2_999, 0]
