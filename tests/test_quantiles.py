import random

import numpy as np
import pytest
from rowtools import as_tuples
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postprism.operators.quantiles import grouped_quantiles, value_counts

FRACTIONS = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.9}


def check(spark, data, bits):
    df = spark.createDataFrame(data, "skill long, cents long")
    got = grouped_quantiles(value_counts(df, ["skill"], "cents"), ["skill"], "cents", FRACTIONS, bucket_bits=bits)
    groups = {}
    for skill, cents in data:
        if skill is not None and cents is not None:
            groups.setdefault(skill, []).append(cents)
    rows = {row["skill"]: row for row in got.collect()}
    assert rows.keys() == groups.keys()
    for skill, values in groups.items():
        row = rows[skill]
        assert (row["n"], row["total"], row["low"], row["high"]) == (len(values), sum(values), min(values), max(values))
        for name, fraction in FRACTIONS.items():
            assert row[name] == pytest.approx(np.quantile(values, fraction), rel=1e-12)


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_against_numpy(spark, bits):
    draw = random.Random(bits)
    data = [(draw.choice([1, 2, 3, 4]), draw.randrange(0, 10**6)) for _ in range(3000)]
    data += [(5, 700)] * 100 + [(6, 1), (6, 10**11), (7, None), (None, 3)]
    check(spark, data, bits)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 200)), min_size=1, max_size=40), st.integers(0, 6))
def test_any_values(spark, data, bits):
    check(spark, data, bits)


def test_hot_group(spark):
    """A third of all rows in one group."""
    data = [(0 if i % 3 == 0 else i % 50, (i * 7919) % 100003) for i in range(6000)]
    check(spark, data, 8)


def test_no_keys_and_no_rows(spark):
    df = spark.createDataFrame([(5,), (1,), (9,), (None,)], "cents long")
    whole = grouped_quantiles(value_counts(df, [], "cents"), [], "cents", {"median": 0.5})
    assert as_tuples(whole) == [(3, 15, 1, 9, 5.0)]
    empty = grouped_quantiles(value_counts(df.where("false"), [], "cents"), [], "cents", {"median": 0.5})
    assert as_tuples(empty) == [(0, None, None, None, None)]


def test_counts_are_shuffled_once(spark, folder):
    """Both uses of the counts share one exchange: the source is read once."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    df = orders.selectExpr("o_custkey % 7 as skill", "o_orderkey as cents")
    result = grouped_quantiles(value_counts(df, ["skill"], "cents"), ["skill"], "cents", {"median": 0.5})
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
    assert "CartesianProduct" not in plan
