"""Quantiles by selection, held against NumPy over all values."""

import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.operators import profiling, ranks

POINTS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=50))
def test_keys_keep_order_and_values(values):
    keys = ranks.to_keys(np.array(values))
    assert [float(x) for x in ranks.from_keys(keys)] == [v + 0.0 for v in values]
    assert [values[i] for i in np.argsort(keys, kind="stable")] == sorted(values)


@pytest.mark.parametrize("seed", range(2))
def test_quantiles_are_those_of_all_values(spark, seed):
    draw = random.Random(seed)
    kinds = {
        "plain": lambda: draw.gauss(0, 1), "wide": lambda: draw.choice([-1, 1]) * 10.0 ** draw.randint(-300, 300), "ties": lambda: float(draw.choice([3, 3, 3, 7])), "close": lambda: 1 + draw.randint(0, 9) * 2**-52,
        "holes": lambda: draw.choice([None, math.nan, 5.0, -5.0]), "zeros": lambda: draw.choice([0.0, -0.0, 5e-324, -5e-324]), "one": lambda: 4.5, "none": lambda: None,
    }
    rows = [tuple(make() for make in kinds.values()) for _ in range(997)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in kinds)).repartition(7)
    found = ranks.quantiles(df, list(kinds), POINTS)
    assert found.pop("none") == [None] * len(POINTS)
    for k, name in enumerate(kinds):
        if name != "none":
            values = [r[k] for r in rows if r[k] is not None and not math.isnan(r[k])]
            for got, want, p in zip(found[name], np.quantile(values, POINTS), POINTS):
                at = sorted(values)[int(p * (len(values) - 1))]
                assert got == pytest.approx(want, rel=1e-12, abs=0) or got == at == want, (name, p)


def test_integers_and_odd_tables(spark):
    df = spark.createDataFrame([(k, None) for k in (9, 1, 5)], "`a.b` int, n double")
    assert ranks.quantiles(df, ["a.b"], [0.5, 0.75]) == {"a.b": [5.0, 7.0]}
    assert ranks.quantiles(df.where("false"), ["a.b"], [0.5]) == {"a.b": [None]}
    assert ranks.quantiles(df, [], [0.5]) == {}


def test_both_ways_describe_alike(spark):
    df = spark.createDataFrame([(k, k * 0.37 % 5, "x") for k in range(101)], "a int, b double, c string")
    assert profiling.describe(df).collect() == profiling.describe(df, few=True).collect()
    empty = profiling.describe(df.where("false")).collect()
    assert [r["count"] for r in empty] == [0, 0] and empty[0]["p50"] is None
