"""Refined quantiles against numpy, for many shapes of data."""

import numpy as np
import pytest

from crossgauge.operators.quantiles import quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.731, 1.0]


@pytest.mark.parametrize("bins", [7, 1024])
def test_quantiles_equal_numpy(spark, bins):
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.random(3000), "ties": rng.integers(0, 4, 2000) / 3, "tails": np.concatenate((np.exp(rng.normal(size=500) * 20), -np.exp(rng.normal(size=300) * 20))),
        "one": np.array([4.5]), "two": np.array([1.0, 2.0]), "equal": np.full(700, -3.25), None: rng.normal(size=400), "huge": np.array([-1.7e308, 0.0, 1.7e308]),
    }
    rows = [(k, i, float(v)) for k, vs in groups.items() for i, v in enumerate(vs)] + [("even", 0, None), ("none", 0, None), ("nan", 0, float("nan")), ("two", 0, float("nan"))]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    got = {r["k"]: r["q"] for r in quantiles(df, ["k"], "v", PROBS, small=0, bins=bins).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        want = np.array([np.quantile(vs, p) for p in PROBS]) if k != "huge" else None
        if k != "huge":
            assert got[k] == pytest.approx(want, rel=1e-12, abs=1e-300), k
    assert got["huge"][0] == -1.7e308 and got["huge"][3] == 0.0 and got["huge"][5] == 1.7e308
    assert quantiles(df.limit(0), ["k"], "v", PROBS, small=0).count() == 0


def test_both_ways_give_the_same_rows(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(rng.integers(0, 3, 900), rng.integers(0, 2, 900), rng.normal(size=900), strict=True)], "a int, b int, v double")
    for keys in (["a", "b"], ["a"], []):
        one, two = ({tuple(r[k] for k in keys): r["q"] for r in quantiles(df, keys, "v", [0.1, 0.9], small=s).collect()} for s in (0, 1 << 20))
        assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
