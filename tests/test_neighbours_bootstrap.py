"""Nearest neighbours with skipped cells against all pairs; binomial splitting against exact distributions."""

import time
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgauge.operators import bootstrap as B
from crossgauge.operators import neighbours as N
from crossgauge.operators import relational as R


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(rng, n, clusters=40, dim=16, spread=0.05):
    centres = unit(np.random.default_rng(0).normal(size=(clusters, dim)))
    return unit(centres[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, dim)))


@pytest.mark.parametrize("kind", ["clustered", "random", "norms", "ties"])
def test_search_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "clustered":
        q, x = clustered(rng, 700), clustered(rng, 2500)
    elif kind == "random":  # nothing can be skipped
        q, x = unit(rng.normal(size=(200, 32))), unit(rng.normal(size=(600, 32)))
    elif kind == "norms":  # vectors of any length: products, not angles, count
        q, x = clustered(rng, 200) * rng.uniform(0.1, 3, (200, 1)), clustered(rng, 900) * rng.uniform(0.1, 3, (900, 1))
    else:
        x = np.repeat(np.eye(8), 30, axis=0)
        q = np.repeat(np.eye(8), 5, axis=0)
    found, probes, cells = N.search(frame(spark, q), frame(spark, x, 10_000), block=100)
    got = {r["id"]: (r["other"], r["sim"]) for r in found.collect()}
    sim = q @ x.T
    assert len(got) == len(q)
    for i, row in enumerate(sim):
        other, s = got[i]
        assert s == pytest.approx(row.max(), abs=1e-9) and row[other - 10_000] == pytest.approx(row.max(), abs=1e-9)
        if kind == "ties":
            assert other == 10_000 + int(np.argmax(row))
    work = sum(int(cells.size[r["cell"]]) for r in probes.collect()) / sim.size
    if kind == "clustered":
        assert work < 0.2
    if kind == "random":
        assert work > 0.9


def test_both_sides_and_nulls(spark):
    rng = np.random.default_rng(5)
    a, b = frame(spark, clustered(rng, 300)), frame(spark, clustered(rng, 400), 1000)
    a = a.union(spark.createDataFrame([(5000, None)], "id long, v array<double>"))
    want = {(r["side"], r["id"], r["other"]) for r in R.nearest(a, b).collect()}
    assert {(r["side"], r["id"], r["other"]) for r in N.nearest(a, b, block=50).collect()} == want
    assert {(r["side"], r["id"], r["other"]) for r in N.nearest(a, b, "r", block=50).collect()} == {x for x in want if x[0] == "r"}
    none = a.limit(0)
    assert N.search(none, b)[0].count() == 0 and N.search(a, none)[0].count() == 0


def test_tables_of_fair_coins_are_exact():
    for k in (0, 1, 3, 6):
        n = 1 << k
        first, table = B.fair_coins(k)
        cdf = [(sum(comb(n, i) for i in range(j + 1)) << 32) >> n for j in range(n + 1)]
        assert [x for x in cdf if 0 < x < 1 << 32] == list(table) and first == sum(x == 0 for x in cdf)


def test_splitting_draws_a_multinomial():
    counts = [3, 0, 500, 96, 1]
    m = B.multinomial(counts, np.arange(20_000))
    p = np.array(counts) / 600
    assert (m.sum(1) == 600).all() and (m >= 0).all() and (m[:, 1] == 0).all()
    assert np.abs(m.mean(0) - 600 * p).max() < 5 * np.sqrt(600 * 0.25 / 20_000)
    assert np.allclose(np.cov(m.T), 600 * (np.diag(p) - np.outer(p, p)), atol=3)
    one = np.bincount(m[:, 4], minlength=4)[:4] / 20_000  # a cell of one row: about Poisson(1)
    exact = [comb(600, j) * (1 / 600) ** j * (599 / 600) ** (600 - j) for j in range(4)]
    assert np.abs(one - exact).max() < 0.015


def test_cost_is_free_of_rows_and_of_how_many_cells_there_are(spark):
    B.multinomial([1 << 29, 1 << 29], np.arange(2))  # tables
    took = []
    for n in (1_000, 1_000_000_000):
        start = time.time()
        m = B.multinomial([n // 5, n // 5 * 4], np.arange(2000))
        took.append(time.time() - start)
        assert (m.sum(1) == n).all() and abs(m[:, 0].mean() / (n / 5) - 1) < 0.01
    assert took[1] < 20 * took[0] + 0.5  # log2(n) tables, not n
    cells = spark.createDataFrame([("k", i, 7) for i in range(40)] + [(None, 0, 5), ("z", 0, 0)], "key string, c int, n int")
    draws = B.resampled(cells, ["key"], ["c"], "n", 300)
    totals = {(r["key"], r["s"], r["c"]) for r in draws.groupBy("key", "b").agg(F.sum("m").alias("s"), F.count("*").alias("c")).collect()}
    assert totals == {("k", 280, 40), (None, 5, 1)}
    assert draws.select("b").distinct().count() == 300
