"""The distributed trainer against a local solver, attribution against sums and finite differences, footers against planted faults."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgauge.operators import training as T
from crossgauge.sources import files as FS


def problem(seed, n=400, dim=6, noise=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    y = (x @ rng.normal(size=dim) + noise * rng.normal(size=n) > 0.3).astype(float)
    return x, y


def frame(spark, x, y, part):
    return spark.createDataFrame([(v.tolist(), float(t), p) for v, t, p in zip(x, y, part, strict=True)], "x array<double>, y double, part string").repartition(3).cache()


def newton(x, y, l2):
    """Iteratively reweighted least squares."""
    a, w = np.column_stack((x, np.ones(len(x)))), np.zeros(x.shape[1] + 1)
    free = np.append(np.ones(x.shape[1]), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        g = a.T @ (p - y) / len(y) + l2 * free * w
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(y) + l2 * np.diag(free), g)
    return w


def test_training_equals_a_local_solver(spark):
    x, y = problem(1)
    fit = T.train(frame(spark, x, y, ["train"] * len(x)), 7, l2=1e-2, tolerance=1e-9)
    assert fit.stopped == "converged" and len(fit.history) < 60 and not fit.overfit
    assert np.abs(fit.weights - newton(x, y, 1e-2)).max() < 1e-6
    losses = [h[1] for h in fit.history]
    assert losses[-1] < losses[0]


def test_early_stop_keeps_the_best_and_tells_overfit(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 40)), rng.integers(0, 2, 60).astype(float)  # nothing to learn, much to remember
    part = ["val" if i % 3 == 0 else "train" for i in range(60)]
    fit = T.train(frame(spark, x, y, part), 41, l2=1e-6, rounds=40, patience=3)
    assert fit.stopped == "early" and len(fit.history) < 40
    val = [h[2] for h in fit.history]
    model = T.Logistic(fit.weights)
    use = np.array([p == "val" for p in part])
    assert model.loss(x[use], y[use])[0] / use.sum() == pytest.approx(min(val), abs=1e-9)
    long = T.train(frame(spark, x, y, part), 41, l2=1e-6, rounds=12, patience=100)
    assert long.stopped == "limit" and long.overfit


def test_parts_are_dealt_by_key(spark):
    x = spark.range(5000).select(F.col("id"), T.dealt(F.col("id")).alias("part"))
    share = x.where("part = 'val'").count() / 5000
    assert 0.17 < share < 0.23 and x.exceptAll(x.repartition(7)).count() == 0


@pytest.mark.parametrize("kind", ["logistic", "tanh"])
def test_attributions_are_complete(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 5))
    model = T.Logistic(rng.normal(size=6)) if kind == "logistic" else T.Tanh(rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), 0.5)
    base = rng.normal(size=5)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(99, None, "null")]
    df = spark.createDataFrame(rows, "id int, v array<double>, delta_ string").repartition(3)
    got = {r["id"]: r for r in T.integrated_gradients(df, "v", model, base, steps=300).collect()}
    assert got[99]["attribution"] is None and got[99]["delta"] is None and len(got) == 51
    for i, v in enumerate(x):
        want = model.value(v[None, :])[0] - model.value(base[None, :])[0]
        assert got[i]["delta"] == pytest.approx(want, abs=1e-12) and abs(got[i]["residual"]) < 1e-4
        assert sum(got[i]["attribution"]) == pytest.approx(want, abs=1e-4)
    step = 1e-6  # gradients by differences
    p, g = model.value_and_gradient(x[:3])
    for j in range(5):
        moved = x[:3].copy()
        moved[:, j] += step
        assert np.allclose((model.value(moved) - p) / step, g[:, j], atol=1e-4)
    assert T.integrated_gradients(df.limit(0), "v", model).count() == 0


def test_footers_show_planted_faults_only(spark, tmp_path):
    root = f"file://{tmp_path}"
    x = spark.createDataFrame([(1, "a", 0.5)], "id long, t string, s double").coalesce(1)
    x.write.parquet(f"{root}/enc=base/good")
    x.drop("t").withColumn("s", F.col("s").cast("float")).write.parquet(f"{root}/enc=base/bad")
    x.limit(0).coalesce(1).write.parquet(f"{root}/enc=base/none")
    x.write.parquet(f"{root}/unnamed")
    (tmp_path / "enc=base" / "broken.parquet").write_bytes(b"PAR1 not really")
    found = FS.footers(spark, root).select("path", "rows", FS.contract_faults(["enc"], {"id": "int64", "t": "string", "s": "double"}).alias("f")).collect()
    by = {r["path"].split(str(tmp_path))[1].split("/part-")[0]: r["f"] for r in found}
    assert by == {"/enc=base/good": [], "/enc=base/bad": ["no column t", "column s is float"], "/enc=base/none": ["no rows"], "/unnamed": ["no partition key enc"], "/enc=base/broken.parquet": ["not readable"]}
