import numpy as np

from pyspark.sql import functions as F

from crossgauge.operators import bootstrap as B
from crossgauge.operators import neighbours as N
from crossgauge.operators import relational as R
from crossgauge.operators.diagnose import collapsed, route
from crossgauge.operators.models import translate_distinct
from crossgauge.sources import io as S


def test_macro_f1_counts_absent_classes(spark):
    df = spark.createDataFrame([(g, p) for g, p in zip((0, 0, 1, 1), (0, 0, 0, 1), strict=True)], "gold int, pred int").withColumn("k", F.lit("a"))
    r = R.classification(df, ["k"], "gold", "pred", 3).first()
    assert r["accuracy"] == 0.75 and abs(r["macro_f1"] - 0.488889) < 1e-6


def test_mean_std_of_one_row_is_zero(spark):
    r = R.mean_std(spark.createDataFrame([("a", 1.5)], "k string, v double"), ["k"], "v").first()
    assert (r["mean"], r["std"], r["n"]) == (1.5, 0.0, 1)


def test_mutual_nearest_breaks_ties_by_id(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    b = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "id long, v array<double>")
    for block in (1, 100):
        assert [(r["l"], r["r"]) for r in N.mutual_nearest(a, b, 0.5, block).collect()] == [(1, 7)]
    assert N.mutual_nearest(a, b.limit(0), 0.5).count() == 0 and N.mutual_nearest(a.limit(0), b, 0.5).count() == 0


def test_upsert_replaces_only_its_keys(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, R.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_verdicts(spark):
    rows = [("held", True, 0.1), ("held", True, 0.2), ("one", True, 0.1), ("one", False, 0.2), ("dis", True, 0.1), ("dis", True, -0.2), ("noise", False, 0.1), ("noise", False, -0.2)]
    v = {r["m"]: r["verdict"] for r in B.verdict(spark.createDataFrame(rows, "m string, s boolean, d double"), ["m"], "s", "d", "encoder").collect()}
    assert v == {"held": "held", "one": "one encoder only", "dis": "encoders disagree", "noise": "within noise"}


def test_shares_sum_to_one_and_keep_absent_labels(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b")], "k string, label string")
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    s = {r["label"]: r["share"] for r in R.shares(df, ["k"], "label", labels).collect()}
    assert s["c"] == 0 and abs(sum(s.values()) - 1) < 1e-12


def test_gate_is_final(spark):
    df = spark.createDataFrame([(0.1, ["frag"]), (0.9, ["morph", "frag"]), (0.9, [])], "labse_sim double, modules_fired array<string>")
    assert [r["assigned"] for r in route(df, 0.2).orderBy("labse_sim", F.size("modules_fired").desc()).collect()] == ["translation_drift", "tokenizer_fragmentation", "unattributed"]


def test_collapse_needs_the_cutoff(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("a", 0)] + [("b", 1), ("b", 0)], "k string, p int")
    assert sorted((r["k"], r["p"], r["collapsed"]) for r in collapsed(df, ["k"], "p", 0.75).distinct().collect()) == [("a", 0, False), ("a", 1, True), ("b", 0, False), ("b", 1, False)]


def test_stratified_split_is_disjoint_and_exhaustive(spark):
    x = R.stratified_split(spark.range(100).withColumn("s", F.col("id") % 2), "s", "id", 1, 0.1, 0.2)
    assert {r["split"]: r["count"] for r in x.groupBy("split").count().collect()} == {"train": 70, "dev": 10, "test": 20}


def test_failing_batches_are_halved(spark):
    def translate(texts):
        if "bad" in texts:
            raise RuntimeError
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("a",), ("bad",), ("b",), ("a",), (None,)], "t string")
    rows = sorted(((r["t"] or "", r["x"]) for r in translate_distinct(df, "t", "x", translate).collect()))
    assert rows == [("", None), ("a", "A"), ("a", "A"), ("b", "B"), ("bad", None)]


def test_upsert_table_touches_only_its_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    S.write_partitioned(spark.createDataFrame([("x", 1, "a"), ("y", 1, "b")], "p string, k int, v string"), path, "p")
    S.upsert_table(spark.createDataFrame([("x", 1, "c"), ("x", 2, "d")], "p string, k int, v string"), path, ["p", "k"], "p")
    assert sorted((r["p"], r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("x", 1, "c"), ("x", 2, "d"), ("y", 1, "b")]


def test_manifest_finds_a_planted_change(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "block string, t string")
    bad = df.withColumn("t", F.when(F.col("block") == "a", "x").otherwise(F.col("t")))
    assert [tuple(r) for r in S.verify_manifest(S.manifest(df, "block"), S.manifest(bad, "block"), "block").collect()] == [("a", "changed")]


def test_upsert_stream(spark, tmp_path):
    from crossgauge.streaming.upsert import upsert_stream

    path, src = f"file://{tmp_path}/t", f"{tmp_path}/src"
    schema = "p string, k int, v string"
    S.write_partitioned(spark.createDataFrame([("x", 1, "a")], schema), path, "p")
    spark.createDataFrame([("x", 1, "b"), ("x", 2, "c")], schema).write.parquet(src)
    upsert_stream(spark.readStream.schema(schema).parquet(src), path, ["p", "k"], ["p"], f"{tmp_path}/cp").awaitTermination(60)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "b"), (2, "c")]


def test_logistic_baseline_takes_whole_vectors(spark):
    """The registered baseline against a local solution on the rows that its hash deals to training."""
    from crossgauge.operators import training as T
    from crossgauge.plans import q_io
    from tests.conftest import SF
    from tests.test_training import newton

    x = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("part", T.dealt(F.col("vec_id"))).collect()
    v, y = (np.array([r[c] for r in x if r["part"] == "train"], float) for c in ("embedding", "label"))
    got = sorted(q_io.trained_baseline(spark, SF).collect())
    w = np.array([r["w"] for r in got])
    assert len(w) == v.shape[1] + 1 and {r["stopped"] for r in got} <= {"converged", "early", "limit"}
    best = newton(v, (y == 0).astype(float), 1e-2)
    loss = lambda w: T.Logistic(w).loss(v, (y == 0).astype(float))[0] / len(y) + 1e-2 * (w[:-1] @ w[:-1]) / 2
    assert loss(best) <= loss(w) + 1e-12 and loss(w) < loss(np.zeros(len(w)))
    if got[0]["stopped"] != "early":
        assert loss(w) - loss(best) < 1e-4
