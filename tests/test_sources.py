"""Vector store, Merkle manifest, tree hashes and run folders against plain restatements and planted faults."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from crossgauge.operators.models import hash_embedder
from crossgauge.sources import files as FS
from crossgauge.sources import io as S
from crossgauge.sources import merkle as MK
from crossgauge.sources import vectors as VS


def test_store_embeds_each_text_once(spark, tmp_path):
    path, embed = f"file://{tmp_path}/store", hash_embedder(8)
    x = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c", None, "", "a b", "d e f"])], "id int, t string")
    assert VS.read(spark, path).count() == 0
    assert VS.update(x, "t", path, embed) == 4  # null and empty are one text
    assert VS.update(x, "t", path, embed) == 0
    edited = x.withColumn("t", F.when(F.col("id") == 1, "c!").otherwise(F.col("t")))
    assert VS.update(edited, "t", path, embed) == 1
    assert [r["key"] for r in VS.stale(edited, "t", path).collect()] == [hashlib.sha256(b"\nc").hexdigest()]
    assert VS.update(x, "t", path, embed, "other model") == 4  # a model's vectors are its own
    got = {r["id"]: r["v"] for r in VS.lookup(edited, "t", path).collect()}
    direct = {r["id"]: r["v"] for r in edited.select("id", embed("t").alias("v")).collect()}
    assert got == direct and len(got) == 6
    assert sorted(r["version"] for r in VS.read(spark, path).select("version").distinct().collect()) == [0, 1, 2]


def test_embedder_equals_its_plain_rule(spark):
    texts = ["one two two", "", None, "two", " x  y "]
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(hash_embedder(4)("t").alias("v")).collect()]
    for t, v in zip(texts, got, strict=True):
        want = [0.0] * 4
        for w in (t or "").split():
            h = hashlib.md5(w.encode()).digest()
            want[h[0] % 4] += 1 if h[1] & 1 else -1
        n = sum(x * x for x in want) ** 0.5
        assert v == pytest.approx([x / n if n else 0 for x in want], abs=1e-6)


def corpus(spark, rows):
    return spark.createDataFrame(rows, "id long, part string, text string").repartition(3)


@pytest.mark.parametrize("leaf", [1, 4, 1000])
def test_manifest_finds_what_was_planted(spark, tmp_path, leaf):
    rows = [(i, f"p{i % 3}", None if i % 11 == 0 else f"text {i}") for i in range(200)] + [(5, "p2", "a repeated key")]
    frozen = MK.freeze(corpus(spark, rows), f"file://{tmp_path}/m", "part", ["id"], leaf)
    assert MK.verify(frozen, corpus(spark, rows[::-1])).count() == 0
    changed = [r for r in rows if r[0] != 17]
    changed[3] = (3, "p0", "edited")
    changed[11] = (11, "p2", "")  # null became empty
    changed += [(900, "p1", "new"), (901, "p9", "a new part")]
    got = {(r["split"], r["key"], r["status"]) for r in MK.verify(frozen, corpus(spark, changed)).collect()}
    name = lambda i: hashlib.sha256(f"{len(str(i))}:{i}".encode()).hexdigest()
    assert got == {("p0", name(3), "changed"), ("p2", name(11), "changed"), ("p2", name(17), "missing"), ("p1", name(900), "unexpected"), ("p9", name(901), "unexpected")}
    nodes = frozen.nodes(spark)
    fan = nodes.where("level > 0").groupBy("split", "level", F.expr("substring(node, 1, level - 1)")).count().agg(F.max("count")).first()[0] or 0
    assert fan <= 16 and nodes.where("level = -1").first()["rows"] == 201
    actual = MK.tree(MK.row_digests(corpus(spark, changed), "part", ["id"], frozen.depth), frozen.depth)
    leaves = MK.changed_leaves(nodes, actual, frozen.depth)
    assert leaves.count() <= 5


def test_an_unequal_path_is_refused_and_an_empty_table_has_no_root(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    frozen = MK.freeze(corpus(spark, []), path, "part", ["id"])
    assert frozen.nodes(spark).count() == 0 and MK.verify(frozen, corpus(spark, [])).count() == 0
    assert [r["status"] for r in MK.verify(frozen, corpus(spark, [(1, "a", "x")])).collect()] == ["unexpected"]
    with pytest.raises(Exception, match="exist"):
        MK.freeze(corpus(spark, []), path, "part", ["id"])


def test_rows_never_share_a_text(spark):
    x = spark.createDataFrame([("1:a", "b"), ("1", "a:b"), (None, "-"), ("-", None), ("", None), (None, "")], "a string, b string")
    assert x.select(MK.row_text(["a", "b"]).alias("t")).distinct().count() == 6


def plain_tree(data, chunk, fan):
    level = [hashlib.sha256(data[i : i + chunk]).hexdigest() for i in range(0, max(1, len(data)), chunk)]
    while True:
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return level[0]


def test_tree_hashes_equal_a_plain_tree(spark, tmp_path):
    made = {"a.bin": os.urandom(1000), "b.bin": b"x" * 97, "c.bin": b"", "deep/d.bin": os.urandom(640)}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "other.txt").write_text("no")
    for chunk, fan in ((64, 3), (1 << 20, 1024)):
        got = {r["path"].rsplit("/", 1)[-1]: (r["length"], r["digest"]) for r in FS.tree_hashes(spark, f"file://{tmp_path}", "*.bin", chunk, fan).collect()}
        assert set(got) == {n.rsplit("/", 1)[-1] for n in made if made[n]}
        depth = max(-(-len(d) // chunk) for d in made.values())
        for name, data in ((n, x) for n, x in made.items() if x):
            want, steps = plain_tree(data, chunk, fan), 1
            n = -(-max(1, -(-len(data) // chunk)) // fan)
            while n > 1:
                n, steps = -(-n // fan), steps + 1
            most = 1
            while fan**most < depth:
                most += 1
            for _ in range(most - steps):  # all files' trees are as deep as the largest one's
                want = hashlib.sha256(want.encode()).hexdigest()
            assert got[name.rsplit("/", 1)[-1]] == (len(data), want)


def test_chunks_of_a_large_file_are_many_rows(spark, tmp_path):
    """A sparse file above 2 GB, which binaryFile could not hold as one value."""
    path = tmp_path / "large.bin"
    with open(path, "wb") as f:
        f.truncate((2 << 30) + 5)
    r = FS.tree_hashes(spark, f"file://{tmp_path}", "*.bin", 128 << 20).first()
    parts = [hashlib.sha256(bytes(128 << 20)).hexdigest()] * 16 + [hashlib.sha256(bytes(5)).hexdigest()]
    assert (r["length"], r["digest"]) == ((2 << 30) + 5, hashlib.sha256("".join(parts).encode()).hexdigest())


def test_run_folders(spark, tmp_path):
    for name, meta in (("task1_hin_base_seed0", {"config_hash": "h0", "accuracy": 0.5}), ("run_id=task2_ben_large_x_seed12", {"config_hash": "h1"}), ("task1_tel_seed3", None), ("notes", "{broken"), ("_hidden", {})):
        (tmp_path / name).mkdir()
        if meta is not None:
            (tmp_path / name / "meta.json").write_text(meta if isinstance(meta, str) else json.dumps(meta) + "\nmore")
            (tmp_path / name / "weights.bin").write_bytes(b"123")
    (tmp_path / "a_file").write_text("x")
    runs = {r["run_id"]: r for r in FS.read_runs(spark, f"file://{tmp_path}").collect()}
    assert set(runs) == {"task1_hin_base_seed0", "task2_ben_large_x_seed12", "task1_tel_seed3", "notes"}
    r = runs["task2_ben_large_x_seed12"]
    assert (r["task"], r["lang"], r["seed"], r["config_hash"], r["accuracy"], r["files"], r["readable"]) == ("task2", "ben", 12, "h1", None, 2, True)
    assert [runs[x]["readable"] for x in ("task1_tel_seed3", "notes")] == [False, False] and runs["notes"]["lang"] is None
    few = FS.read_runs(spark, f"file://{tmp_path}").where("lang = 'hin' AND accuracy > 0.1")
    assert [r["run_id"] for r in few.collect()] == ["task1_hin_base_seed0"]


def test_filters_leave_folders_out_of_the_listing(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    for i in range(5):
        (tmp_path / f"task1_hin_seed{i}").mkdir()
    reader = FS.RunsReader(str(tmp_path), 2)
    assert [len(p.value) for p in reader.partitions()] == [2, 2, 1]
    kept = list(reader.pushFilters([EqualTo(("seed",), 3), GreaterThan(("accuracy",), 0.5)]))
    assert kept == [GreaterThan(("accuracy",), 0.5)] and [p.value for p in reader.partitions()] == [[f"{tmp_path}/task1_hin_seed3"]]


def test_typed_configuration(spark):
    text = "# head\nepochs: 9  # comment\nlr: '0.25'\nname: \"a: b\"\nfrozen: TRUE\n\nodd line\nbeta: 1\nalpha: 2"
    x = spark.createDataFrame([(1, text, {"epochs": "4"}), (2, "epochs: many", {}), (3, "", {"gamma": "1"}), (4, None, {})], "id int, t string, o map<string,string>")
    got = [r["c"] and tuple(r["c"]) for r in x.select("id", S.typed_config(F.col("t"), {"epochs": 3, "lr": 0.1, "name": "x", "frozen": False}, F.col("o")).alias("c")).orderBy("id").collect()]
    assert got[:3] == [(4, 0.25, "a: b", True, ["alpha", "beta"]), (None, 0.1, "x", False, []), (3, 0.1, "x", False, ["gamma"])]
