"""Sources, sinks, manifests and the model boundary: inventory sections 2.1 and 2.11."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from crossgauge.operators import conditions as C
from crossgauge.operators import models as M
from crossgauge.operators import relational as R
from crossgauge.operators import training as TR
from crossgauge.plans import derived as D
from crossgauge.plans.registry import query
from crossgauge.sources import files as FS
from crossgauge.sources import io as S
from crossgauge.sources import merkle as MK
from crossgauge.sources import vectors as VS
from crossgauge.session import health, table, worker_versions

P = D.SQL_PREDS


@query("SNK-02", sql=f"""WITH {P}, old AS (SELECT lang, item_id, seed, pred_src AS pred FROM preds), new AS (SELECT lang, item_id, seed, pred_tgt AS pred FROM preds WHERE lang = 'de' AND seed = 1)
SELECT lang, item_id, seed, pred FROM new UNION ALL SELECT * FROM old WHERE NOT (lang = 'de' AND seed = 1)""")
def upserted_log(spark, d):
    p, path = D.predictions(spark, d), S.scratch(spark, "log")
    S.write_partitioned(p.select("lang", "item_id", "seed", F.col("pred_src").alias("pred")), path, "lang")
    S.upsert_table(p.where("lang = 'de' AND seed = 1").select("lang", "item_id", "seed", F.col("pred_tgt").alias("pred")), path, ["lang", "item_id", "seed"], "lang")
    return spark.read.parquet(path).select("lang", "item_id", "seed", "pred")


@query("SNK-04", sql=f"WITH {D.SQL_FAILURES} SELECT item_id, seed, label, label_group, CASE WHEN seed = 0 THEN 'fired' ELSE 'not_evaluated' END AS gate_status FROM fails")
def diagnostics_sink(spark, d):
    f = D.failures(spark, d).select("item_id", "seed", "label")
    a = f.where("seed = 0").withColumn("gate_status", F.lit("fired"))
    out = a.unionByName(f.where("seed <> 0"), allowMissingColumns=True).withColumn("label_group", D.label_group(F.col("label"))).fillna("not_evaluated", ["gate_status"])
    return out.select("item_id", "seed", "label", "label_group", "gate_status")


@query("SNK-05", "SRC-12", sql="SELECT 'task2_' || l_returnflag AS run_id, round(avg(l_discount), 6) AS accuracy FROM lineitem GROUP BY 1")
def run_log(spark, d):
    path = S.scratch(spark, "runs")
    x = table(spark, d, "lineitem").groupBy(F.concat(F.lit("task2_"), "l_returnflag").alias("run_id")).agg(F.avg("l_discount").alias("accuracy"))
    S.append_log(x, path)
    return S.read_log(spark, path, "run_id string, accuracy double")


@query("SNK-07", sql="WITH o(lang, ord) AS (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3)) SELECT lang, count(*) AS n, any_value(ord) AS place FROM documents JOIN o USING (lang) WHERE lang <> 'de' GROUP BY 1 UNION ALL SELECT 'de', -1, 0")
def merged_directions(spark, d):
    order = spark.createDataFrame([(x, i) for i, x in enumerate(D.LANGS)], "lang string, place int")
    old = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    new = spark.createDataFrame([("de", -1)], "lang string, n long")
    return R.upsert(old, new, ["lang"]).join(F.broadcast(order), "lang").orderBy("place").select("lang", "n", "place")


def _corpus(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "text")


def _tampered(spark, d):
    """The corpus with rows edited, lost and added."""
    x = _corpus(spark, d)
    edited = x.withColumn("text", F.when(F.col("doc_id") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).where("doc_id % 50 <> 8")
    return edited.unionByName(x.where("doc_id % 50 = 9").withColumn("doc_id", F.col("doc_id") + 1_000_000_000))


_net = lambda c: f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_ROWS = f"rows_ AS (SELECT source AS split, sha256({_net('doc_id')}) AS key, sha256({' || '.join(map(_net, ('doc_id', 'lang', 'source', 'text')))}) AS digest FROM documents)"


@query("SNK-08-roots", sql=f"""WITH {_ROWS}, l2 AS (SELECT split, substr(key, 1, 2) AS node, count(*) AS n, sha256(string_agg(digest, '' ORDER BY key, digest)) AS digest FROM rows_ GROUP BY ALL),
l1 AS (SELECT split, substr(node, 1, 1) AS node, sum(n) AS n, sha256(string_agg(digest, '' ORDER BY l2.node)) AS digest FROM l2 GROUP BY 1, 2), l0 AS (SELECT split, sum(n) AS n, sha256(string_agg(digest, '' ORDER BY l1.node)) AS digest FROM l1 GROUP BY 1)
SELECT split, n::BIGINT AS rows, digest FROM l0 UNION ALL SELECT NULL, sum(n)::BIGINT, sha256(string_agg(digest, '' ORDER BY split)) FROM l0""")
def merkle_roots(spark, d):
    """The root of every split's hash tree, and of the whole corpus."""
    rows = MK.row_digests(_corpus(spark, d), "source", ["doc_id"], 2)
    return MK.tree(rows, 2).where("level <= 0").select("split", "rows", "digest")


@query("SNK-09", sql="""SELECT source AS split, sum((doc_id % 50 = 7)::INT)::BIGINT AS changed, sum((doc_id % 50 = 8)::INT)::BIGINT AS missing, sum((doc_id % 50 = 9)::INT)::BIGINT AS unexpected FROM documents WHERE doc_id % 50 IN (7, 8, 9) GROUP BY 1""")
def manifest_check(spark, d):
    """A frozen corpus against one with rows edited, lost and added: only branches whose digests differ are walked down to rows."""
    frozen = MK.freeze(_corpus(spark, d), S.scratch(spark, "manifest"), "source", ["doc_id"], rows_a_leaf=16)
    found = MK.verify(frozen, _tampered(spark, d))
    return found.groupBy("split").agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("changed", "missing", "unexpected")])


_CHUNK = 4096
_LINES = "lines AS (SELECT lang, doc_id, md5(coalesce(text, '')) || chr(10) AS line FROM documents)"


def _written(spark, x, lang="lang"):
    """A text file for each language: the content hashes of its documents, by id."""
    path = S.scratch(spark, "files")
    x = x.select(F.col(lang), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("value"))
    x.repartition(lang).sortWithinPartitions(lang, "doc_id").select(lang, "value").write.partitionBy(lang).text(path)
    return path


def _hashes(spark, path):
    h = FS.tree_hashes(spark, path, "*.txt", chunk=_CHUNK, fan=4)
    return h.select(F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang"), F.col("length").alias("n"), "digest")


@query("KEY-09", sql=f"""WITH {_LINES}, content AS (SELECT lang, string_agg(line, '' ORDER BY doc_id) AS body FROM lines GROUP BY 1),
t0 AS (SELECT lang, length(body) AS n, i, sha256(substr(body, i * {_CHUNK} + 1, {_CHUNK})) AS h FROM (SELECT *, unnest(range(greatest(1, (length(body) + {_CHUNK - 1}) // {_CHUNK}))) AS i FROM content)),
""" + ", ".join(f"t{k + 1} AS (SELECT lang, n, j AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM (SELECT *, i // 4 AS j FROM t{k}) GROUP BY lang, n, j)" for k in range(9)) + """,
m AS (SELECT ceil(max(n) / """ + str(_CHUNK) + """.0) AS c FROM t0), lv AS (SELECT greatest(1, (SELECT count(*) FROM range(12) r(k) WHERE power(4, k) < c)) AS depth FROM m)
SELECT lang, n, h AS digest FROM (""" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM t{k}" for k in range(1, 10)) + """) JOIN lv ON lv.depth = k""")
def file_tree_hashes(spark, d):
    """Files of any length by a hash tree over their chunks, which are read apart."""
    return _hashes(spark, _written(spark, _corpus(spark, d)))


@query("SNK-10", sql="""WITH l AS (SELECT lang, bool_or(doc_id % 50 IN (7, 8, 9)) AS touched FROM documents WHERE lang <> 'es' GROUP BY 1)
SELECT lang, CASE WHEN lang = 'fr' THEN 'not listed' WHEN lang = 'en' AND touched THEN 'changed' ELSE 'as frozen' END AS status FROM l UNION ALL SELECT 'es', 'missing'""")
def source_provenance(spark, d):
    """Source files against the digests of a manifest: English was tampered with, French is new, Spanish is gone."""
    listed = _hashes(spark, _written(spark, _corpus(spark, d).where("lang <> 'fr'")))
    now = _corpus(spark, d).where("lang NOT IN ('es', 'en')").unionByName(_tampered(spark, d).where("lang = 'en'"))
    return MK.provenance(_hashes(spark, _written(spark, now)), listed, "lang")


_STEPS = "steps AS (SELECT 0 AS run, doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 1, doc_id, coalesce(text, '') FROM documents UNION ALL SELECT unnest([2, 3]), doc_id, coalesce(text, '') || CASE WHEN doc_id % 10 = 3 THEN '!' ELSE '' END FROM documents)"


@query("SRC-15", "VEC-06", sql=f"""WITH {_STEPS}, k AS (SELECT DISTINCT run, sha256('hash8' || chr(10) || t) AS key FROM steps), f AS (SELECT key, min(run) AS version FROM k GROUP BY 1), e AS (SELECT version AS run, count(*) AS embedded, min(key) AS first_key FROM f GROUP BY 1)
SELECT r.run, (SELECT count(*) FROM k WHERE k.run = r.run) AS texts, coalesce(embedded, 0) AS embedded, first_key, (SELECT count(*) FROM f WHERE version <= r.run AND key NOT IN (SELECT key FROM k WHERE k.run = r.run)) AS stale
FROM (SELECT DISTINCT run FROM k) r LEFT JOIN e ON e.run = r.run""")
def vector_store(spark, d):
    """Four runs over a store of vectors: half the texts, all, some edited, the same again; each embeds what no run before it has."""
    x, path, out = _corpus(spark, d), S.scratch(spark, "vectors"), []
    edited = x.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 10 == 3, "!").otherwise("")))
    for run, now in enumerate((x.where("doc_id % 2 = 0"), x, edited, edited)):
        embedded = VS.update(now, "text", path, M.hash_embedder(8), "hash8")
        out.append((run, VS.keyed(now, "text").count(), embedded, VS.stale(now, "text", path, "hash8").count()))
    runs = spark.createDataFrame(out, "run int, texts long, embedded long, stale long")
    first = VS.read(spark, path).groupBy(F.col("version").alias("run")).agg(F.min("key").alias("first_key"))
    return runs.join(first, "run", "left").select("run", "texts", "embedded", "first_key", "stale")


_RUNS = f"""{P}, runs AS (SELECT lang, seed, 'task2_' || lang || '_base_seed' || seed AS run_id, substr(sha256(lang || ':' || seed % 2), 1, 16) AS config_hash, round(avg((pred_tgt = gold)::INT::DOUBLE), 6) AS accuracy FROM preds GROUP BY 1, 2)"""


def _run_folders(spark, d):
    """A folder for each run of the logs, with its metadata and its predictions."""
    path, p = S.scratch(spark, "runs"), D.predictions(spark, d)
    p = p.withColumn("run_id", F.concat(F.lit("task2_"), "lang", F.lit("_base_seed"), "seed"))
    meta = p.groupBy("run_id", "lang", "seed").agg(F.round(F.avg((F.col("pred_tgt") == F.col("gold")).cast("double")), 6).alias("accuracy"))
    meta = meta.withColumn("config_hash", F.substring(F.sha2(F.concat_ws(":", "lang", F.col("seed") % 2), 256), 1, 16))
    meta.select("run_id", "config_hash", "accuracy").repartition("run_id").write.partitionBy("run_id").json(path)
    p.select("run_id", "item_id", "pred_tgt").repartition("run_id").write.mode("append").partitionBy("run_id").csv(path)
    return path


@query("SRC-17", sql=f"WITH {_RUNS} SELECT run_id, 'task2' AS task, lang, seed, config_hash, accuracy, 2 AS files, true AS readable FROM runs")
def run_registry(spark, d):
    """A registry row for every run folder."""
    return FS.read_runs(spark, _run_folders(spark, d)).select("run_id", "task", "lang", "seed", "config_hash", "accuracy", "files", "readable")


@query("SRC-16", sql=f"WITH {_RUNS} SELECT lang, max(seed) AS version, arg_max(accuracy, seed) AS accuracy FROM runs WHERE accuracy >= 0.6 AND lang <> 'es' GROUP BY 1")
def newest_versions(spark, d):
    """The newest usable version of every data set that is found under a folder."""
    found = FS.read_runs(spark, _run_folders(spark, d)).where("readable AND accuracy >= 0.6 AND lang <> 'es'")
    return found.groupBy("lang").agg(F.max("seed").alias("version"), F.max_by("accuracy", "seed").alias("accuracy"))


@query("JOIN-32", sql=f"""WITH {_RUNS}, reported AS (SELECT DISTINCT config_hash FROM runs WHERE accuracy >= 0.66), current_ AS (SELECT config_hash FROM runs WHERE lang = 'fr' AND seed = 0)
SELECT run_id, CASE WHEN r.config_hash IN (SELECT config_hash FROM reported) THEN 'keep: reported' WHEN r.config_hash IN (SELECT config_hash FROM current_) THEN 'keep: current config' ELSE 'orphan' END AS verdict FROM runs r""")
def kept_runs(spark, d):
    """What retention keeps of the run folders: what a report names, what the current configuration made."""
    path = _run_folders(spark, d)
    every, good, now = (FS.read_runs(spark, path).withColumnRenamed("config_hash", "run_hash") for _ in range(3))
    return C.retention(every.select("run_id", "run_hash"), good.where("accuracy >= 0.66").select("run_hash"), now.where("lang = 'fr' AND seed = 0").select("run_hash")).select("run_id", "verdict")


@query("CND-12", sql=f"""WITH {P}, n AS (SELECT lang, count(*) AS n FROM preds GROUP BY 1)
SELECT lang, n AS rows, CASE lang WHEN 'fr' THEN ['no partition key encoder_id'] WHEN 'es' THEN ['column gold is string'] WHEN 'de' THEN ['column seed is int64', 'no column pred'] ELSE [] END AS faults FROM n UNION ALL SELECT 'xx', 0, ['no rows']""")
def artefact_contract(spark, d):
    """Logs whose paths or schemas break the contract, found by their footers: every artefact names its encoder, and its columns and types are the same."""
    p, root = D.predictions(spark, d).select("lang", "item_id", "seed", "gold", F.col("pred_tgt").alias("pred")), S.scratch(spark, "artefacts")
    as_due = lambda x: x.where("lang NOT IN ('fr', 'es', 'de')").drop("lang")
    parts = {"en": as_due(p), "fr": p.where("lang = 'fr'").drop("lang"), "es": p.where("lang = 'es'").drop("lang").withColumn("gold", F.col("gold").cast("string")), "de": p.where("lang = 'de'").select("item_id", F.col("seed").cast("long").alias("seed"), "gold"), "xx": as_due(p).limit(0)}
    for lang, x in parts.items():
        x.coalesce(1).write.parquet(f"{root}/lang={lang}" if lang == "fr" else f"{root}/encoder_id=base/lang={lang}")
    found = FS.footers(spark, root).select(F.element_at("keys", "lang").alias("lang"), "rows", FS.contract_faults(["encoder_id", "lang"], {"item_id": "int64", "seed": "int32", "gold": "int32", "pred": "int32"}).alias("faults"))
    return found


@query("MOD-03")
def trained_baseline(spark, d):
    """A logistic baseline of label 0 on all vectors, trained with a validation part and early stop."""
    path = S.scratch(spark, "training")
    x = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    x.select(F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == 0).cast("double").alias("y"), TR.dealt(F.col("vec_id")).alias("part")).write.parquet(path)
    rows = spark.read.parquet(path)
    fit = TR.train(rows, (rows.agg(F.max(F.size("x"))).first()[0] or 0) + 1, l2=1e-2, rounds=30)
    return spark.createDataFrame([(i, float(w), fit.stopped, fit.overfit) for i, w in enumerate(fit.weights)], "i int, w double, stopped string, overfit boolean")


_STEPS_IG = 16


@query("MOD-04", sql=f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), u AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e),
w AS (SELECT list(8 * (a - b) ORDER BY i) AS w FROM (SELECT i, avg(v) FILTER (label = 0) AS a, avg(v) FILTER (label <> 0) AS b FROM u GROUP BY 1)), z AS (SELECT vec_id, x, w, list_dot_product(w, x) AS z FROM e, w),
g AS (SELECT *, list_avg(list_transform(range({_STEPS_IG}), lambda k: 1 / (1 + exp(-z * (k + 0.5) / {_STEPS_IG})) * (1 - 1 / (1 + exp(-z * (k + 0.5) / {_STEPS_IG}))))) AS m FROM z),
t AS (SELECT *, list_transform(x, lambda v, i: v * w[i] * m) AS a FROM g)
SELECT vec_id, list_position(list_transform(a, lambda v: abs(v)), list_max(list_transform(a, lambda v: abs(v)))) - 1 AS top, round(list_sum(a), 6) AS total, round(1 / (1 + exp(-z)) - 0.5, 6) AS delta FROM t""")
def attributions(spark, d):
    """Integrated gradients of a centroid model of label 0 for every vector: the dimension that counts most, the sum, and what it should be."""
    x = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    means = x.select("label", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg(F.when(F.col("label") == 0, F.col("v"))).alias("a"), F.avg(F.when(F.col("label") != 0, F.col("v"))).alias("b"))
    w = [8 * (r["a"] - r["b"]) for r in means.orderBy("i").collect()]  # a number for each dimension
    out = TR.integrated_gradients(x, "x", TR.Logistic(np.array([*w, 0.0])), steps=_STEPS_IG)
    size = F.transform("attribution", F.abs)
    total = F.aggregate("attribution", F.lit(0.0), lambda s, v: s + v)
    return out.select("vec_id", (F.array_position(size, F.array_max(size)) - 1).alias("top"), F.round(total, 6).alias("total"), F.round("delta", 6).alias("delta"))


@query("MOD-07", sql="SELECT lang, count(*) AS n, true AS same_python, true AS same_arrow, true AS utc FROM documents GROUP BY 1")
def environment(spark, d):
    """Whether the Python workers that read the documents run the driver's interpreter and packages, and Spark its time zone."""
    versions = health(spark)
    x = table(spark, d, "documents").select("lang").mapInArrow(worker_versions, "lang string, n long, python string, arrow string")
    ok = lambda c: F.min(F.col(c) == F.lit(versions[c])).alias(f"same_{c}")
    return x.groupBy("lang").agg(F.sum("n").alias("n"), ok("python"), ok("arrow"), F.lit(versions["time_zone"] == "UTC").alias("utc"))
