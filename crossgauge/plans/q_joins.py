"""Pair scores, rate joins, encoder summaries, independence tests, samples and the translation boundary, each id by itself."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.functions import text as T
from crossgauge.functions import vectors as V
from crossgauge.functions.keys import md5_bucket
from crossgauge.functions.vectors import dot
from crossgauge.operators import conditions as C
from crossgauge.operators import diagnose as G
from crossgauge.operators import models as M
from crossgauge.operators import neighbours as N
from crossgauge.operators import relational as R
from crossgauge.operators.numbering import numbered
from crossgauge.plans import derived as D
from crossgauge.plans.q_stats import _NAT
from crossgauge.plans.registry import query
from crossgauge.session import table
from crossgauge.sources import io as S

P = D.SQL_PREDS
TAU = 0.2
r6 = lambda c, name: F.round(c, 6).alias(name)

# ---- pair scores


def _side(spark, d, shift, v):
    return table(spark, d, "embeddings").select((F.col("vec_id") - shift).alias("item"), F.col("label").alias(f"{v}_label"), F.col("embedding").cast("array<double>").alias(v))


@query("JOIN-10", sql="""SELECT t.vec_id AS item, round(list_dot_product(s.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS sim, s.vec_id IS NULL AS missing FROM embeddings t LEFT JOIN embeddings s ON s.vec_id = t.vec_id + 1 AND s.label <> 3""")
def pair_scores(spark, d):
    """Every target row scored against its source; a target without one is reported, not dropped."""
    t, s = _side(spark, d, 0, "x").drop("x_label"), _side(spark, d, 1, "y").where("y_label <> 3").drop("y_label")
    return t.join(s, "item", "left").select("item", r6(dot(F.col("x"), F.col("y")), "sim"), F.col("y").isNull().alias("missing"))


@query("JOIN-11", sql="""WITH q AS (SELECT l_partkey AS item, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1), a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 1), b AS (SELECT vec_id - 1 AS vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 2)
SELECT row_number() OVER (ORDER BY first, item) AS place, item, CASE WHEN a.v IS NULL AND b.v IS NULL THEN 'both' WHEN a.v IS NULL THEN 'source' WHEN b.v IS NULL THEN 'target' END AS missing, round(list_dot_product(a.v, b.v), 6) AS sim
FROM q LEFT JOIN a ON a.vec_id = item LEFT JOIN b ON b.vec_id = item""")
def requested_scores(spark, d):
    """A requested list with repeats: each item once, in the order of its first request, and which side it lacks."""
    asked = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))
    x = asked.join(_side(spark, d, 0, "x").where("x_label <> 1"), "item", "left").join(_side(spark, d, 1, "y").where("y_label <> 2"), "item", "left")
    no_x, no_y = F.col("x").isNull(), F.col("y").isNull()
    missing = F.when(no_x & no_y, "both").when(no_x, "source").when(no_y, "target").alias("missing")
    return numbered(x.select("first", "item", missing, r6(dot(F.col("x"), F.col("y")), "sim")), ["first", "item"]).select("place", "item", "missing", "sim")


@query("JOIN-12", sql="""WITH e AS (SELECT vec_id // 10 AS item, label, arg_max(embedding::DOUBLE[], vec_id) AS v FROM embeddings GROUP BY 1, 2)
SELECT a.item, b.label AS reference, round(list_dot_product(a.v, b.v), 6) AS sim FROM e a JOIN e b ON a.item = b.item AND a.label = 0 AND b.label <> 0""")
def reference_scores(spark, d):
    """A translation (label 0) against the native references of its item: the newest vector of each, over all vectors."""
    e = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("item"), "label").agg(F.max_by(F.col("embedding").cast("array<double>"), "vec_id").alias("v"))
    mt = e.where("label = 0").select("item", F.col("v").alias("x"))
    return mt.join(e.where("label <> 0"), "item").select("item", F.col("label").alias("reference"), r6(dot(F.col("x"), F.col("v")), "sim"))


# ---- rates and summaries


@query("JOIN-15", sql=f"""WITH {D.SQL_FAILURES}, s AS (SELECT lang, seed, label_group, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang, seed) AS share FROM fails GROUP BY 1, 2, 3),
r AS (SELECT lang, seed, avg((pred_src = gold AND pred_tgt <> gold)::INT::DOUBLE) AS rate FROM preds GROUP BY 1, 2)
SELECT lang, seed, label_group, round(share, 6) AS share, round(rate, 6) AS rate, round(share * rate, 6) AS of_all FROM s JOIN r USING (lang, seed)""")
def shares_with_rates(spark, d):
    """Label shares get the failure rate of their key attached."""
    n = D.failures(spark, d).groupBy("lang", "seed", "label_group").agg(F.count("*").alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("lang", "seed")))
    rates = D.predictions(spark, d).groupBy("lang", "seed").agg(F.avg(R.mismatch().cast("double")).alias("rate"))
    x = share.join(rates, ["lang", "seed"])
    return x.select("lang", "seed", "label_group", r6(F.col("share"), "share"), r6(F.col("rate"), "rate"), r6(F.col("share") * F.col("rate"), "of_all"))


@query("JOIN-16", sql=f"""WITH {P}, e AS (SELECT block_id, seed, count(*) AS evaluated FROM preds GROUP BY 1, 2), f AS (SELECT block_id, seed, count(*) AS failed FROM preds WHERE toxic = 1 AND pred_src = gold AND pred_tgt <> gold GROUP BY 1, 2)
SELECT block_id, seed, evaluated, coalesce(failed, 0) AS failed FROM e LEFT JOIN f USING (block_id, seed)""")
def evaluated_and_failed(spark, d):
    """Evaluated counts with the failed ones beside them; a key that never failed has 0."""
    p = D.predictions(spark, d)
    e = p.groupBy("block_id", "seed").agg(F.count("*").alias("evaluated"))
    f = p.where("toxic = 1").where(R.mismatch()).groupBy("block_id", "seed").agg(F.count("*").alias("failed"))
    return e.join(f, ["block_id", "seed"], "left").fillna(0, ["failed"])


@query("JOIN-23", sql="""WITH c AS (SELECT conv_id, role, CASE WHEN conv_id % 4 = 0 AND role = 'user' THEN '' WHEN conv_id % 7 = 0 AND role = 'assistant' THEN NULL ELSE min(text) END AS text, CASE WHEN conv_id % 2 = 0 THEN NULL ELSE role END AS src_lang FROM conversations GROUP BY 1, 2)
SELECT count(*) AS joined, sum((coalesce(a.text, '') = '' OR coalesce(u.text, '') = '')::INT)::BIGINT AS incomplete FROM c a JOIN c u ON a.conv_id = u.conv_id AND a.role = 'assistant' AND u.role = 'user'""")
def block_join_check(spark, d):
    """Rows of a block's language join with an empty or missing value; the source-language columns may be null."""
    first = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("text").alias("text"))
    text = F.when((F.col("conv_id") % 4 == 0) & (F.col("role") == "user"), "").when(~((F.col("conv_id") % 7 == 0) & (F.col("role") == "assistant")), F.col("text"))
    c = first.withColumn("text", text).withColumn("src_lang", F.when(F.col("conv_id") % 2 != 0, F.col("role")))
    joined = R.join_languages({k: c.where(F.col("role") == k).drop("role") for k in ("assistant", "user")}, "conv_id")
    return R.completeness(joined, [x for x in joined.columns if not x.startswith("src_lang_")])


@query("JOIN-28", sql=f"""WITH {D.SQL_CELLS}, b AS (SELECT * FROM gaps WHERE encoder = 'base' AND source <> 'es'), l AS (SELECT * FROM gaps WHERE encoder = 'large' AND target <> 'de')
SELECT b.source, count(*) AS n_cells, round(avg(b.gap_mean), 6) AS base, round(avg(l.gap_mean), 6) AS large, round(avg(l.gap_mean - b.gap_mean), 6) AS delta FROM b JOIN l ON b.source = l.source AND b.target = l.target GROUP BY 1""")
def shared_cells(spark, d):
    """The cells that both encoders have, averaged."""
    g = D.gaps(spark, d)
    b = g.where("encoder = 'base' AND source <> 'es'").select("source", "target", F.col("gap_mean").alias("base"))
    x = b.join(g.where("encoder = 'large' AND target <> 'de'").select("source", "target", F.col("gap_mean").alias("large")), ["source", "target"])
    return x.groupBy("source").agg(F.count("*").alias("n_cells"), r6(F.avg("base"), "base"), r6(F.avg("large"), "large"), r6(F.avg(F.col("large") - F.col("base")), "delta"))


@query("JOIN-29", sql=f"""WITH {D.SQL_CELLS}, i AS (SELECT encoder, lang, avg(a_src) AS a FROM acc GROUP BY 1, 2), inl AS (SELECT x.lang AS key, CASE WHEN x.lang = 'en' THEN 0 ELSE y.a - x.a END AS in_delta FROM i x JOIN i y ON x.lang = y.lang AND x.encoder = 'base' AND y.encoder = 'large' WHERE x.lang <> 'fr'),
cr AS (SELECT b.target AS key, avg(l.gap_mean - b.gap_mean) AS cross_delta FROM gaps b JOIN gaps l ON b.source = l.source AND b.target = l.target AND b.encoder = 'base' AND l.encoder = 'large' WHERE b.target <> 'es' GROUP BY 1)
SELECT key, round(in_delta, 6) AS in_delta, round(cross_delta, 6) AS cross_delta, CASE WHEN in_delta <> 0 THEN round(cross_delta / in_delta, 4) END AS amplification FROM inl FULL JOIN cr USING (key)""")
def deficit_summary(spark, d):
    """In-language and cross-lingual deficits side by side; a side may be absent, and the ratio needs both and no zero."""
    c = D.cells(spark, d)
    own = c.select("encoder", "seed", F.col("source").alias("key"), "source_acc").distinct().groupBy("key").pivot("encoder", list(D.ENCODERS)).agg(F.avg("source_acc"))
    own = own.where("key <> 'fr'").select("key", F.when(F.col("key") == "en", 0.0).otherwise(F.col("large") - F.col("base")).alias("in_delta"))
    g = D.gaps(spark, d).groupBy("source", "target").pivot("encoder", list(D.ENCODERS)).agg(F.first("gap_mean"))
    cross = g.where("target <> 'es' AND base IS NOT NULL AND large IS NOT NULL").groupBy(F.col("target").alias("key")).agg(F.avg(F.col("large") - F.col("base")).alias("cross_delta"))
    ratio = F.when(F.col("in_delta") != 0, F.round(F.col("cross_delta") / F.col("in_delta"), 4)).alias("amplification")
    return own.join(cross, "key", "full").select("key", r6(F.col("in_delta"), "in_delta"), r6(F.col("cross_delta"), "cross_delta"), ratio)


@query("STA-15", sql="""SELECT p_brand AS encoder, sum(p_size * 1000)::BIGINT AS total, coalesce(sum(p_size * 1000) FILTER (p_type LIKE '%A%'), 0)::BIGINT AS embedding, (sum(p_size * 1000) - coalesce(sum(p_size * 1000) FILTER (p_type LIKE '%A%'), 0))::BIGINT AS body FROM part GROUP BY 1""")
def parameter_profile(spark, d):
    """Parameters in all, in the embeddings (by their names) and in the body."""
    n = F.col("p_size") * 1000
    x = table(spark, d, "part").groupBy(F.col("p_brand").alias("encoder")).agg(F.sum(n).alias("total"), F.coalesce(F.sum(F.when(F.col("p_type").like("%A%"), n)), F.lit(0)).alias("embedding"))
    return x.withColumn("body", F.col("total") - F.col("embedding"))


_QUESTIONS = [("target", "Task 2 hin", "linguistic", "hin,ben", "tel"), ("provenance", "Task 2 ben", "linguistic", "ben", "hin"), ("provenance", "Task 3 ben", "translation_drift", "tel", "tel"), ("source", "Task 3 all", "class_collapse", "tel", "hin"), ("source", "Task 2 all", "morphological_masking", "tel", "ben,hin")]


@query("STA-09", sql=f"""WITH v(q, c, m, a, b) AS (VALUES {', '.join(str(x) for x in _QUESTIONS)}), s AS (SELECT l.label, v.*, string_split(a || ',' || b, ',') AS t, label IN (SELECT label FROM (SELECT DISTINCT label FROM fails)) AS seen FROM v, (SELECT DISTINCT label FROM fails) l)
SELECT label, q, c, CASE WHEN m = 'class_collapse' THEN label ELSE m END AS m, list_filter([CASE WHEN (CASE WHEN m = 'class_collapse' THEN label ELSE m END) IN ('morphological_masking', 'linguistic') AND list_contains(t, 'hin') THEN 'hindi_morphology' END,
CASE WHEN q = 'provenance' AND (CASE WHEN m = 'class_collapse' THEN label ELSE m END) IN ('translation_drift', 'linguistic') THEN 'native_drift' END, CASE WHEN q = 'provenance' AND list_contains(t, 'ben') THEN 'bengali_digits' END,
CASE WHEN starts_with(c, 'Task 3') THEN 'task3_ceiling' END], lambda x: x IS NOT NULL) AS caveats FROM s""".replace("WITH v", f"WITH {D.SQL_FAILURES}, v"))
def caveats(spark, d):
    """Every label that occurs as a measure of every question, with the caveats that could explain a difference."""
    labels = D.failures(spark, d).select("label").distinct()
    x = labels.join(F.broadcast(spark.createDataFrame(_QUESTIONS, "q string, c string, m string, a string, b string")))  # a fixed list of questions
    m = F.when(F.col("m") == "class_collapse", F.col("label")).otherwise(F.col("m"))
    targets = F.array_union(F.split("a", ","), F.split("b", ","))
    return x.select("label", "q", "c", m.alias("m"), G.caveats(F.col("q"), F.col("c"), m, targets).alias("caveats"))


@query("REP-04", sql=f"""WITH {D.SQL_CELLS}, v AS (SELECT encoder, source, string_agg(target, ', ' ORDER BY target) AS targets, avg(gap_mean) AS mean FROM gaps GROUP BY 1, 2)
SELECT encoder, 0 AS line, '## ' || encoder || ': ' || count(*) FILTER (mean > 0.25) || ' of ' || count(*) || ' held' AS text FROM v GROUP BY 1
UNION ALL SELECT encoder, row_number() OVER (PARTITION BY encoder ORDER BY source), '- ' || source || ' to ' || targets || ': ' || CASE WHEN mean > 0.25 THEN 'held' ELSE 'within noise' END FROM v""")
def findings_sections(spark, d):
    """A section for each encoder: its headline and one bullet a source."""
    v = D.gaps(spark, d).groupBy("encoder", "source").agg(F.array_join(F.array_sort(F.collect_list("target")), ", ").alias("targets"), (F.avg("gap_mean") > 0.25).alias("held"))
    head = v.groupBy("encoder").agg(F.concat(F.lit("## "), F.first("encoder"), F.lit(": "), F.count_if("held"), F.lit(" of "), F.count("*"), F.lit(" held")).alias("text"))
    bullet = F.concat(F.lit("- "), "source", F.lit(" to "), "targets", F.lit(": "), F.when(F.col("held"), "held").otherwise("within noise")).alias("text")
    lines = v.select("encoder", F.row_number().over(W.partitionBy("encoder").orderBy("source")).alias("line"), bullet)
    return head.select("encoder", F.lit(0).alias("line"), "text").unionByName(lines)


# ---- conditions


@query("CND-05", sql=f"""WITH {D.SQL_PREDS}, {D.SQL_GOOD_RUNS}, {_NAT}, p AS (SELECT name, s.seed, split_part(train, '/', 2) AS lang FROM conds CROSS JOIN (SELECT unnest([0, 1, 2]) AS seed) s),
s AS (SELECT p.*, CASE WHEN g.lang IS NULL THEN 'blocked' WHEN {D.b(10, 'name', 'p.seed')} = 0 THEN 'failed' ELSE 'ran' END AS status FROM p LEFT JOIN good_runs g ON g.lang = p.lang AND g.seed = p.seed) SELECT seed, status, count(*) AS n, list_sort(list(name)) AS names FROM s GROUP BY 1, 2""")
def sweep(spark, d):
    """A sweep over the plan, accounted: what ran, what was blocked for want of a checkpoint, what failed."""
    fails = md5_bucket(10, F.col("name"), F.col("seed")) == 0
    p = C.plan(C.matrix(D.found_langs(spark, d)), D.SEEDS, D.good_runs(spark, d).withColumnRenamed("lang", "model_lang")).withColumn("status", F.when(F.col("status") == "blocked", "blocked").when(fails, "failed").otherwise("ran"))
    return p.groupBy("seed", "status").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("names"))  # the conditions of a few languages


@query("JOIN-33", sql=f"""WITH {D.SQL_PREDS}, r AS (SELECT lang, seed, avg((pred_tgt = gold)::INT::DOUBLE) >= 0.65 AS good FROM preds GROUP BY 1, 2), {_NAT} SELECT r.lang, r.seed, count(c.name) AS n, list_sort(coalesce(list(c.name) FILTER (c.name IS NOT NULL), [])) AS unblocked, count(c.name) = 0 AS violation
FROM r LEFT JOIN conds c ON split_part(c.train, '/', 2) = r.lang AND good GROUP BY 1, 2""")
def unblocked_conditions(spark, d):
    """Which conditions each run of the logs unblocks, if it is good enough; a run that unblocks none breaks a rule."""
    runs = D.predictions(spark, d).select("lang", "seed").distinct().join(D.good_runs(spark, d).withColumn("good", F.lit(True)), ["lang", "seed"], "left")
    c = C.matrix(D.found_langs(spark, d)).select("name", F.get(F.split("train", "/"), 1).alias("model"))
    names = F.sort_array(F.collect_list("name"))
    return runs.join(c, (runs.lang == c.model) & runs.good, "left").groupBy("lang", "seed").agg(F.count("name").alias("n"), names.alias("unblocked"), (F.count("name") == 0).alias("violation"))


@query("CND-07", sql=f"""WITH {D.SQL_CELLS}, {_NAT}, e AS (SELECT unnest(['base', 'large', 'absent']) AS encoder), t AS (SELECT name, split_part(train, '/', 2) AS source, split_part(name, '_to_', 2) AS target FROM conds WHERE kind = 'transfer')
SELECT t.name, e.encoder, round(g.gap_mean, 6) AS gap, CASE WHEN g.gap_mean IS NULL THEN 'blocked' ELSE 'ok' END AS status FROM t CROSS JOIN e LEFT JOIN gaps g ON g.encoder = e.encoder AND g.source = t.source AND g.target = t.target""")
def condition_rows(spark, d):
    """A row for every transfer condition and encoder, whether there is a result or not."""
    t = C.matrix(D.found_langs(spark, d)).where("kind = 'transfer'").select("name", F.get(F.split("train", "/"), 1).alias("source"), F.get(F.split("name", "_to_"), 1).alias("target"))
    t = t.withColumn("encoder", F.explode(F.array(*map(F.lit, (*D.ENCODERS, "absent")))))
    x = t.join(D.gaps(spark, d), ["encoder", "source", "target"], "left")
    return x.select("name", "encoder", r6(F.col("gap_mean"), "gap"), F.when(F.col("gap_mean").isNull(), "blocked").otherwise("ok").alias("status"))


@query("CND-11", sql=f"""WITH {_NAT}, t AS (SELECT *, split_part(train, '/', 1) AS train_block, split_part(train, '/', 2) AS source, split_part(eval, '/', 1) AS eval_block, split_part(eval, '/', 2) AS target FROM conds WHERE kind <> 'translationese')
SELECT t.name, source, target, train_block, eval_block, source || '_seed0' AS ceiling, native, CASE WHEN native THEN 'written by people' ELSE 'translated from ' || o.lang END AS test_text
FROM (SELECT *, kind = 'transfer' AND target IN (SELECT lang FROM lang_dim WHERE native_block IS NOT NULL) AS native FROM t) t JOIN lang_dim o ON o.native_block = t.eval_block""")
def described_conditions(spark, d):
    """A condition's source, target, blocks, ceiling run and what its test text is."""
    part = lambda c, i: F.get(F.split(c, "/"), i)
    langs = D.found_langs(spark, d)
    x = C.matrix(langs).where("kind <> 'translationese'").withColumn("e", F.get("eval", 0)).withColumn("target", part("e", 1))
    own = langs.where("native_block IS NOT NULL").select(F.col("lang").alias("target"), F.lit(True).alias("own"))
    x = x.join(F.broadcast(own), "target", "left").select("name", part("train", 1).alias("source"), "target", part("train", 0).alias("train_block"), part("e", 0).alias("eval_block"), ((F.col("kind") == "transfer") & F.coalesce("own", F.lit(False))).alias("native"))
    origin = langs.select(F.col("native_block").alias("eval_block"), F.col("lang").alias("origin"))
    test = F.when(F.col("native"), "written by people").otherwise(F.concat(F.lit("translated from "), "origin")).alias("test_text")
    return x.join(F.broadcast(origin), "eval_block").select("name", "source", "target", "train_block", "eval_block", F.concat("source", F.lit("_seed0")).alias("ceiling"), "native", test)


# ---- independence


def _set(spark, d, label):
    return table(spark, d, "embeddings").where(F.col("label") == label).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


_PLACED = "p AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings)"
_TESTS = f"""{_PLACED}, n AS (SELECT least(max(i) FILTER (label = 0), max(i) FILTER (label = 1)) AS n FROM p),
s AS (SELECT i, row_number() OVER (ORDER BY md5('1:' || i), i) AS a, row_number() OVER (ORDER BY md5('2:' || i), i) AS b FROM (SELECT unnest(range(1, n + 1)) AS i FROM n) WHERE true),
k AS (SELECT * FROM s WHERE a <= 40), kb AS (SELECT i, row_number() OVER (ORDER BY b) AS j FROM k), ka AS (SELECT i, a AS j FROM k),
x AS (SELECT ka.i, ka.j, p.v FROM ka JOIN p ON p.i = ka.i AND p.label = 0),
sc AS (SELECT 'B1_row_aligned' AS test, list_dot_product(x.v, t.v) AS s FROM x JOIN p t ON t.label = 1 AND t.i = x.i
UNION ALL SELECT 'B1_shuffled_control', list_dot_product(x.v, t.v) FROM x JOIN kb ON kb.j = x.j JOIN p t ON t.label = 1 AND t.i = kb.i
UNION ALL SELECT 'B2_nearest_neighbour', max(list_dot_product(x.v, t.v)) FROM x JOIN p t ON t.label = 1 GROUP BY x.i)"""


@query("VEC-04", sql=f"""WITH {_TESTS}, m AS (SELECT test, count(*) AS n, avg(s) AS mean, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.95) AS p95, max(s) AS most, avg((s >= {TAU})::INT::DOUBLE) AS share FROM sc GROUP BY 1)
SELECT test, n, round(mean, 6) AS mean, round(median, 6) AS median, round(p95, 6) AS p95, round(most, 6) AS most, round(share, 6) AS share, (SELECT share > 0.5 FROM m WHERE test = 'B2_nearest_neighbour') AS parallel_suspected FROM m""")
def independence_tests(spark, d):
    """40 sampled rows of one side: against the row of the same number, against a shuffled one, and against the nearest of the whole other side."""
    a, b = (numbered(_set(spark, d, i), ["id"], "i") for i in (0, 1))
    n = a.join(b.select("i"), "i")
    ka = R.hash_sample(n, [], "i", 40, 1).select("i", F.col("v").alias("x"), F.col("pick").alias("j"))  # a bounded sample is the test
    kb = R.hash_sample(ka, [], "i", 40, 2).select(F.col("i").alias("i2"), F.col("pick").alias("j"))
    y = b.select("i", F.col("v").alias("y"))
    aligned = ka.join(y, "i").select(F.lit("B1_row_aligned").alias("test"), dot(F.col("x"), F.col("y")).alias("s"))
    shuffled = ka.join(kb, "j").drop("i").withColumnRenamed("i2", "i").join(y, "i").select(F.lit("B1_shuffled_control").alias("test"), dot(F.col("x"), F.col("y")).alias("s"))
    near = N.nearest(ka.select(F.col("i").alias("id"), F.col("x").alias("v")), b.select("id", "v"), "l").select(F.lit("B2_nearest_neighbour").alias("test"), F.col("sim").alias("s"))
    s = aligned.unionByName(shuffled).unionByName(near)
    m = s.groupBy("test").agg(F.count("*").alias("n"), r6(F.avg("s"), "mean"), r6(F.percentile("s", 0.5), "median"), r6(F.percentile("s", 0.95), "p95"), r6(F.max("s"), "most"), r6(F.avg((F.col("s") >= TAU).cast("double")), "share"))
    return m.withColumn("parallel_suspected", F.max(F.when(F.col("test") == "B2_nearest_neighbour", F.col("share") > 0.5)).over(W.partitionBy()))  # three rows


_CONTROLS = (("positive_known_parallel", 0, 0), ("negative_same_domain", 0, 1), ("negative_other_domain", 2, 1), ("under_test", 0, 2))


@query("VEC-05", sql="WITH " + "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), " + ", ".join(
    f"c{k} AS (SELECT '{name}' AS control, a.vec_id, max(list_dot_product(a.v, b.v)) AS s FROM (SELECT * FROM e WHERE label = {x} ORDER BY md5('5:' || vec_id), vec_id LIMIT 30) a, e b WHERE b.label = {y} GROUP BY ALL)" for k, (name, x, y) in enumerate(_CONTROLS))
    + f" SELECT control, count(*) AS n, round(quantile_cont(s, 0.5), 6) AS median, round(avg(s), 6) AS mean, round(avg((s >= {TAU})::INT::DOUBLE), 6) AS share FROM (" + " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(4)) + ") GROUP BY 1")
def calibration_controls(spark, d):
    """Four labelled pairs of sets: 30 sampled rows of the first, each with its nearest in the whole second."""
    out = None
    for name, x, y in _CONTROLS:
        few = R.hash_sample(_set(spark, d, x), [], "id", 30, 5).select("id", "v")  # a bounded sample is the test
        s = N.nearest(few, _set(spark, d, y), "l").select(F.lit(name).alias("control"), F.col("sim").alias("s"))
        out = s if out is None else out.unionByName(s)
    return out.groupBy("control").agg(F.count("*").alias("n"), r6(F.percentile("s", 0.5), "median"), r6(F.avg("s"), "mean"), r6(F.avg((F.col("s") >= TAU).cast("double")), "share"))


LEXICON = [("the", "the"), ("in", "de"), ("de", "in"), ("on", "un")]


@query("SMP-04", sql=f"""WITH {D.SQL_SCORES}, l(ord, a, b) AS (VALUES {', '.join(str((i, *x)) for i, x in enumerate(LEXICON))}),
f AS (SELECT item_id, src_lang, tgt_lang, min(ord) AS ord FROM scores, l WHERE contains(src_text, a) GROUP BY 1, 2, 3), e AS (SELECT f.*, l.a FROM f JOIN l USING (ord) JOIN scores s USING (item_id, src_lang, tgt_lang) WHERE contains(s.tgt_text, l.b))
SELECT src_lang, tgt_lang, item_id, a AS term, row_number() OVER w AS pick, count(*) OVER (PARTITION BY src_lang, tgt_lang) AS eligible FROM e WINDOW w AS (PARTITION BY src_lang, tgt_lang ORDER BY md5('9:' || item_id), item_id) QUALIFY row_number() OVER w <= 10""")
def eligible_sample(spark, d):
    """Rows whose first lexicon term in the source has its counterpart in the target; ten of them for each direction."""
    s = D.scores(spark, d)
    first = T.first_term(F.col("src_text"), [a for a, _ in LEXICON])
    other = F.element_at(F.create_map(*[F.lit(x) for pair in LEXICON for x in pair]), first)
    e = s.select("src_lang", "tgt_lang", "item_id", first.alias("term"), F.contains("tgt_text", other).alias("ok")).where("ok")
    n = e.groupBy("src_lang", "tgt_lang").agg(F.count("*").alias("eligible"))
    few = R.hash_sample(e.drop("ok"), ["src_lang", "tgt_lang"], "item_id", 10, 9)  # ten a direction leave each task
    return few.join(n, ["src_lang", "tgt_lang"]).select("src_lang", "tgt_lang", "item_id", "term", "pick", "eligible")


# ---- the translation boundary


def _shout(texts):
    """A stand-in translator that, like a real one, chokes on batches with a text it can't take."""
    if any("$" in t for t in texts):
        raise RuntimeError("out of memory")
    return [t.replace("e", "E") for t in texts]


_DONE = "doc_id % 3 = 0"


@query("MOD-01", sql=f"""WITH c AS (SELECT DISTINCT text, replace(text, 'e', 'E') AS translation FROM documents WHERE {_DONE}),
t AS (SELECT text, any_value(CASE WHEN contains(text, '$') THEN NULL ELSE replace(text, 'e', 'E') END) AS translation FROM documents WHERE text NOT IN (SELECT text FROM c) GROUP BY 1)
SELECT d.doc_id, length(coalesce(c.translation, t.translation)) AS n, md5(coalesce(c.translation, t.translation)) AS translation, c.text IS NOT NULL AS resumed, CASE WHEN trim(coalesce(c.translation, t.translation, '')) = '' THEN ['empty_output'] ELSE [] END AS flags
FROM documents d LEFT JOIN c ON c.text = d.text LEFT JOIN t ON t.text = d.text""")
def translated(spark, d):
    """Distinct texts in batches that halve when one fails; what a checkpoint holds isn't translated again."""
    x = table(spark, d, "documents").select("doc_id", "text")
    done = x.where(_DONE).select("text", F.replace("text", F.lit("e"), F.lit("E")).alias("translation")).dropDuplicates(["text"])
    out = M.translate_distinct(x, "text", "translation", _shout, done=done)
    return out.select("doc_id", F.length("translation").alias("n"), F.md5("translation").alias("translation"), "resumed", F.col("translation_flags").alias("flags"))


@query("ING-04", sql="""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS translation, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN ['truncated', 'empty_output'] WHEN doc_id % 4 = 2 THEN ['empty_output'] ELSE [] END AS flags FROM documents)
SELECT doc_id, CASE WHEN trim(translation) <> '' THEN list_filter(coalesce(flags, []), lambda x: x <> 'empty_output') WHEN list_contains(coalesce(flags, []), 'empty_output') THEN flags ELSE list_append(coalesce(flags, []), 'empty_output') END AS flags FROM r""")
def reconciled_flags(spark, d):
    """Flags made consistent with the text: empty_output if and only if nothing but blanks is there; a missing list is empty."""
    x = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("text")).alias("translation"), (F.col("doc_id") % 4).alias("k"))
    old = F.when(F.col("k") == 1, F.array(F.lit("truncated"), F.lit("empty_output"))).when(F.col("k") == 2, F.array(F.lit("empty_output"))).when(F.col("k") == 3, F.array().cast("array<string>"))
    return x.select("doc_id", M.reconcile_flags(old, F.col("translation")).alias("flags"))


@query("JOIN-20", "WIN-06", sql="WITH r AS (SELECT text, min(doc_id) AS rep FROM documents GROUP BY 1), t AS (SELECT rep, text, md5(replace(text, 'e', 'E')) AS translation FROM r) SELECT doc_id, rep, translation FROM documents JOIN t USING (text)")
def representative_broadcast(spark, d):
    """Distinct texts are translated once, whole, and the result goes to every row that has the text."""
    x = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "text")
    reps = x.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("text").alias("text"))
    done = reps.select("key", "rep", F.md5(F.replace("text", F.lit("e"), F.lit("E"))).alias("translation"))
    return x.select("doc_id", "key").join(done, "key").select("doc_id", "rep", "translation")


@query("JOIN-24", sql="""WITH l AS (SELECT DISTINCT doc_id AS k FROM labels), f AS (SELECT item_id AS k, count(*) AS n FROM (SELECT d.doc_id AS item_id FROM documents d UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1), u AS (SELECT doc_id AS k FROM labels UNION ALL SELECT item_id + 1 FROM benchmark)
SELECT (SELECT count(*) FROM (SELECT k FROM u EXCEPT SELECT k FROM f)) AS labels_only, (SELECT count(*) FROM f WHERE k NOT IN (SELECT k FROM u)) AS documents_only, (SELECT count(*) FROM f WHERE n > 1) AS doubled""")
def reconciliation(spark, d):
    """Labels against rows: what only either side has, and the rows that are there twice."""
    lab = table(spark, d, "labels")
    u = lab.select("doc_id").unionByName(table(spark, d, "benchmark").select((F.col("item_id") + 1).alias("doc_id"))).distinct().withColumn("a", F.lit(1))
    f = table(spark, d, "documents").select("doc_id").unionByName(lab.where("toxic = 1").select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("b"))
    x = u.join(f, "doc_id", "full")
    return x.agg(F.count_if(F.col("b").isNull()).alias("labels_only"), F.count_if(F.col("a").isNull()).alias("documents_only"), F.count_if(F.col("b") > 1).alias("doubled"))


@query("WIN-14", sql="SELECT doc_id, printf('R%s-%02d', lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id)) AS finding FROM documents")
def finding_ids(spark, d):
    """Findings numbered within their question, in order."""
    n = F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", F.format_string("R%s-%02d", "lang", n).alias("finding"))


@query("VEC-08", "MOD-02", sql="""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, list_position(x, list_max(x)) - 1 AS pred,
  round(exp(x[1] - list_max(x)) / list_sum(list_transform(x, lambda y: exp(y - list_max(x)))), 6) AS p0 FROM v""")
def argmax_softmax(spark, d):
    """The class and a probability from all logits of a row."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return v.select("vec_id", V.argmax(F.col("x")).cast("long").alias("pred"), F.round(F.get(V.softmax(F.col("x")), 0), 6).alias("p0"))


@query("MOD-05", sql="WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM documents), n AS (SELECT max(len(ids)) AS n FROM t) SELECT doc_id, len(ids) AS n_tokens, md5(list_resize(ids, n, 0)::VARCHAR) AS padded FROM t, n")
def padded(spark, d):
    """All words of every text as ids, padded to the longest."""
    t = table(spark, d, "documents").select("doc_id", F.transform(F.split("text", " "), lambda x: F.length(x)).alias("ids"))
    longest = t.agg(F.max(F.size("ids"))).first()[0] or 0
    text = F.concat(F.lit("["), F.array_join(M.pad(F.col("ids"), longest).cast("array<string>"), ", "), F.lit("]"))
    return t.select("doc_id", F.size("ids").alias("n_tokens"), F.md5(text).alias("padded"))
