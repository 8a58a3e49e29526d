"""Scans, filters, joins, aggregations, windows and sets: inventory sections 2.1 and 2.3 to 2.7."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.operators import neighbours as N
from crossgauge.operators import relational as R
from crossgauge.operators.quantiles import quantiles
from crossgauge.plans import derived as D
from crossgauge.plans.registry import query
from crossgauge.session import table

P = D.SQL_PREDS
ROLES = ("user", "assistant", "system")
TAU = 0.2
r6 = lambda c, name: F.round(c, 6).alias(name)


# ---- scans and filters


@query("SRC-06", "FLT-08", sql="SELECT doc_id, source, lang, n_chars FROM documents WHERE source = 'src1' AND lang IN ('en', 'de') AND n_chars BETWEEN 100 AND 5000")
def split_scan(spark, d):
    return table(spark, d, "documents").where("source = 'src1' AND lang IN ('en', 'de')").where(F.col("n_chars").between(100, 5000)).select("doc_id", "source", "lang", "n_chars")


@query("SRC-05", sql="SELECT doc_id::VARCHAR AS doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS source FROM documents")
def string_scan(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source"))
    return x.na.fill("")


@query("SRC-11", sql="SELECT DISTINCT source AS condition_id FROM documents WHERE source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5')")
def unknown_conditions(spark, d):
    plan = spark.createDataFrame([(f"src{i}",) for i in range(6)], "condition_id string")
    return table(spark, d, "documents").select(F.col("source").alias("condition_id")).distinct().join(F.broadcast(plan), "condition_id", "left_anti")


@query("FLT-01", "FLT-02", sql=f"WITH {P} SELECT lang, sum((pred_src = gold AND pred_tgt <> gold)::INT)::BIGINT AS failed, sum((pred_src = gold AND pred_tgt = gold)::INT)::BIGINT AS fine FROM preds GROUP BY 1")
def outcomes(spark, d):
    return D.predictions(spark, d).groupBy("lang").agg(F.count_if(R.mismatch()).alias("failed"), F.count_if(R.both_correct()).alias("fine"))


@query("FLT-03", "FLT-04", sql="SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 10 IN (1, 2)")
def spec_filter(spark, d):
    spec = {"o_orderstatus": ["F", "O"], "digit": [1, 2]}
    x = table(spark, d, "orders").withColumn("digit", F.col("o_orderkey") % 10)
    for col, values in spec.items():
        x = x.where(F.col(col).isin(values))
    return x.select("o_orderkey")


@query("FLT-05", "FLT-06", "FLT-07", "FLT-10", "FLT-14", sql="""WITH t(task, tau) AS (VALUES (1, 0.03)), x AS (SELECT l_orderkey % 2 AS task, l_discount AS v, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS delta FROM lineitem)
SELECT x.task, sum((v < coalesce(tau, 0.05))::INT)::BIGINT AS below, sum((v >= coalesce(tau, 0.05))::INT)::BIGINT AS at_or_above, sum(coalesce(delta <= 0.04, false)::INT)::BIGINT AS converged, sum((delta IS NULL)::INT)::BIGINT AS missing FROM x LEFT JOIN t USING (task) GROUP BY 1""")
def thresholds(spark, d):
    tau = spark.createDataFrame([(1, 0.03)], "task long, tau double")
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") % 2).alias("task"), F.col("l_discount").alias("v"), F.when(F.col("l_linenumber") != 1, F.col("l_tax")).alias("delta"))
    x = x.join(F.broadcast(tau), "task", "left").withColumn("tau", F.coalesce("tau", F.lit(0.05)))
    return x.groupBy("task").agg(F.count_if(F.col("v") < F.col("tau")).alias("below"), F.count_if(F.col("v") >= F.col("tau")).alias("at_or_above"), F.count_if(F.coalesce(F.col("delta") <= 0.04, F.lit(False))).alias("converged"), F.count_if(F.col("delta").isNull()).alias("missing"))


@query("FLT-09", "FLT-11", sql=f"""WITH {D.SQL_FAILURES} SELECT lang, count(*) AS n, sum(list_contains(modules_fired, 'morph')::INT)::BIGINT AS morph, sum((len(modules_fired) > 0)::INT)::BIGINT AS any_fired, sum((lang = 'de' AND seed = 2)::INT)::BIGINT AS untrained FROM fails GROUP BY 1""")
def flag_filters(spark, d):
    bad = spark.createDataFrame([("de", 2)], "lang string, seed int").withColumn("untrained", F.lit(True))
    x = D.failures(spark, d).join(F.broadcast(bad), ["lang", "seed"], "left")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.array_contains("modules_fired", "morph")).alias("morph"), F.count_if(F.size("modules_fired") > 0).alias("any_fired"), F.count_if(F.coalesce("untrained", F.lit(False))).alias("untrained"))


@query("FLT-12", "FLT-15", "KEY-04", sql="""WITH v AS (SELECT 'origin' AS rule, doc_id::VARCHAR AS key FROM documents WHERE lang NOT IN ('en', 'de', 'fr') UNION ALL SELECT 'text', doc_id::VARCHAR FROM documents WHERE length(text) < 20
  UNION ALL SELECT 'length', doc_id::VARCHAR FROM documents WHERE length(text) <> n_chars UNION ALL SELECT 'unique', text FROM documents GROUP BY text HAVING count(*) > 1)
SELECT rule, count(*) AS n, rule IN ('length', 'unique') AS blocking FROM v GROUP BY 1""")
def violations(spark, d):
    x = table(spark, d, "documents")
    key = F.col("doc_id").cast("string").alias("key")
    rules = {"origin": ~F.col("lang").isin("en", "de", "fr"), "text": F.length("text") < 20, "length": F.length("text") != F.col("n_chars")}
    broken = x.select(F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))).alias("rule"), key)  # all row rules in one scan
    twice = x.groupBy("text").count().where("count > 1").select(F.lit("unique").alias("rule"), F.col("text").alias("key"))
    return broken.union(twice).groupBy("rule").agg(F.count("*").alias("n")).withColumn("blocking", F.col("rule").isin("length", "unique"))


# ---- joins


@query("JOIN-01", "SET-03", "AGG-33", sql="""SELECT a.conv_id AS item_id, count(*) AS n FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user') a JOIN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant') b USING (conv_id) JOIN (SELECT conv_id FROM conversations WHERE role = 'system') c USING (conv_id) GROUP BY 1""")
def nway_join(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "item_id")
    one = {r: c.where(F.col("role") == r).select("item_id", "turn") for r in ROLES}
    frames = {r: (f.groupBy("item_id").agg(F.min("turn").alias("turn")) if r != "system" else f) for r, f in one.items()}
    return R.join_languages(frames).groupBy("item_id").agg(F.count("*").alias("n"))


@query("JOIN-02", "SET-05", "SET-06", sql="""WITH k AS (SELECT DISTINCT conv_id, role FROM conversations), a AS (SELECT conv_id FROM k GROUP BY 1 HAVING count(*) = 3),
m AS (SELECT k.role, k.conv_id, a.conv_id IS NOT NULL AS s, row_number() OVER (PARTITION BY k.role, a.conv_id IS NOT NULL ORDER BY k.conv_id) AS r FROM k LEFT JOIN a USING (conv_id))
SELECT role, count(*) AS n_keys, sum(s::INT)::BIGINT AS n_shared, list_filter(list(CASE WHEN NOT s AND r <= 5 THEN conv_id END ORDER BY conv_id), lambda x: x IS NOT NULL) AS not_shared FROM m GROUP BY 1""")
def join_report(spark, d):
    return R.presence(table(spark, d, "conversations"), "conv_id", "role", 3)


@query("JOIN-03", "JOIN-17", sql=f"WITH {P} SELECT item_id, seed, gold, pred_src, pred_tgt, lang FROM preds")
def source_target(spark, d):
    joined = R.join_source_target(D.arm_log(spark, d, "src"), D.arm_log(spark, d, "tgt"))
    return joined.select("item_id", "seed", "gold", "pred_src", "pred_tgt", "lang")


@query("JOIN-05", sql="""SELECT n.conv_id AS item_id, n.turn AS native_turn, m.turn AS mt_turn FROM conversations n JOIN conversations m ON n.conv_id = m.conv_id AND n.role = 'user' AND m.role = 'assistant' AND m.turn = n.turn + 1""")
def native_mt_pairs(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), "turn", "role")
    native = c.where("role = 'user'").select("item_id", F.col("turn").alias("native_turn"), (F.col("turn") + 1).alias("mt_turn"))
    return native.join(c.where("role = 'assistant'").select("item_id", F.col("turn").alias("mt_turn")), ["item_id", "mt_turn"]).select("item_id", "native_turn", "mt_turn")


@query("JOIN-04", "SET-04", sql="""WITH o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01') SELECT count(*) AS n_src, count(o.k) AS joined, count(*) - count(o.k) AS orphans FROM orders LEFT JOIN o ON o.k = o_orderkey""")
def parity(spark, d):
    o = table(spark, d, "lineitem").where("l_shipdate < timestamp'1995-01-01'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(1))
    x = table(spark, d, "orders").select("o_orderkey").join(o, "o_orderkey", "left")
    return x.agg(F.count("*").alias("n_src"), F.count("hit").alias("joined"), F.count_if(F.col("hit").isNull()).alias("orphans"))


@query("JOIN-06", "AGG-04", sql=f"""WITH {D.SQL_SCORES} SELECT tgt_lang, quality, count(*) AS n, round(avg(labse_sim), 6) AS mean, sum((labse_sim < 0.2)::INT)::BIGINT AS below FROM scores JOIN labels ON item_id = doc_id GROUP BY 1, 2""")
def drift_by_class(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality"))
    return D.scores(spark, d).join(lab, "item_id").groupBy("tgt_lang", "quality").agg(F.count("*").alias("n"), r6(F.avg("labse_sim"), "mean"), F.count_if(F.col("labse_sim") < 0.2).alias("below"))


@query("JOIN-07", sql="SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(DISTINCT role) = 3)")
def keyed_alignment(spark, d):
    c = table(spark, d, "conversations")
    return c.join(R.in_all(c, "conv_id", "role", 3), "conv_id", "left_semi").select("conv_id", "turn", "role")


def _vectors(spark, d, label):
    return table(spark, d, "embeddings").where(F.col("label") == label).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _mnn(a, b, name, tau=TAU):
    return f"""{name}p AS (SELECT x.vec_id AS l, y.vec_id AS r, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS sim FROM embeddings x, embeddings y WHERE x.label = {a} AND y.label = {b}),
{name} AS (SELECT l, r, sim FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY sim DESC, r) AS i, row_number() OVER (PARTITION BY r ORDER BY sim DESC, l) AS j FROM {name}p) WHERE i = 1 AND j = 1 AND sim >= {tau})"""


@query("JOIN-08", "WIN-04", "VEC-03", sql=f"WITH {_mnn(0, 1, 'm')} SELECT l, r, round(sim, 6) AS sim FROM m")
def mutual_neighbours(spark, d):
    return N.mutual_nearest(_vectors(spark, d, 0), _vectors(spark, d, 1), TAU).select("l", "r", r6(F.col("sim"), "sim"))


@query("JOIN-09", sql=f"WITH {_mnn(0, 1, 'ab', -1.0)}, {_mnn(0, 2, 'ac', -1.0)}, {_mnn(1, 2, 'bc', -1.0)} SELECT ab.l AS a, ab.r AS b, ac.r AS c FROM ab JOIN ac ON ab.l = ac.l JOIN bc ON bc.l = ab.r AND bc.r = ac.r")
def consistent_triples(spark, d):
    v = [_vectors(spark, d, i) for i in range(3)]
    ab, ac, bc = (N.mutual_nearest(v[i], v[j], -1.0).select("l", "r") for i, j in ((0, 1), (0, 2), (1, 2)))
    t = ab.toDF("a", "b").join(ac.toDF("a", "c"), "a")
    return t.join(bc.toDF("b", "c"), ["b", "c"], "left_semi").select("a", "b", "c")


@query("JOIN-13", sql="SELECT a.role AS lang_a, b.role AS lang_b, count(*) AS n FROM (SELECT DISTINCT conv_id, role FROM conversations) a JOIN (SELECT DISTINCT conv_id, role FROM conversations) b ON a.conv_id = b.conv_id AND a.role < b.role GROUP BY 1, 2")
def language_pairs(spark, d):
    k = table(spark, d, "conversations").select("conv_id", "role").distinct()
    return k.toDF("conv_id", "lang_a").join(k.toDF("conv_id", "lang_b"), "conv_id").where("lang_a < lang_b").groupBy("lang_a", "lang_b").agg(F.count("*").alias("n"))


@query("JOIN-14", "WIN-01", "WIN-02", sql=f"""WITH {D.SQL_SCORES}, m AS (SELECT src_lang, tgt_lang, avg(labse_sim) AS sim, avg((labse_sim < 0.2)::INT::DOUBLE) AS drift, avg(length(tgt_text)) AS len FROM scores GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (ORDER BY sim DESC) + (count(*) OVER (PARTITION BY sim) - 1) / 2.0 AS r1, rank() OVER (ORDER BY drift) + (count(*) OVER (PARTITION BY drift) - 1) / 2.0 AS r2, rank() OVER (ORDER BY len) + (count(*) OVER (PARTITION BY len) - 1) / 2.0 AS r3 FROM m)
SELECT src_lang, tgt_lang, r1, r2, r3, round((r1 + r2 + r3) / 3, 6) AS score, row_number() OVER (ORDER BY (r1 + r2 + r3) / 3, src_lang, tgt_lang) AS place FROM r""")
def direction_ranking(spark, d):
    m = D.scores(spark, d).groupBy("src_lang", "tgt_lang").agg(F.avg("labse_sim").alias("sim"), F.avg((F.col("labse_sim") < 0.2).cast("double")).alias("drift"), F.avg(F.length("tgt_text")).alias("len"))
    m = m.withColumns({"r1": R.average_rank("sim", [], True), "r2": R.average_rank("drift", []), "r3": R.average_rank("len", [])})  # a few directions, one row each
    m = m.withColumn("score", (F.col("r1") + F.col("r2") + F.col("r3")) / 3)
    return m.select("src_lang", "tgt_lang", "r1", "r2", "r3", r6(F.col("score"), "score"), F.row_number().over(W.orderBy("score", "src_lang", "tgt_lang")).alias("place"))


@query("AGG-11", "AGG-12", sql=f"""WITH {P}, e AS (SELECT lang, seed, count(*) AS evaluated FROM preds GROUP BY 1, 2), f AS (SELECT lang, seed, count(*) AS failed FROM preds WHERE pred_src = gold AND pred_tgt <> gold GROUP BY 1, 2)
SELECT lang, seed, evaluated, coalesce(failed, 0) AS failed, round(coalesce(failed, 0)::DOUBLE / evaluated, 6) AS rate FROM e LEFT JOIN f USING (lang, seed)""")
def failure_rates(spark, d):
    p = D.predictions(spark, d).groupBy("lang", "seed").agg(F.count("*").alias("evaluated"), F.count_if(R.mismatch()).alias("failed"))  # one pass instead of two joined counts
    return p.withColumn("rate", F.round(F.col("failed") / F.col("evaluated"), 6))


@query("JOIN-18", sql=f"""WITH {D.SQL_CELLS}, a AS (SELECT encoder, source, target, avg(gap) > 0.25 AS v FROM cells GROUP BY ALL), c AS (SELECT encoder, source, target, avg(gap) > 0.25 AS v FROM cells WHERE seed <> 2 GROUP BY ALL)
SELECT encoder, source, target, a.v AS all_seeds, c.v AS converged FROM a JOIN c USING (encoder, source, target) WHERE a.v <> c.v""")
def verdict_changes(spark, d):
    c = D.cells(spark, d)
    v = c.groupBy("encoder", "source", "target").agg((F.avg("gap") > 0.25).alias("all_seeds"), (F.avg(F.when(F.col("seed") != 2, F.col("gap"))) > 0.25).alias("converged"))
    return v.where("all_seeds <> converged")


@query("JOIN-19", sql=f"WITH {D.SQL_FAILURES} SELECT item_id, seed FROM fails WHERE lang IN (SELECT lang FROM fails WHERE seed = 2 AND label = 'seed_unstable')")
def affected_cells(spark, d):
    f = D.failures(spark, d)
    return f.join(f.where("seed = 2 AND label = 'seed_unstable'").select("lang").distinct(), "lang", "left_semi").select("item_id", "seed")


@query("JOIN-21", sql="SELECT (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) AS pending, count(*) AS n, count(CASE WHEN doc_id % 3 = 0 THEN 1 END) AS done FROM documents")
def resume(spark, d):
    x = table(spark, d, "documents").select("doc_id")
    done = x.where("doc_id % 3 = 0").withColumn("translation", F.lit("t"))
    pending = x.join(done, "doc_id", "left_anti")
    return x.join(done, "doc_id", "left").agg(F.count("*").alias("n"), F.count("translation").alias("done")).crossJoin(pending.agg(F.count("*").alias("pending"))).select("pending", "n", "done")


@query("JOIN-22", sql=f"WITH {D.SQL_SCORES} SELECT count(*) AS n, count(labse_sim) AS scored FROM documents LEFT JOIN scores ON doc_id = item_id")
def score_writeback(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    return x.join(D.scores(spark, d).select("item_id", "labse_sim"), "item_id", "left").agg(F.count("*").alias("n"), F.count("labse_sim").alias("scored"))


@query("JOIN-25", "DIA-06", sql=f"""WITH {P} SELECT a.item_id, a.seed, CASE WHEN a.lang = 'es' THEN 'not_applicable' WHEN b.pred_tgt = b.gold THEN 'fired' ELSE 'not_fired' END AS status FROM preds a LEFT JOIN preds b ON a.item_id = b.item_id AND b.seed = (a.seed + 1) % 3 WHERE a.pred_src = a.gold AND a.pred_tgt <> a.gold""")
def provenance(spark, d):
    p = D.predictions(spark, d)
    twin = p.where("lang <> 'es'").select("item_id", ((F.col("seed") + 2) % 3).alias("seed"), (F.col("pred_tgt") == F.col("gold")).alias("fine"))
    f = p.where(R.mismatch()).select("item_id", "seed").join(twin, ["item_id", "seed"], "left")
    return f.select("item_id", "seed", F.when(F.col("fine").isNull(), "not_applicable").when(F.col("fine"), "fired").otherwise("not_fired").alias("status"))


# ---- aggregations


@query("AGG-01", "AGG-02", "AGG-07", sql=f"""WITH {P}, cls AS (SELECT unnest([0, 1, 2]) AS c), g AS (SELECT lang, seed, count(*) AS n, avg((pred_tgt = gold)::INT::DOUBLE) AS acc FROM preds GROUP BY 1, 2),
f AS (SELECT g.lang, g.seed, c, coalesce(2.0 * sum((gold = c AND pred_tgt = c)::INT) / nullif(sum((gold = c)::INT) + sum((pred_tgt = c)::INT), 0), 0) AS f1 FROM g CROSS JOIN cls JOIN preds p ON p.lang = g.lang AND p.seed = g.seed GROUP BY 1, 2, 3),
m AS (SELECT g.lang, g.seed, any_value(acc) AS acc, avg(f1) AS f1 FROM g JOIN f ON f.lang = g.lang AND f.seed = g.seed GROUP BY 1, 2)
SELECT lang, round(avg(acc), 6) AS accuracy, round(avg(f1), 6) AS mean, round(coalesce(stddev_samp(f1), 0), 6) AS std, count(*) AS n_seeds FROM m GROUP BY 1""")
def macro_f1(spark, d):
    m = R.classification(D.predictions(spark, d), ["lang", "seed"], "gold", "pred_tgt", 3)
    return m.groupBy("lang").agg(r6(F.avg("accuracy"), "accuracy"), r6(F.avg("macro_f1"), "mean"), r6(F.coalesce(F.stddev_samp("macro_f1"), F.lit(0.0)), "std"), F.count("*").alias("n_seeds"))


_DRIFT = "count(*) AS n, round(avg({x}), 6) AS mean, round(quantile_cont({x}, 0.5), 6) AS median, round(quantile_cont({x}, 0.05), 6) AS p05, round(quantile_cont({x}, 0.25), 6) AS p25, sum(({x} < 0.03)::INT)::BIGINT AS below, round(avg(({x} < 0.03)::INT::DOUBLE), 6) AS share"


@query("AGG-03", "AGG-46", "AGG-05", sql=f"SELECT l_returnflag, l_linestatus, {_DRIFT.format(x='l_discount')} FROM lineitem GROUP BY 1, 2")
def drift(spark, d):
    x = table(spark, d, "lineitem").withColumn("b", F.col("l_discount") < 0.03).groupBy("l_returnflag", "l_linestatus")
    q = F.percentile("l_discount", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.25)))
    a = x.agg(F.count("*").alias("n"), r6(F.avg("l_discount"), "mean"), q.alias("q"), F.count_if("b").alias("below"), r6(F.avg(F.col("b").cast("double")), "share"))
    return a.select("*", *[r6(F.col("q")[i], c) for i, c in enumerate(("median", "p05", "p25"))]).drop("q")


@query("AGG-06", sql="SELECT l_returnflag AS direction, round(avg((l_discount > 0.05)::INT::DOUBLE) FILTER (l_tax <= 0.07), 6) AS preserved, sum((l_tax > 0.07)::INT)::BIGINT AS corrupted FROM lineitem GROUP BY 1")
def preservation(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("direction"))
    return x.agg(r6(F.avg(F.when(F.col("l_tax") <= 0.07, (F.col("l_discount") > 0.05).cast("double"))), "preserved"), F.count_if(F.col("l_tax") > 0.07).alias("corrupted"))


_QUAD = "quads(quadrant) AS (VALUES ('A->A'), ('A->B'), ('B->A'), ('B->B'), ('C->A'))"


@query("AGG-08", "AGG-50", sql=f"""WITH {D.SQL_CELLS}, {D.SQL_LANG}, {_QUAD}, c AS (SELECT s.family || '->' || t.family AS quadrant, gap_mean, source || '-' || target AS cond FROM gaps JOIN lang_dim s ON s.lang = source JOIN lang_dim t ON t.lang = target WHERE encoder = 'base')
SELECT quadrant, count(cond) AS n, round(avg(gap_mean), 6) AS mean, list_sort(list_filter(list(cond), lambda x: x IS NOT NULL)) AS conditions FROM quads LEFT JOIN c USING (quadrant) GROUP BY 1""")
def quadrants(spark, d):
    lang = D.lang_dim(spark)
    g = D.gaps(spark, d).where("encoder = 'base'").join(F.broadcast(lang.select(F.col("lang").alias("source"), F.col("family").alias("fs"))), "source").join(F.broadcast(lang.select(F.col("lang").alias("target"), F.col("family").alias("ft"))), "target")
    g = g.groupBy(F.concat("fs", F.lit("->"), "ft").alias("quadrant")).agg(F.count("*").alias("n"), r6(F.avg("gap_mean"), "mean"), F.array_sort(F.collect_list(F.concat("source", F.lit("-"), "target"))).alias("conditions"))
    dim = spark.createDataFrame([(f"{a}->{b}",) for a, b in ("AA", "AB", "BA", "BB", "CA")], "quadrant string")
    return dim.join(g, "quadrant", "left").select("quadrant", F.coalesce("n", F.lit(0)).alias("n"), "mean", F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"))


@query("AGG-09", "AGG-43", sql=f"""WITH {P}, o AS (SELECT *, CASE WHEN item_id % 2 = 0 THEN 'native' ELSE 'mt' END AS origin FROM preds), a AS (SELECT lang, origin, seed, avg((pred_tgt = gold)::INT::DOUBLE) AS acc FROM o GROUP BY ALL),
m AS (SELECT lang, origin, avg(acc) AS mean, coalesce(stddev_samp(acc), 0) AS std FROM a GROUP BY ALL)
SELECT lang, origin, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - max(CASE WHEN origin = 'native' THEN mean END) OVER (PARTITION BY lang), 6) AS delta FROM m""")
def translationese(spark, d):
    o = D.predictions(spark, d).withColumn("origin", F.when(F.col("item_id") % 2 == 0, "native").otherwise("mt"))
    a = o.groupBy("lang", "origin", "seed").agg(F.avg((F.col("pred_tgt") == F.col("gold")).cast("double")).alias("acc"))
    m = R.mean_std(a, ["lang", "origin"], "acc")
    native = F.max(F.when(F.col("origin") == "native", F.col("mean"))).over(W.partitionBy("lang"))
    return m.select("lang", "origin", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"), r6(F.col("mean") - native, "delta"))


@query("AGG-10", sql=f"""WITH {P} SELECT lang, seed, count(*) AS n, sum((pred_src = gold AND pred_tgt <> gold)::INT)::BIGINT AS failed FROM preds GROUP BY GROUPING SETS ((lang, seed), (lang))""")
def mismatch_report(spark, d):
    p = D.predictions(spark, d).withColumn("f", R.mismatch())
    return p.groupingSets([["lang", "seed"], ["lang"]], "lang", "seed").agg(F.count("*").alias("n"), F.count_if("f").alias("failed"))


@query("AGG-13", "AGG-14", sql=f"""WITH {D.SQL_FAILURES}, {D.SQL_LABEL_DIM}, t AS (SELECT lang, count(*) AS total FROM fails GROUP BY 1), c AS (SELECT lang, label, count(*) AS n FROM fails GROUP BY 1, 2)
SELECT t.lang, d.label, coalesce(n, 0) AS n, total, round(coalesce(n, 0)::DOUBLE / total, 6) AS share FROM t CROSS JOIN label_dim d LEFT JOIN c ON c.lang = t.lang AND c.label = d.label""")
def label_shares(spark, d):
    s = R.shares(D.failures(spark, d), ["lang"], "label", D.label_dim(spark))
    return s.withColumn("share", F.round("share", 6))


@query("AGG-15", "AGG-19", "AGG-56", sql=f"""WITH {D.SQL_FAILURES}, {D.SQL_LABEL_DIM}, t AS (SELECT lang, count(*) AS total FROM fails GROUP BY 1), c AS (SELECT lang, label_group, count(*) AS n FROM fails GROUP BY 1, 2),
s AS (SELECT t.lang, g.label_group, coalesce(n, 0)::DOUBLE / total AS share, total FROM t CROSS JOIN (SELECT DISTINCT label_group FROM label_dim) g LEFT JOIN c ON c.lang = t.lang AND c.label_group = g.label_group)
SELECT label_group, round(sum(share * total) / sum(total), 6) AS pooled, round(min(share), 6) AS low, round(max(share), 6) AS high, (SELECT count(*) FROM (SELECT lang FROM s GROUP BY 1 HAVING abs(sum(share) - 1) > 1e-9)) AS broken FROM s GROUP BY 1""")
def pooled_shares(spark, d):
    s = R.shares(D.failures(spark, d), ["lang"], "label_group", D.label_dim(spark).select("label_group").distinct())
    broken = s.groupBy("lang").agg(F.sum("share").alias("t")).agg(F.count_if(F.abs(F.col("t") - 1) > 1e-9).alias("broken"))
    a = s.groupBy("label_group").agg(r6(F.sum(F.col("share") * F.col("total")) / F.sum("total"), "pooled"), r6(F.min("share"), "low"), r6(F.max("share"), "high"))
    return a.crossJoin(broken)


@query("AGG-16", "AGG-17", "AGG-18", sql=f"""WITH {D.SQL_FAILURES}, s AS (SELECT lang, seed, avg((label_group = 'linguistic')::INT::DOUBLE) AS share FROM fails GROUP BY ALL)
SELECT lang, count(*) AS n, sum((share > 0.4)::INT)::BIGINT AS over, round(avg(share), 6) AS mean, string_agg(seed || ': ' || printf('%.3f', share), '; ' ORDER BY seed) AS detail FROM s GROUP BY 1""")
def verdict_rollup(spark, d):
    s = D.failures(spark, d).groupBy("lang", "seed").agg(F.avg((F.col("label_group") == "linguistic").cast("double")).alias("share"))
    text = F.array_sort(F.collect_list(F.struct("seed", F.concat(F.col("seed").cast("string"), F.lit(": "), F.format_string("%.3f", "share")).alias("t"))))
    return s.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("share") > 0.4).alias("over"), r6(F.avg("share"), "mean"), F.array_join(F.transform(text, lambda x: x["t"]), "; ").alias("detail"))


@query("AGG-20", "AGG-29", sql="SELECT lang, quality, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def value_counts(spark, d):
    c = D.labelled(spark, d).groupBy("lang", F.col("gold").alias("quality")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("lang")), 6))


@query("AGG-21", "AGG-22", "AGG-23", "REP-02", sql=f"WITH {D.SQL_FAILURES} SELECT lang, count(*) AS total, " + ", ".join(f"round(avg((label_group = '{g}')::INT::DOUBLE), 6) AS {g}" for g in ("linguistic", "data", "model", "unattributed")) + " FROM fails GROUP BY 1")
def condition_table(spark, d):
    groups = ("linguistic", "data", "model", "unattributed")
    f = D.failures(spark, d).groupBy("lang")
    return f.agg(F.count("*").alias("total"), *[r6(F.avg((F.col("label_group") == g).cast("double")), g) for g in groups])


@query("AGG-24", sql=f"WITH {D.SQL_FAILURES} SELECT item_id, count(*) AS runs, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels, row_number() OVER (ORDER BY count(*) DESC, item_id) AS place FROM fails GROUP BY 1 ORDER BY place LIMIT 50")
def failed_items(spark, d):
    f = D.failures(spark, d).groupBy("item_id").agg(F.count("*").alias("runs"), F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
    top = f.orderBy(F.desc("runs"), "item_id").limit(50)  # the report is a top 50
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("runs"), "item_id")))


@query("AGG-26", sql="""SELECT lang, count(*) AS n, count(DISTINCT text) AS n_texts, count(*) - count(DISTINCT text) AS doubled, min(length(text)) AS shortest, max(length(text)) AS longest, round(quantile_cont(length(text), 0.5), 6) AS median,
  sum((text = '')::INT)::BIGINT AS empty, sum(regexp_matches(text, '[0-9]')::INT)::BIGINT AS with_digit, sum(contains(text, '$')::INT)::BIGINT AS with_currency, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1""")
def split_audit(spark, d):
    x = table(spark, d, "documents").groupBy("lang")
    n = F.length("text")
    texts = F.count_distinct(F.sha2("text", 256))
    return x.agg(F.count("*").alias("n"), texts.alias("n_texts"), (F.count("*") - texts).alias("doubled"), F.min(n).alias("shortest"), F.max(n).alias("longest"), r6(F.percentile(n, 0.5), "median"), F.count_if(F.col("text") == "").alias("empty"),
                 F.count_if(F.col("text").rlike("[0-9]")).alias("with_digit"), F.count_if(F.contains(F.col("text"), F.lit("$"))).alias("with_currency"), F.count_distinct("source").alias("n_sources"))


@query("AGG-28", "ING-02", sql="""SELECT conv_id, list_sort(list(DISTINCT role)) AS roles FROM conversations GROUP BY 1 HAVING count(DISTINCT role) > 1""")
def disagreements(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("roles")).where(F.size("roles") > 1)


@query("AGG-35", "AGG-36", "AGG-47", "AGG-54", "WIN-10", sql=f"""WITH {D.SQL_CELLS} SELECT encoder, target, round(avg(gap_mean), 6) AS mean, arg_min(source, (gap_mean, source)) AS best, arg_max(source, gap_mean) AS worst, string_agg(source, ', ' ORDER BY gap_mean, source) AS ranking, round(coalesce(stddev_samp(gap_mean), 0), 6) AS std FROM gaps GROUP BY 1, 2""")
def source_ranking(spark, d):
    order = F.array_sort(F.collect_list(F.struct("gap_mean", "source")))
    return D.gaps(spark, d).groupBy("encoder", "target").agg(r6(F.avg("gap_mean"), "mean"), F.min_by("source", F.struct("gap_mean", "source")).alias("best"), F.max_by("source", "gap_mean").alias("worst"), F.array_join(F.transform(order, lambda x: x["source"]), ", ").alias("ranking"), r6(F.coalesce(F.stddev_samp("gap_mean"), F.lit(0.0)), "std"))


@query("AGG-37", "CND-08", sql="""WITH e AS (SELECT l_orderkey AS run, list({'epoch': l_linenumber, 'f1': l_discount * 10} ORDER BY l_linenumber) AS h FROM lineitem GROUP BY 1)
SELECT run, round(list_max(list_transform(h, lambda x: x.f1)), 6) AS peak, CASE WHEN len(h) > 1 THEN list_max(list_transform(h, lambda x: x.f1)) >= 0.5 END AS converged FROM e""")
def convergence(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("epoch"), (F.col("l_discount") * 10).alias("f1"))).alias("h"))
    peak = F.array_max(F.transform("h", lambda x: x["f1"]))
    return h.select("run", r6(peak, "peak"), F.when(F.size("h") > 1, peak >= 0.5).alias("converged"))


@query("AGG-38", sql=f"""WITH {P}, g AS (SELECT *, CASE WHEN toxic = 1 THEN 'masked' ELSE 'intact' END AS grp, (pred_src = gold AND pred_tgt <> gold)::INT AS f FROM preds), c AS (SELECT lang, grp, count(*) AS n, avg(f::DOUBLE) AS rate FROM g GROUP BY 1, 2),
w AS (SELECT a.lang, a.n, a.rate AS masked, b.rate AS intact FROM c a JOIN c b ON a.lang = b.lang AND a.grp = 'masked' AND b.grp = 'intact')
SELECT round(sum(masked * n) / sum(n), 6) AS masked, round(sum(intact * n) / sum(n), 6) AS matched, sum((masked > intact)::INT)::BIGINT AS worse, count(*) AS cells FROM w""")
def matched_rates(spark, d):
    g = D.predictions(spark, d).withColumns({"m": F.col("toxic") == 1, "f": R.mismatch().cast("double")})
    w = g.groupBy("lang").agg(F.count_if("m").alias("n"), F.avg(F.when(F.col("m"), F.col("f"))).alias("masked"), F.avg(F.when(~F.col("m"), F.col("f"))).alias("intact")).where("masked IS NOT NULL AND intact IS NOT NULL")
    return w.agg(r6(F.sum(F.col("masked") * F.col("n")) / F.sum("n"), "masked"), r6(F.sum(F.col("intact") * F.col("n")) / F.sum("n"), "matched"), F.count_if(F.col("masked") > F.col("intact")).alias("worse"), F.count("*").alias("cells"))


@query("AGG-39", "AGG-40", sql=f"""WITH {D.SQL_SCORES}, q AS (SELECT src_lang, round(quantile_cont(labse_sim, 0.05), 2) AS tau FROM scores WHERE src_lang = tgt_lang GROUP BY 1)
SELECT src_lang, tau, round(avg((labse_sim < tau)::INT::DOUBLE), 6) AS rejected, CASE WHEN avg((labse_sim < tau)::INT::DOUBLE) > 0.2 THEN 'raise' ELSE 'keep' END AS verdict FROM scores JOIN q USING (src_lang) WHERE src_lang <> tgt_lang GROUP BY 1, 2""")
def calibration(spark, d):
    s = D.scores(spark, d).select("src_lang", "tgt_lang", "labse_sim")
    q = quantiles(s.where("src_lang = tgt_lang"), ["src_lang"], "labse_sim", [0.05]).select("src_lang", F.round(F.col("q")[0], 2).alias("tau"))
    x = s.where("src_lang <> tgt_lang").join(q, "src_lang").groupBy("src_lang", "tau").agg(F.avg((F.col("labse_sim") < F.col("tau")).cast("double")).alias("r"))
    return x.select("src_lang", "tau", r6(F.col("r"), "rejected"), F.when(F.col("r") > 0.2, "raise").otherwise("keep").alias("verdict"))


@query("AGG-42", "AGG-49", sql="""SELECT source AS block_id, count(*) AS n, CASE WHEN count(DISTINCT lang) = 1 THEN max(lang) ELSE 'mixed' END AS origin, min(lang) AS first_lang, sum(n_chars)::BIGINT AS chars, (SELECT count(*) FROM documents) AS total FROM documents GROUP BY 1""")
def manifest_counts(spark, d):
    g = table(spark, d, "documents").groupBy(F.col("source").alias("block_id")).agg(F.count("*").alias("n"), F.when(F.count_distinct("lang") == 1, F.max("lang")).otherwise("mixed").alias("origin"), F.min("lang").alias("first_lang"), F.sum("n_chars").alias("chars"))
    return g.crossJoin(g.agg(F.sum("n").alias("total")))


@query("AGG-44", sql="""SELECT turn, count(*) AS n, count(DISTINCT role) = 1 AS parallel FROM conversations GROUP BY 1""")
def parallelism(spark, d):
    return table(spark, d, "conversations").groupBy("turn").agg(F.count("*").alias("n"), (F.count_distinct("role") == 1).alias("parallel"))


@query("AGG-48", sql=f"WITH {D.SQL_FAILURES} SELECT seed, " + ", ".join(f"round(avg((label IN ('translation_drift', 'terminology_gap'))::INT::DOUBLE) FILTER (lang = '{x}'), 6) AS {x}" for x in D.LANGS) + " FROM fails GROUP BY 1")
def translation_share(spark, d):
    hit = F.col("label").isin("translation_drift", "terminology_gap").cast("double")
    return D.failures(spark, d).groupBy("seed").agg(*[r6(F.avg(F.when(F.col("lang") == x, hit)), x) for x in D.LANGS])


@query("AGG-51", "WIN-05", sql=f"""WITH {P}, c AS (SELECT lang, seed, pred_tgt AS cls, count(*) AS n FROM preds GROUP BY ALL), r AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY lang, seed) AS share, row_number() OVER (PARTITION BY lang, seed ORDER BY n DESC, cls) AS i FROM c),
g AS (SELECT lang, seed, max(m) AS gold_share FROM (SELECT lang, seed, gold, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang, seed) AS m FROM preds GROUP BY lang, seed, gold) GROUP BY 1, 2)
SELECT lang, seed, cls, round(share, 6) AS share, round(gold_share, 6) AS gold_share, share >= 0.62 AS collapsed FROM r JOIN g USING (lang, seed) WHERE i = 1""")
def dominant_class(spark, d):
    p = D.predictions(spark, d)
    c = p.groupBy("lang", "seed", F.col("pred_tgt").alias("cls")).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("lang", "seed")))
    g = p.groupBy("lang", "seed", "gold").agg(F.count("*").alias("m")).withColumn("m", F.col("m") / F.sum("m").over(W.partitionBy("lang", "seed"))).groupBy("lang", "seed").agg(F.max("m").alias("gold_share"))
    top = R.first_per(c, ["lang", "seed"], F.desc("n"), F.col("cls"))
    return top.join(g, ["lang", "seed"]).select("lang", "seed", "cls", r6(F.col("share"), "share"), r6(F.col("gold_share"), "gold_share"), (F.col("share") >= 0.62).alias("collapsed"))


@query("AGG-52", sql=f"WITH {D.SQL_FAILURES} SELECT lang, round(avg((NOT list_has_any(modules_fired, ['gate', 'frag', 'morph', 'saliency']))::INT::DOUBLE), 6) AS before, round(avg((label = 'unattributed')::INT::DOUBLE), 6) AS after FROM fails GROUP BY 1")
def unattributed(spark, d):
    early = F.array(*[F.lit(m) for m in ("gate", "frag", "morph", "saliency")])
    return D.failures(spark, d).groupBy("lang").agg(r6(F.avg((~F.arrays_overlap("modules_fired", early)).cast("double")), "before"), r6(F.avg((F.col("label") == "unattributed").cast("double")), "after"))


@query("AGG-53", sql=f"""WITH {D.SQL_SCORES}, b AS (SELECT quantile_cont(labse_sim, 0.01) AS lo, quantile_cont(labse_sim, 0.99) AS hi FROM scores), h AS (SELECT src_lang = tgt_lang AS same, CASE WHEN labse_sim < lo THEN 0 WHEN labse_sim >= hi THEN 45 ELSE floor((labse_sim - lo) / (hi - lo) * 44)::INT + 1 END AS bin FROM scores, b)
SELECT same, bin, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY same), 6) AS density FROM h GROUP BY 1, 2""")
def histogram(spark, d):
    s = D.scores(spark, d).select((F.col("src_lang") == F.col("tgt_lang")).alias("same"), "labse_sim")
    b = s.agg(F.percentile("labse_sim", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    h = s.crossJoin(F.broadcast(b)).select("same", F.width_bucket("labse_sim", F.col("q")[0], F.col("q")[1], F.lit(44)).alias("bin"))  # one row of bounds
    c = h.groupBy("same", "bin").agg(F.count("*").alias("n"))
    return c.select("same", "bin", r6(F.col("n") / F.sum("n").over(W.partitionBy("same")), "density"))


# ---- windows, sorts and samples


@query("WIN-03", sql="""WITH p AS (SELECT a.vec_id, max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS sim FROM embeddings a, embeddings b WHERE a.label = 0 AND b.label = 1 GROUP BY 1) SELECT vec_id, round(sim, 6) AS sim FROM p""")
def nearest(spark, d):
    p = N.search(_vectors(spark, d, 0), _vectors(spark, d, 1))[0]  # by cells, whatever the size
    return p.select(F.col("id").alias("vec_id"), r6(F.col("sim"), "sim"))


@query("WIN-07", sql="SELECT user_id, event_type, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def last_write(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("WIN-08", "WIN-09", sql=f"""WITH {D.SQL_SCORES}, s AS (SELECT tgt_lang, item_id, labse_sim, CASE WHEN labse_sim < 0.5 THEN 'below' ELSE 'above' END AS side FROM scores)
SELECT tgt_lang, side, item_id FROM s QUALIFY row_number() OVER (PARTITION BY tgt_lang, side ORDER BY abs(labse_sim - 0.5), item_id) <= 5""")
def near_threshold(spark, d):
    s = D.scores(spark, d).withColumn("side", F.when(F.col("labse_sim") < 0.5, "below").otherwise("above"))
    return R.first_per(s, ["tgt_lang", "side"], F.abs(F.col("labse_sim") - 0.5), F.col("item_id"), n=5).select("tgt_lang", "side", "item_id")


@query("KEY-03", "WIN-11", sql="SELECT doc_id, md5(text) || CASE WHEN count(*) OVER (PARTITION BY text) > 1 THEN '#' || row_number() OVER (PARTITION BY text ORDER BY doc_id) ELSE '' END AS key FROM documents")
def repeated_keys(spark, d):
    return R.disambiguate(table(spark, d, "documents").select("doc_id", F.md5("text").alias("key")), "key", F.col("doc_id"))


@query("WIN-12", "WIN-15", sql=f"WITH {D.SQL_FAILURES}, x AS (SELECT item_id, seed, unnest(modules_fired) AS flag FROM fails) SELECT flag, item_id, seed FROM x QUALIFY row_number() OVER (PARTITION BY flag ORDER BY item_id, seed) <= 5")
def flag_examples(spark, d):
    x = D.failures(spark, d).select("item_id", "seed", F.explode("modules_fired").alias("flag"))
    return R.first_per(x, ["flag"], F.col("item_id"), F.col("seed"), n=5).select("flag", "item_id", "seed")


@query("SRT-01", "SRT-02", "SRT-03", sql="SELECT doc_id, lang FROM documents ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 WHEN 'de' THEN 3 ELSE 4 END, n_chars DESC, doc_id LIMIT 40")
def custom_order(spark, d):
    order = F.array_position(F.array(*map(F.lit, ("fr", "en", "de", "es"))), F.col("lang"))
    return table(spark, d, "documents").orderBy(order, F.desc("n_chars"), "doc_id").limit(40).select("doc_id", "lang")  # the report is a top 40


@query("SMP-01", sql="SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) <= 20")
def sampled(spark, d):
    return R.hash_sample(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 20, 7).select("lang", "doc_id")


@query("SMP-02", sql="SELECT doc_id, CASE WHEN p < 0.1 THEN 'test' WHEN p < 0.2 THEN 'dev' ELSE 'train' END AS split FROM (SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id), doc_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY lang) AS p FROM documents)")
def stratified(spark, d):
    return R.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 3, 0.1, 0.1).select("doc_id", "split")


@query("SMP-03", sql="""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY md5('1:' || vec_id), vec_id) AS a, row_number() OVER (ORDER BY md5('2:' || vec_id), vec_id) AS b FROM (SELECT * FROM embeddings WHERE label = 0 ORDER BY md5('1:' || vec_id), vec_id LIMIT 40))
SELECT count(*) AS n, round(avg(list_dot_product(x.v, y.v)), 6) AS mean, round(quantile_cont(list_dot_product(x.v, y.v), 0.5), 6) AS median, round(quantile_cont(list_dot_product(x.v, y.v), 0.95), 6) AS p95, round(avg((list_dot_product(x.v, y.v) >= 0.2)::INT::DOUBLE), 6) AS share FROM e x JOIN e y ON x.a = y.b""")
def shuffled_control(spark, d):
    from crossgauge.functions.vectors import dot

    e = _vectors(spark, d, 0)
    a = R.hash_sample(e, [], "id", 40, 1)  # a bounded sample is the operator
    b = R.hash_sample(a.drop("pick"), [], "id", 40, 2)
    x = a.select("pick", F.col("v").alias("x")).join(b.select("pick", F.col("v").alias("y")), "pick").select(dot(F.col("x"), F.col("y")).alias("s"))
    return x.agg(F.count("*").alias("n"), r6(F.avg("s"), "mean"), r6(F.percentile("s", 0.5), "median"), r6(F.percentile("s", 0.95), "p95"), r6(F.avg((F.col("s") >= 0.2).cast("double")), "share"))


# ---- sets


@query("SET-01", "SET-02", sql="SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'en') UNION ALL SELECT 'all', (SELECT count(*) FROM labels) + (SELECT count(*) FROM documents WHERE lang = 'en')")
def set_algebra(spark, d):
    a, b = table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    both, every = a.intersect(b), a.unionByName(b)
    return both.agg(F.count("*").alias("n")).select(F.lit("both").alias("kind"), "n").union(every.agg(F.count("*").alias("n")).select(F.lit("all").alias("kind"), "n"))


@query("SET-07", "SET-08", sql=f"""WITH {D.SQL_FAILURES}, r AS (SELECT item_id, seed, list_filter(modules_fired, lambda m: m <> 'saliency') AS k, seed = 1 AS again FROM fails)
SELECT item_id, seed, list_filter([{', '.join(repr(m) for m, _ in D.PRECEDENCE)}], lambda m: list_contains(k, m) OR (again AND m = 'saliency')) AS modules FROM r""")
def module_rewrite(spark, d):
    order = F.array(*[F.lit(m) for m, _ in D.PRECEDENCE])
    kept = F.filter("modules_fired", lambda m: m != "saliency")
    new = F.when(F.col("seed") == 1, F.array_union(kept, F.array(F.lit("saliency")))).otherwise(kept)
    return D.failures(spark, d).withColumn("new", new).select("item_id", "seed", F.filter(order, lambda m: F.array_contains(F.col("new"), m)).alias("modules"))
