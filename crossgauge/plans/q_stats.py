"""Statistics, diagnostics and condition algebra: inventory sections 2.9 to 2.11 and the rest of 2.4."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.functions.keys import md5_bucket, partition_of
from crossgauge.operators import bootstrap as B
from crossgauge.operators import conditions as C
from crossgauge.operators import diagnose as G
from crossgauge.operators import relational as R
from crossgauge.plans import derived as D
from crossgauge.plans.registry import query
from crossgauge.session import table
from crossgauge.sources import io as S

P = D.SQL_PREDS
N_BOOT = 1000
r6 = lambda c, name: F.round(c, 6).alias(name)


def _mix_sql(x: str) -> str:
    """The bootstrap's integer mixer of an expression."""
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * {B.MIX}) & {B.MASK})"
    return f"xor({x}, {x} >> 16)"


#: Tables of up to 2**11 coins: enough for 4095 rows of a key.
_COINS = [B.fair_coins(k) for k in range(12)]


def _draws_sql(keys: str, cell: str) -> str:
    """draws(keys, b, cell, m) from a CTE cells(keys, cell, n): the same splits as bootstrap.resampled. It needs WITH RECURSIVE."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of_u = ", ".join(f"u.{c}" for c in cell.split(", "))
    digit = _mix_sql(f"((x + (k + 1) * {B.DIGIT}) & {B.MASK})")
    left = f"coalesce(list_sum(list_transform(range(12), lambda k: CASE WHEN (m >> k) & 1 = 1 THEN firsts[k + 1] + len(list_filter(coins[k + 1], lambda c: c <= {digit})) ELSE 0 END)), 0)::BIGINT"
    return f"""upto AS (SELECT *, sum(n) OVER w::BIGINT AS hi, row_number() OVER w AS i FROM cells WINDOW w AS (PARTITION BY {keys} ORDER BY {cell})),
tot AS (SELECT {keys}, sum(n)::BIGINT AS total, count(*) AS n_cells FROM cells GROUP BY ALL),
draw AS (SELECT b, {_mix_sql('(b + 1)')} AS h FROM (SELECT unnest(range({N_BOOT}))::BIGINT AS b)),
tables AS (SELECT {[list(t) for _, t in _COINS]} AS coins, {[f for f, _ in _COINS]} AS firsts),
walk AS (SELECT u.i, {', '.join(f'u.{k}' for k in keys.split(', '))}, (u.hi << {B.LEVELS}) // total AS bound, b, h, 0 AS level, 1::BIGINT AS node, total AS m, 0::BIGINT AS below FROM upto u JOIN tot t ON {on('u', 't')} AND u.i < n_cells, draw
  UNION ALL SELECT i, {keys}, bound, b, h, level + 1, 2 * node + goes, CASE WHEN goes = 1 THEN m - x ELSE x END, below + goes * x FROM
  (SELECT * EXCLUDE (x), {left} AS x FROM (SELECT *, (bound >> ({B.LEVELS - 1} - level)) & 1 AS goes, {_mix_sql(f'((h + node * {B.STEP}) & {B.MASK})')} AS x FROM walk, tables WHERE m > 0 AND level < {B.LEVELS}))),
edges AS (SELECT i, {keys}, b, max(below) AS edge FROM walk GROUP BY ALL UNION ALL SELECT n_cells, {keys}, b, total FROM tot, draw),
draws AS (SELECT {', '.join(f'e.{k}' for k in keys.split(', '))}, e.b, {of_u}, e.edge - coalesce(lag(e.edge) OVER (PARTITION BY {', '.join(f'e.{k}' for k in keys.split(', '))}, e.b ORDER BY e.i), 0) AS m FROM edges e JOIN upto u ON {on('e', 'u')} AND e.i = u.i)"""


_CELLS = "cells AS (SELECT lang, seed, gold, pred_src, pred_tgt, count(*) AS n FROM preds GROUP BY ALL)"
_BY_RUN = f"{_CELLS}, {_draws_sql('lang, seed', 'gold, pred_src, pred_tgt')}"


def _f1_sql(pred: str) -> str:
    def one(k):
        return f"coalesce(sum(CASE WHEN gold = {k} AND {pred} = {k} THEN 2 * m ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN gold = {k} THEN m ELSE 0 END + CASE WHEN {pred} = {k} THEN m ELSE 0 END), 0), 0)"

    return f"({one(0)} + {one(1)}) / 2"


def _run_draws(spark, d):
    cells = D.predictions(spark, d).groupBy("lang", "seed", "gold", "pred_src", "pred_tgt").agg(F.count("*").alias("n"))
    return cells, B.resampled(cells, ["lang", "seed"], ["gold", "pred_src", "pred_tgt"], "n", N_BOOT)


@query("STA-01", sql=f"""WITH RECURSIVE {P}, {_BY_RUN}, a AS (SELECT lang, seed, b, {_f1_sql('pred_tgt')} AS f1 FROM draws GROUP BY 1, 2, 3)
SELECT lang, seed, round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high FROM a GROUP BY 1, 2""")
def metric_interval(spark, d):
    """Item bootstrap of macro-F1, every language and seed."""
    _, draws = _run_draws(spark, d)
    ci = B.interval(draws.groupBy("lang", "seed", "b").agg(R.weighted_macro_f1("pred_tgt", "m", 2).alias("f1")), ["lang", "seed"], "f1")
    return ci.select("lang", "seed", r6(F.col("low"), "low"), r6(F.col("high"), "high"))


_GAP = "(sum(CASE WHEN pred_src = gold THEN m ELSE 0 END) - sum(CASE WHEN pred_tgt = gold THEN m ELSE 0 END))::DOUBLE / sum(m)"


def _gap(n):
    right = lambda c: F.sum(F.when(F.col(c) == F.col("gold"), F.col(n)).otherwise(0))
    return (right("pred_src") - right("pred_tgt")).cast("double") / F.sum(n)


def run_gaps(spark, d):
    """lang, seed, n_items, gap, low, high of every run; the interval's draws take both sides' rows together."""
    cells, draws = _run_draws(spark, d)
    ci = B.interval(draws.groupBy("lang", "seed", "b").agg(_gap("m").alias("gap")), ["lang", "seed"], "gap")
    return cells.groupBy("lang", "seed").agg(F.sum("n").alias("n_items"), _gap("n").alias("gap")).join(ci, ["lang", "seed"])


_GAPS_SQL = f"""{_BY_RUN}, g AS (SELECT lang, seed, b, {_GAP} AS gap FROM draws GROUP BY 1, 2, 3),
ci AS (SELECT lang, seed, quantile_cont(gap, 0.025) AS low, quantile_cont(gap, 0.975) AS high FROM g GROUP BY 1, 2),
pt AS (SELECT lang, seed, sum(m)::BIGINT AS n_items, {_GAP} AS gap FROM (SELECT *, n AS m FROM cells) GROUP BY 1, 2)"""


@query("STA-02", "STA-03", sql=f"""WITH RECURSIVE {P}, {_GAPS_SQL} SELECT lang, seed, round(gap, 6) AS gap, round(low, 6) AS low, round(high, 6) AS high, low <= 0 AND high >= 0 AS ci_contains_zero FROM pt JOIN ci USING (lang, seed)""")
def transfer_gap(spark, d):
    g = run_gaps(spark, d)
    return g.select("lang", "seed", *[r6(F.col(c), c) for c in ("gap", "low", "high")], ((F.col("low") <= 0) & (F.col("high") >= 0)).alias("ci_contains_zero"))


@query("STA-11", sql=f"""WITH {P}, g AS (SELECT lang, seed, avg((pred_src = gold)::INT::DOUBLE) - avg((pred_tgt = gold)::INT::DOUBLE) AS gap FROM preds WHERE lang <> 'fr' OR seed = 0 GROUP BY 1, 2)
SELECT lang, count(*) AS n_seeds, round(avg(gap), 6) AS gap_mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(gap) ELSE 0 END, 6) AS gap_std, CASE WHEN count(*) > 1 THEN abs(avg(gap)) < stddev_samp(gap) END AS within_seed_noise FROM g GROUP BY 1""")
def seed_noise(spark, d):
    """Whether a gap is smaller than its deviation over the seeds; unknown for a language with one seed."""
    right = lambda c: F.avg((F.col(c) == F.col("gold")).cast("double"))
    g = D.predictions(spark, d).where("lang <> 'fr' OR seed = 0").groupBy("lang", "seed").agg((right("pred_src") - right("pred_tgt")).alias("gap"))
    m = R.mean_std(g, ["lang"], "gap")
    return m.select("lang", F.col("n").alias("n_seeds"), r6(F.col("mean"), "gap_mean"), r6(F.col("std"), "gap_std"), F.when(F.col("n") > 1, F.abs("mean") < F.col("std")).alias("within_seed_noise"))


@query("CND-04", sql=f"""WITH RECURSIVE {P}, {_GAPS_SQL} SELECT 'task2_' || lang || '_seed' || seed AS run_id, n_items, round(gap, 6) AS gap, round(low, 6) AS low, round(high, 6) AS high FROM pt JOIN ci USING (lang, seed)""")
def run_condition(spark, d):
    """A condition's arms become a prediction log, the log a gap with its interval, the gap a row of the run log."""
    path = S.scratch(spark, "runs")
    runs = run_gaps(spark, d).select(F.concat(F.lit("task2_"), "lang", F.lit("_seed"), "seed").alias("run_id"), "n_items", "gap", "low", "high")
    S.append_log(runs, path)
    return S.read_log(spark, path, "run_id string, n_items long, gap double, low double, high double")


_UNITS = f"""units AS (SELECT seed, lang IN ('fr', 'es') AS side, lang, item_id, count(*) AS size, sum((label_group = 'linguistic')::INT)::BIGINT AS hits FROM fails GROUP BY ALL),
cells AS (SELECT seed, side, size, hits, count(*) AS n FROM units GROUP BY ALL), {_draws_sql('seed, side', 'size, hits')},
ud AS (SELECT seed, side, b, sum(m * hits)::DOUBLE / sum(m * size) AS share FROM draws GROUP BY 1, 2, 3),
ci AS (SELECT seed, side, quantile_cont(share, 0.025) AS low, quantile_cont(share, 0.975) AS high FROM ud GROUP BY 1, 2), pt AS (SELECT seed, side, sum(hits)::DOUBLE / sum(size) AS share FROM units GROUP BY 1, 2)"""


def _share_ci(spark, d):
    """Share of linguistic failures, resampled by cluster: a unit's failures stay together, units of one size and one count are alike."""
    units = D.failures(spark, d).groupBy("seed", F.col("lang").isin("fr", "es").alias("side"), "lang", "item_id").agg(F.count("*").alias("size"), F.count_if(F.col("label_group") == "linguistic").alias("hits"))
    cells = units.groupBy("seed", "side", "size", "hits").agg(F.count("*").alias("n"))
    share = lambda n: (F.sum(F.col(n) * F.col("hits")).cast("double") / F.sum(F.col(n) * F.col("size"))).alias("share")
    draws = B.resampled(cells, ["seed", "side"], ["size", "hits"], "n", N_BOOT)
    ci = B.interval(draws.groupBy("seed", "side", "b").agg(share("m")), ["seed", "side"], "share")
    return cells.groupBy("seed", "side").agg(share("n")).join(ci, ["seed", "side"])


@query("STA-04", sql=f"WITH RECURSIVE {D.SQL_FAILURES}, {_UNITS} SELECT seed, side, round(share, 6) AS share, round(low, 6) AS low, round(high, 6) AS high FROM pt JOIN ci USING (seed, side)")
def cluster_bootstrap(spark, d):
    return _share_ci(spark, d).select("seed", "side", r6(F.col("share"), "share"), r6(F.col("low"), "low"), r6(F.col("high"), "high"))


_VERDICT = "CASE WHEN sum(sep::INT) = 0 THEN 'within noise' WHEN count(DISTINCT diff > 0) FILTER (sep) > 1 THEN 'seeds disagree' WHEN sum(sep::INT) = count(*) THEN 'held' ELSE 'one seed only' END"
_COMPARED = "c AS (SELECT a.seed, a.high < b.low OR b.high < a.low AS sep, pa.share - pb.share AS diff FROM ci a JOIN ci b ON a.seed = b.seed AND a.side AND NOT b.side JOIN pt pa ON pa.seed = a.seed AND pa.side JOIN pt pb ON pb.seed = a.seed AND NOT pb.side)"


def _compared(spark, d):
    """seed, sep, diff: group A against group B in every replicate."""
    s = _share_ci(spark, d)
    a, b = s.where("side").drop("side").toDF("seed", "a", "a_low", "a_high"), s.where("NOT side").drop("side").toDF("seed", "b", "b_low", "b_high")
    sep = B.separated(F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high"))
    return a.join(b, "seed").select(F.lit("linguistic").alias("measure"), "seed", sep.alias("sep"), (F.col("a") - F.col("b")).alias("diff"))


@query("STA-05", "STA-07", sql=f"WITH RECURSIVE {D.SQL_FAILURES}, {_UNITS}, {_COMPARED} SELECT 'linguistic' AS measure, seed, sep, round(diff, 6) AS diff FROM c")
def compared_groups(spark, d):
    return _compared(spark, d).select("measure", "seed", "sep", r6(F.col("diff"), "diff"))


@query("STA-06", sql=f"WITH RECURSIVE {D.SQL_FAILURES}, {_UNITS}, {_COMPARED} SELECT 'linguistic' AS measure, {_VERDICT} AS verdict FROM c")
def share_verdict(spark, d):
    return B.verdict(_compared(spark, d), ["measure"], "sep", "diff", "seed")


@query("STA-08", sql=f"WITH RECURSIVE {D.SQL_FAILURES}, {_UNITS}, {_COMPARED} SELECT 'all' AS scope, 'linguistic' AS measure, {_VERDICT} AS verdict FROM c UNION ALL SELECT 'converged', 'linguistic', {_VERDICT} FROM c WHERE seed <> 2")
def verdicts_by_scope(spark, d):
    """The same comparison over all seeds and over those that converged; one pass over the intervals serves both."""
    scopes = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("seed") != 2, "converged")))).alias("scope")
    return B.verdict(_compared(spark, d).select("*", scopes), ["scope", "measure"], "sep", "diff", "seed")


@query("STA-01-counts")
def counted_interval(spark, d):
    c = R.confusion(D.predictions(spark, d).withColumn("ok", F.col("pred_tgt") == F.col("gold")).select("lang", F.col("ok").cast("int").alias("ok"), F.lit(0).alias("z")), ["lang"], "ok", "z")
    return B.count_bootstrap(c, ["lang"], "ok", "n", 1, 500)


@query("STA-14", sql="SELECT p_size % 7 AS encoder, coalesce(max(b) FILTER (p_size * b <= 400), 0) AS largest FROM part, (SELECT unnest([8, 16, 32, 64]) AS b) GROUP BY 1")
def largest_batch(spark, d):
    x = table(spark, d, "part").select("p_size", F.explode(F.array(*map(F.lit, (8, 16, 32, 64)))).alias("b"))
    return x.groupBy((F.col("p_size") % 7).alias("encoder")).agg(F.coalesce(F.max(F.when(F.col("p_size") * F.col("b") <= 400, F.col("b"))), F.lit(0)).alias("largest"))


@query("STA-10", "JOIN-27", sql=f"""WITH {D.SQL_CELLS} SELECT a.source, a.target, round(a.gap_mean, 6) AS base, round(b.gap_mean, 6) AS large, round(b.gap_mean - a.gap_mean, 6) AS delta, abs(b.gap_mean - a.gap_mean) > sqrt(a.gap_std * a.gap_std + b.gap_std * b.gap_std) AS beyond_noise, round(b.gap_mean / nullif(a.gap_mean, 0), 6) AS ratio FROM gaps a JOIN gaps b ON a.source = b.source AND a.target = b.target AND a.encoder = 'base' AND b.encoder = 'large'""")
def encoder_comparison(spark, d):
    g = D.gaps(spark, d).groupBy("source", "target").pivot("encoder", list(D.ENCODERS)).agg(F.first("gap_mean").alias("m"), F.first("gap_std").alias("s"))
    delta = F.col("large_m") - F.col("base_m")
    return g.where("base_m IS NOT NULL AND large_m IS NOT NULL").select("source", "target", r6(F.col("base_m"), "base"), r6(F.col("large_m"), "large"), r6(delta, "delta"), B.exceeds_noise(delta, F.col("base_s"), F.col("large_s")).alias("beyond_noise"), r6(F.try_divide("large_m", "base_m"), "ratio"))


@query("STA-12", "JOIN-26", sql=f"""WITH {P}, o AS (SELECT lang, avg((pred_tgt = gold)::INT::DOUBLE) AS ours FROM preds GROUP BY 1), p(lang, published, diagnosed) AS (VALUES ('en', 0.66, false), ('de', 0.9, true), ('fr', 0.8, false), ('es', 0.2, false), ('xx', 0.5, false))
SELECT p.lang, CASE WHEN ours IS NULL THEN 'missing' WHEN ours > published + 0.02 THEN 'above' WHEN abs(ours - published) <= 0.02 THEN 'within' WHEN diagnosed THEN 'below, diagnosed' ELSE 'below, NO diagnosis' END AS status FROM p LEFT JOIN o USING (lang)""")
def baseline_gate(spark, d):
    pub = spark.createDataFrame([("en", 0.66, False), ("de", 0.9, True), ("fr", 0.8, False), ("es", 0.2, False), ("xx", 0.5, False)], "lang string, published double, diagnosed boolean")
    ours = D.predictions(spark, d).groupBy("lang").agg(F.avg((F.col("pred_tgt") == F.col("gold")).cast("double")).alias("ours"))
    return pub.join(ours, "lang", "left").select("lang", G.gate_status(F.col("ours"), F.col("published"), F.col("diagnosed"), 0.02).alias("status"))


@query("STA-13", "STA-16", sql="""SELECT p_partkey AS k, p_size * 1000000 AS params, round(16.0 * p_size * 1000000 / 1073741824, 6) AS floor_gib, round(greatest(0, p_retailprice / 100 - 16.0 * p_size * 1000000 / 1073741824), 6) AS activation_gib FROM part""")
def memory_model(spark, d):
    params = (F.col("p_size") * 1000000).alias("params")
    floor = F.lit(16.0) * F.col("p_size") * 1000000 / (1 << 30)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), params, r6(floor, "floor_gib"), r6(F.greatest(F.lit(0.0), F.col("p_retailprice") / 100 - floor), "activation_gib"))


@query("STA-17", sql=f"""WITH {D.SQL_CELLS}, v AS (SELECT encoder, source, string_agg(target, ',' ORDER BY target) AS targets, avg(gap_mean) > 0.25 AS held FROM gaps GROUP BY 1, 2 UNION ALL SELECT encoder, source, string_agg(target, ',' ORDER BY target), avg(gap_mean) > 0.25 FROM gaps WHERE target <> 'en' GROUP BY 1, 2)
SELECT a.encoder, a.source, a.targets, a.held, b.held AS held_without FROM v a JOIN v b ON a.encoder = b.encoder AND a.source = b.source AND contains(a.targets, 'en') AND NOT contains(b.targets, 'en')""")
def sibling_verdict(spark, d):
    g = D.gaps(spark, d)

    def rolled(x):
        return x.groupBy("encoder", "source").agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("targets"), (F.avg("gap_mean") > 0.25).alias("held"))

    a, b = rolled(g).where(F.contains(F.col("targets"), F.lit("en"))), rolled(g.where("target <> 'en'")).select("encoder", "source", F.col("held").alias("held_without"))
    return a.join(b, ["encoder", "source"])


@query("JOIN-30", sql=f"WITH {D.SQL_CELLS} SELECT a.encoder, a.source, a.target, round(a.gap_mean, 6) AS forward, round(b.gap_mean, 6) AS backward, round(abs(a.gap_mean - b.gap_mean), 6) AS asymmetry FROM gaps a JOIN gaps b ON a.encoder = b.encoder AND a.source = b.target AND a.target = b.source AND a.source < a.target")
def asymmetries(spark, d):
    g = D.gaps(spark, d).select("encoder", "source", "target", "gap_mean")
    b = g.select("encoder", F.col("target").alias("source"), F.col("source").alias("target"), F.col("gap_mean").alias("back"))
    return g.join(b, ["encoder", "source", "target"]).where("source < target").select("encoder", "source", "target", r6(F.col("gap_mean"), "forward"), r6(F.col("back"), "backward"), r6(F.abs(F.col("gap_mean") - F.col("back")), "asymmetry"))


# ---- diagnostics


@query("DIA-01", "DIA-02", "DIA-03", "DIA-04", "DIA-05", "DIA-10", sql=f"""WITH {D.SQL_FAILURES}, g AS (SELECT item_id, seed, labse_sim, CASE WHEN labse_sim < 0.2 THEN ['gate'] ELSE list_filter(modules_fired, lambda m: m <> 'gate') END AS fired FROM fails)
SELECT item_id, seed, CASE WHEN labse_sim < 0.2 THEN 'fired' ELSE 'passed' END AS gate_status, CASE WHEN labse_sim < 0.2 THEN 'not_evaluated' WHEN list_contains(fired, 'frag') THEN 'fired' ELSE 'not_fired' END AS frag_status, CASE {' '.join(f"WHEN list_contains(fired, '{m}') THEN '{x}'" for m, x in D.PRECEDENCE)} ELSE 'unattributed' END AS assigned FROM g""")
def router(spark, d):
    return G.route(D.failures(spark, d), 0.2).select("item_id", "seed", "gate_status", "frag_status", "assigned")


@query("DIA-07", sql=f"""WITH {D.SQL_FAILURES}, x AS (SELECT block_id, seed, count(DISTINCT lang) AS n FROM fails GROUP BY 1, 2) SELECT item_id, seed, n >= 3 AS hard FROM fails JOIN x USING (block_id, seed)""")
def cross_lingual(spark, d):
    f = D.failures(spark, d).select("item_id", "seed", "block_id", "lang")
    n = f.groupBy("block_id", "seed").agg(F.count_distinct("lang").alias("n"))
    return f.join(n, ["block_id", "seed"]).select("item_id", "seed", (F.col("n") >= 3).alias("hard"))


@query("DIA-08", sql=f"""WITH {P}, q AS (SELECT item_id, lang, gold, CASE WHEN {D.b(100, '3', 'item_id', "'col'")} < 90 THEN 1 ELSE 0 END AS pred FROM preds WHERE seed = 0), c AS (SELECT lang, pred, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang) AS share FROM q GROUP BY 1, 2)
SELECT item_id, share >= 0.75 AND pred = 1 AS collapsed FROM q JOIN (SELECT lang, max(share) AS share FROM c GROUP BY 1) USING (lang)""")
def collapse(spark, d):
    q = D.predictions(spark, d).where("seed = 0").select("item_id", "lang", F.when(md5_bucket(100, F.lit(3), F.col("item_id"), F.lit("col")) < 90, 1).otherwise(0).alias("pred"))
    return G.collapsed(q, ["lang"], "pred", 0.75).select("item_id", F.col("collapsed"))


@query("DIA-09", "DIA-11", sql=f"""WITH {P}, ok AS (SELECT item_id, seed FROM preds WHERE pred_src = gold AND pred_tgt = gold) SELECT f.item_id, f.seed, EXISTS (SELECT 1 FROM ok WHERE ok.item_id = f.item_id AND ok.seed <> f.seed) AS unstable FROM preds f WHERE pred_src = gold AND pred_tgt <> gold""")
def seed_unstable(spark, d):
    p = D.predictions(spark, d)
    ok = F.collect_set(F.when(R.both_correct(), F.col("seed"))).over(W.partitionBy("item_id"))
    return p.withColumn("ok", ok).where(R.mismatch()).select("item_id", "seed", (F.size(F.array_remove("ok", F.col("seed"))) > 0).alias("unstable"))


@query("DIA-12", "DIA-15", "DIA-14", sql=f"""WITH {D.SQL_FAILURES}, t(lang, cut) AS (VALUES ('de', 0.7)), x AS (SELECT lang, labse_sim, list_contains(modules_fired, 'saliency') AS old, labse_sim >= coalesce(cut, 0.8) AS new, CASE WHEN seed = 0 THEN NULL ELSE 50 * seed END AS steps FROM fails LEFT JOIN t USING (lang))
SELECT lang, count(*) AS n, sum((old <> new)::INT)::BIGINT AS changed, sum((coalesce(steps, 50) < 100 AND new)::INT)::BIGINT AS redo FROM x GROUP BY 1""")
def rethreshold(spark, d):
    cut = spark.createDataFrame([("de", 0.7)], "lang string, cut double")
    x = D.failures(spark, d).join(F.broadcast(cut), "lang", "left")
    old, new = F.array_contains("modules_fired", "saliency"), F.col("labse_sim") >= F.coalesce("cut", F.lit(0.8))
    steps = F.coalesce(F.when(F.col("seed") != 0, 50 * F.col("seed")), F.lit(50))
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(old != new).alias("changed"), F.count_if((steps < 100) & new).alias("redo"))


@query("DIA-16", sql=f"""WITH {D.SQL_FAILURES}, s AS (SELECT lang, CASE WHEN seed = 0 THEN 'not_applicable' WHEN labse_sim > 0.9 THEN 'not_converged' WHEN labse_sim >= 0.5 THEN 'fired' ELSE 'not_fired' END AS status FROM fails) SELECT lang, status, count(*) AS n FROM s GROUP BY 1, 2""")
def saliency_status(spark, d):
    s = G.saliency_status(F.col("seed") != 0, F.col("labse_sim") <= 0.9, F.col("labse_sim"), 0.5)
    return D.failures(spark, d).groupBy("lang", s.alias("status")).agg(F.count("*").alias("n"))


@query("DIA-17", "DIA-18", sql=f"""WITH {D.SQL_FAILURES} SELECT p.item_id, p.seed, CASE WHEN f.label IS NOT NULL THEN f.label WHEN p.pred_src <> p.gold THEN 'wrong in source too' ELSE 'right in both' END AS outcome FROM preds p LEFT JOIN fails f ON f.item_id = p.item_id AND f.seed = p.seed""")
def outcome_ladder(spark, d):
    f = D.failures(spark, d).select("item_id", "seed", "label")
    return D.predictions(spark, d).join(f, ["item_id", "seed"], "left").select("item_id", "seed", F.coalesce("label", F.when(F.col("pred_src") != F.col("gold"), "wrong in source too").otherwise("right in both")).alias("outcome"))


# ---- conditions


_NAT = f"""{D.SQL_FOUND_LANGS}, tr AS (SELECT 'transfer' AS kind, s.native_block AS block, s.lang AS source, t.lang AS target, s.family || '->' || t.family AS quadrant FROM lang_dim s, lang_dim t WHERE s.lang <> t.lang AND s.native_block IS NOT NULL),
conds AS (SELECT kind, block || '_to_' || target AS name, quadrant, block || '/' || source AS train, coalesce((SELECT min(native_block) FROM lang_dim n WHERE n.lang = target), (SELECT min(native_block) FROM lang_dim o WHERE o.native_block <> block)) || '/' || target AS eval FROM tr
UNION ALL SELECT 'transfer_mt', block || '_to_' || target || '_mt', quadrant, block || '/' || source, block || '/' || target FROM tr
UNION ALL SELECT 'translationese', 'within_' || lang, family || '->' || family, native_block || '/' || lang, string_agg(DISTINCT o.b || '/' || lang, '|' ORDER BY o.b || '/' || lang) FROM lang_dim, (SELECT native_block AS b FROM lang_dim WHERE native_block IS NOT NULL) o WHERE native_block IS NOT NULL GROUP BY lang, family, native_block)"""


@query("CND-01", "CND-02", "CND-03", sql=f"""WITH {_NAT}, parts AS (SELECT lang, count(*) FILTER (u < 0.5) AS n_train, count(*) FILTER (u >= 0.5) AS n_eval FROM (SELECT lang, ('0x' || substr(sha256('20260903:' || doc_id), 1, 8))::BIGINT / 4294967295.0 AS u FROM documents) GROUP BY 1)
SELECT kind, name, quadrant, train, eval, t.n_train, e.n_eval FROM conds JOIN parts t ON t.lang = split_part(train, '/', 2) JOIN parts e ON e.lang = regexp_extract(eval, '[^/]*$')""")
def condition_matrix(spark, d):
    """The conditions that the documents' languages and blocks allow, with the documents that each trains and is evaluated on."""
    m = C.matrix(D.found_langs(spark, d)).select("kind", "name", "quadrant", "train", F.array_join("eval", "|").alias("eval"))
    part = partition_of(F.col("doc_id"), 20260903)
    n = table(spark, d, "documents").groupBy("lang").agg(F.count_if(part == "train").alias("n_train"), F.count_if(part == "eval").alias("n_eval"))
    m = m.withColumns({"a": F.substring_index("train", "/", -1), "b": F.substring_index("eval", "/", -1)})
    return m.join(n.select(F.col("lang").alias("a"), "n_train"), "a").join(n.select(F.col("lang").alias("b"), "n_eval"), "b").drop("a", "b")


@query("JOIN-31", sql=f"WITH {P}, {D.SQL_GOOD_RUNS}, {_NAT} SELECT name, s.seed, CASE WHEN g.lang IS NULL THEN 'blocked' ELSE 'runnable' END AS status FROM conds CROSS JOIN (SELECT unnest([0, 1, 2]) AS seed) s LEFT JOIN good_runs g ON g.lang = split_part(train, '/', 2) AND g.seed = s.seed")
def run_plan(spark, d):
    """Conditions and seeds against the checkpoints that the logs show."""
    return C.plan(C.matrix(D.found_langs(spark, d)), D.SEEDS, D.good_runs(spark, d).withColumnRenamed("lang", "model_lang")).select("name", "seed", "status")


@query("FLT-13", sql="""WITH s AS (SELECT source, CASE WHEN ('0x' || substr(sha256('1:' || doc_id), 1, 8))::BIGINT / 4294967295.0 < 0.5 THEN 'train' ELSE 'eval' END AS part, text FROM documents) SELECT source, count(DISTINCT text) AS leaked FROM s WHERE part = 'eval' AND text IN (SELECT t.text FROM s t WHERE t.part = 'train') GROUP BY 1""")
def leaks(spark, d):
    s = table(spark, d, "documents").select("source", partition_of(F.col("doc_id"), 1).alias("part"), F.sha2("text", 256).alias("t"))
    return s.where("part = 'eval'").join(s.where("part = 'train'").select("t").distinct(), "t", "left_semi").groupBy("source").agg(F.count_distinct("t").alias("leaked"))


@query("CND-06", sql=f"WITH {D.SQL_CELLS} SELECT encoder, source, target, round(avg(gap), 6) AS gap, count(*) AS n_seeds FROM cells WHERE NOT (source = 'de' AND seed = 2) GROUP BY 1, 2, 3")
def cells_without(spark, d):
    bad = spark.createDataFrame([("de", 2)], "source string, seed int")
    return D.cells(spark, d).join(F.broadcast(bad), ["source", "seed"], "left_anti").groupBy("encoder", "source", "target").agg(r6(F.avg("gap"), "gap"), F.count("*").alias("n_seeds"))


_CONFIGS = """c AS (SELECT lang, source, (count(*) % 3)::VARCHAR AS warmup, (CASE WHEN avg(n_chars) > 2000 THEN 8 ELSE 16 END)::VARCHAR AS batch, (CASE WHEN avg(n_chars) > 2000 THEN 2 * (1 + count(*) % 2) ELSE 1 + count(*) % 2 END)::VARCHAR AS steps, max(length(text))::VARCHAR AS longest FROM documents GROUP BY 1, 2)"""


@query("CND-09", sql=f"""WITH {_CONFIGS}, l AS (UNPIVOT (SELECT * FROM c) ON warmup, batch, steps, longest INTO NAME field VALUE v), e AS (SELECT a.lang, a.source, a.batch::INT * a.steps::INT = b.batch::INT * b.steps::INT AS same_effective_batch FROM c a JOIN c b ON a.source = b.source AND b.lang = 'en')
SELECT a.lang, a.source, a.field, a.v AS own, b.v AS sibling, same_effective_batch FROM l a JOIN l b ON a.source = b.source AND a.field = b.field AND b.lang = 'en' JOIN e ON e.lang = a.lang AND e.source = a.source WHERE a.lang <> 'en' AND a.v IS DISTINCT FROM b.v""")
def config_parity(spark, d):
    """Every run's configuration, as its documents give it, against the English sibling of its source: fields that differ, and whether the effective batch is the same."""
    x = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"), F.max(F.length("text")).alias("longest"))
    many = F.col("mean") > 2000
    x = x.select("lang", "source", (F.col("n") % 3).alias("warmup"), F.when(many, 8).otherwise(16).alias("batch"), F.when(many, 2 * (1 + F.col("n") % 2)).otherwise(1 + F.col("n") % 2).alias("steps"), "longest")
    runs = x.withColumn("run", F.concat_ws("/", "lang", "source"))
    diff = C.sibling_differences(runs.where("lang <> 'en'"), runs.where("lang = 'en'"), "source", ["warmup", "batch", "steps", "longest"])
    effective = runs.select("run", "source", (F.col("batch") * F.col("steps")).alias("e"))
    same = effective.join(effective.where("run LIKE 'en/%'").select("source", F.col("e").alias("e2")), "source").select("run", (F.col("e") == F.col("e2")).alias("same_effective_batch"))
    return diff.join(same, "run").select(F.split("run", "/")[0].alias("lang"), "source", "field", "own", "sibling", "same_effective_batch")


@query("CND-10", sql="SELECT s.source, c.c AS missing FROM (SELECT DISTINCT source FROM documents) s, (SELECT unnest([0, 1, 2]) AS c) c WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents d USING (doc_id) WHERE d.source = s.source AND l.quality = c.c)")
def class_coverage(spark, d):
    x = table(spark, d, "documents")
    every = x.select("source").distinct().crossJoin(F.broadcast(D.classes(spark, 3)))  # the classes are a fixed list
    there = D.labelled(spark, d).select(F.col("block_id").alias("source"), F.col("gold").alias("cls")).distinct()
    return every.join(there, ["source", "cls"], "left_anti").select("source", F.col("cls").alias("missing"))


@query("ING-01", sql="""WITH a AS (SELECT doc_id, 'shared_' || doc_id AS item FROM documents WHERE doc_id % 4 = 0), x AS (SELECT d.doc_id, coalesce(a.item, 't2_' || d.source || '_' || substr(sha256(concat_ws('␟', d.source, d.text)), 1, 12)) AS id, a.item IS NULL AS unaligned FROM documents d LEFT JOIN a USING (doc_id))
SELECT doc_id, id || CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN '#' || row_number() OVER (PARTITION BY id ORDER BY doc_id) ELSE '' END AS item_id, unaligned FROM x""")
def native_ingest(spark, d):
    from crossgauge.functions.keys import local_item_id

    x = table(spark, d, "documents")
    a = x.where("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("shared_"), F.col("doc_id").cast("string")).alias("item"))
    y = x.join(a, "doc_id", "left").select("doc_id", F.coalesce("item", local_item_id(2, F.col("source"), F.col("text"))).alias("item_id"), F.col("item").isNull().alias("unaligned"))
    return R.disambiguate(y, "item_id", F.col("doc_id"))
