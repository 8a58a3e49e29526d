"""Validated corpus tables, partitioned logs, report artefacts and audits: the inventory ids that need a table of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.functions.keys import md5_bucket
from crossgauge.operators import relational as R
from crossgauge.plans import derived as D
from crossgauge.plans.registry import query
from crossgauge.session import table
from crossgauge.sources import io as S

P = D.SQL_PREDS
r6 = lambda c, name: F.round(c, 6).alias(name)

# ---- a corpus table: every document as an item of a block, native or translated


def corpus(spark, d):
    """block_id, item_id, lang, origin, text, label_id, flags of every document."""
    x = table(spark, d, "documents")
    return x.select(
        F.col("source").alias("block_id"), F.col("doc_id").cast("string").alias("item_id"), "lang",
        F.when(F.col("doc_id") % 3 == 0, "native").otherwise("mt").alias("origin"), "text",
        md5_bucket(3, F.col("doc_id"), F.lit("label")).cast("int").alias("label_id"),
        F.when(F.trim("text") == "", F.array(F.lit("empty_output"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )


SQL_CORPUS = f"""corpus AS (SELECT source AS block_id, doc_id::VARCHAR AS item_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'native' ELSE 'mt' END AS origin, text,
  {D.b(3, 'doc_id', "'label'")}::INT AS label_id, CASE WHEN trim(text) = '' THEN ['empty_output'] ELSE [] END AS flags FROM documents)"""
SCHEMA = "item_id string, origin string, text string, label_id int, flags array<string>, block_id string, lang string"
RULES = {"item_id": "item_id <> ''", "origin": "origin IN ('native', 'mt')", "text": "text IS NOT NULL", "label_id": "label_id BETWEEN 0 AND 2"}


def stored_corpus(spark, d):
    """The corpus table in the shared folder, validated, partitioned by block and language."""
    path = S.scratch(spark, "corpus")
    S.write_split(corpus(spark, d), path, RULES, "block_id", "lang")
    return path


@query("SRC-01", "SNK-01", sql=f"WITH {SQL_CORPUS} SELECT item_id, origin, label_id FROM corpus WHERE block_id = 'src1' AND lang = 'en'")
def one_split(spark, d):
    """A split written under its rules and read under them: a broken rule stops either."""
    return S.read_split(spark, stored_corpus(spark, d), SCHEMA, RULES, block_id="src1", lang="en").select("item_id", "origin", "label_id")


@query("SRC-02", sql=f"WITH {SQL_CORPUS} SELECT lang, count(*) AS n, sum(len(flags))::BIGINT AS flagged FROM corpus WHERE block_id = 'src1' GROUP BY 1")
def one_block(spark, d):
    """Every language of a block: only the block's folders are listed."""
    x = S.read_split(spark, stored_corpus(spark, d), SCHEMA, RULES, block_id="src1")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.size("flags")).alias("flagged"))


@query("SRC-03", sql=f"WITH {SQL_CORPUS} SELECT item_id, label_id FROM corpus WHERE block_id = 'src2' AND lang = 'de' AND origin = 'native'")
def split_of_origin(spark, d):
    """One origin of a split; an empty result or a label out of range is an error."""
    x = S.read_split(spark, stored_corpus(spark, d), SCHEMA, RULES, block_id="src2", lang="de").where("origin = 'native'")
    return S.not_empty(x, "src2/de/native").select("item_id", "label_id")


NATIVE = {"en": "src1", "de": "src2", "fr": "src3"}


@query("SRC-04", sql=f"""WITH {SQL_CORPUS}, dim(lang, block_id) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in NATIVE.items())})
SELECT lang, block_id, item_id FROM corpus JOIN dim USING (lang, block_id) WHERE origin = 'native'""")
def native_splits(spark, d):
    """Native rows; a language's block comes from the language dimension."""
    dim = spark.createDataFrame(list(NATIVE.items()), "lang string, block_id string")
    x = S.read_split(spark, stored_corpus(spark, d), SCHEMA, RULES).where("origin = 'native'")
    return x.join(F.broadcast(dim), ["lang", "block_id"]).select("lang", "block_id", "item_id")


# ---- partitioned logs


def _log(spark, d, name, frame, *by):
    path = S.scratch(spark, name)
    S.write_partitioned(frame, path, *by)
    return path


@query("SRC-07", sql=f"WITH {P} SELECT item_id, seed, gold, pred_src AS pred FROM preds WHERE lang = 'de'")
def prediction_log(spark, d):
    """A prediction log of all conditions, of which a scan opens one folder."""
    log = D.arm_log(spark, d, "src").withColumns({"task": F.lit(2), "encoder_id": F.lit("base")})
    path = _log(spark, d, "predictions", log, "task", "encoder_id", "condition_id")
    return S.read_corpus(spark, path, task=2, encoder_id="base", condition_id="de_src").select("item_id", "seed", "gold", "pred")


@query("SRC-08", sql=f"WITH {D.SQL_FAILURES} SELECT item_id, seed, label FROM fails WHERE lang = 'fr'")
def failure_set(spark, d):
    path = _log(spark, d, "failures", D.failures(spark, d).select("lang", "item_id", "seed", "label"), "lang")
    return S.read_corpus(spark, path, lang="fr").select("item_id", "seed", "label")


@query("SRC-09", sql=f"WITH {D.SQL_FAILURES} SELECT seed, label, count(*) AS n, round(avg(labse_sim), 6) AS sim FROM fails GROUP BY 1, 2")
def diagnostics_scan(spark, d):
    """The diagnostics of each seed are a file of their own; a scan unions the folder."""
    root = S.scratch(spark, "diagnostics")
    f = D.failures(spark, d).select("seed", "item_id", "label", "labse_sim")
    S.write_partitioned(f, root, "seed")
    x = spark.read.parquet(root)
    return x.groupBy("seed", "label").agg(F.count("*").alias("n"), r6(F.avg("labse_sim"), "sim"))


@query("SNK-03", sql=f"WITH {D.SQL_FAILURES}, l(lang) AS (VALUES ('de'), ('en'), ('es'), ('fr'), ('xx')) SELECT l.lang, count(f.item_id) AS n, 3 AS n_columns FROM l LEFT JOIN fails f USING (lang) GROUP BY 1")
def exported_failures(spark, d):
    """One export a language; a language without failures leaves an empty table with the columns."""
    f, root = D.failures(spark, d).select("lang", "item_id", "seed", "label"), S.scratch(spark, "exports")
    S.write_exports(f, root, "lang", (*D.LANGS, "xx"))
    out = [spark.read.parquet(f"{root}/lang={x}") for x in (*D.LANGS, "xx")]
    return reduce(lambda a, b: a.unionByName(b), [x.agg(F.lit(lang).alias("lang"), F.count("*").alias("n"), F.lit(len(x.columns)).alias("n_columns")) for lang, x in zip((*D.LANGS, "xx"), out, strict=True)])


@query("SNK-06", sql=f"""WITH {P}, old AS (SELECT lang, seed, count(*) AS n FROM preds GROUP BY 1, 2), new AS (SELECT lang, seed, -n AS n FROM old WHERE seed = 1 UNION ALL SELECT 'xx', 0, 5),
m AS (SELECT * FROM new UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new w WHERE w.lang = o.lang AND w.seed = o.seed)) SELECT lang, seed, n, row_number() OVER (ORDER BY lang, seed) AS place FROM m""")
def merged_report(spark, d):
    """Report rows by key, the new ones win, in order of their key."""
    old = D.predictions(spark, d).groupBy("lang", "seed").agg(F.count("*").alias("n"))
    new = old.where("seed = 1").withColumn("n", -F.col("n")).unionByName(spark.createDataFrame([("xx", 0, 5)], "lang string, seed int, n long"))
    return R.upsert(old, new, ["lang", "seed"]).withColumn("place", F.row_number().over(W.orderBy("lang", "seed"))).orderBy("place")  # a report: one row a run


_FOLD = D.b(1 << 32, "item_id", "md5(text)")


@query("SNK-08", sql=f"WITH {SQL_CORPUS} SELECT block_id, lang, count(*) AS rows, list_sort(list(DISTINCT origin)) AS origins, sum((len(flags) > 0)::INT)::BIGINT AS flagged, sum({_FOLD})::BIGINT AS content FROM corpus GROUP BY 1, 2")
def freeze_manifest(spark, d):
    """What a freeze writes down of every split: rows, origins, flagged rows and an order-free hash of ids and texts."""
    x = S.read_corpus(spark, stored_corpus(spark, d), SCHEMA)
    content = F.sum(md5_bucket(1 << 32, F.col("item_id"), F.md5("text"))).alias("content")
    return x.groupBy("block_id", "lang").agg(F.count("*").alias("rows"), F.sort_array(F.collect_set("origin")).alias("origins"), F.count_if(F.size("flags") > 0).alias("flagged"), content)


# ---- report artefacts


def _report(spark, d):
    f = D.failures(spark, d)
    return f.select("item_id", "seed", "label"), f.groupBy("label").agg(F.count("*").alias("n")).orderBy("label")


@query("SNK-11", sql=f"WITH {D.SQL_FAILURES} SELECT 'detail' AS artefact, count(*) AS rows, true AS stamped FROM fails UNION ALL SELECT 'groups', count(DISTINCT label), true FROM fails UNION ALL SELECT 'md', count(DISTINCT label) + 2, true FROM fails")
def report_artefacts(spark, d):
    """Detail, groups and a rendered page, all stamped with one configuration hash and read back."""
    config, root = {"n_boot": 1000, "seed": 7}, S.scratch(spark, "report")
    detail, groups = (S.stamped(x, config) for x in _report(spark, d))
    detail.write.parquet(f"{root}/detail")
    groups.write.parquet(f"{root}/groups")
    S.write_text(spark, S.to_markdown(groups.orderBy("label")), f"{root}/md")
    stamp = S.stamped(spark.range(1), config).first()["config_hash"]
    tables = [spark.read.parquet(f"{root}/{x}").agg(F.lit(x).alias("artefact"), F.count("*").alias("rows"), F.bool_and(F.col("config_hash") == stamp).alias("stamped")) for x in ("detail", "groups")]
    page = spark.read.text(f"{root}/md").agg(F.lit("md").alias("artefact"), F.count("*").alias("rows"), (F.count_if(F.contains("value", F.lit(stamp))) == F.count("*") - 2).alias("stamped"))
    return reduce(lambda a, b: a.unionByName(b), [*tables, page])


@query("REP-01", sql=f"""WITH {D.SQL_FAILURES}, g AS (SELECT label, count(*) AS n FROM fails GROUP BY 1)
SELECT 0 AS line, '| label | n |' AS text UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY label), '| ' || label || ' | ' || n || ' |' FROM g""")
def rendered_page(spark, d):
    lines = S.to_markdown(_report(spark, d)[1]).rstrip("\n").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


@query("REP-03", sql=f"WITH {D.SQL_FAILURES} SELECT 'recomputed' AS against, false AS stale UNION ALL SELECT 'without seed 2', count(*) FILTER (seed = 2) > 0 FROM fails")
def stale_page(spark, d):
    """A rendered page against its table, recomputed and after rows have gone."""
    now = _report(spark, d)[1]
    page = S.to_markdown(now)
    later = D.failures(spark, d).where("seed <> 2").groupBy("label").agg(F.count("*").alias("n")).orderBy("label")
    return spark.createDataFrame([("recomputed", S.stale(now, page)), ("without seed 2", S.stale(later, page))], "against string, stale boolean")


@query("SRC-18", sql=f"""WITH {D.SQL_FAILURES} SELECT 'labels' AS name, count(DISTINCT label) AS rows, true AS one_config FROM fails UNION ALL SELECT 'groups', count(DISTINCT label_group), true FROM fails
UNION ALL SELECT 'langs', count(DISTINCT lang), true FROM fails UNION ALL SELECT 'seeds', count(DISTINCT seed), true FROM fails UNION ALL SELECT 'blocks', count(DISTINCT block_id), true FROM fails""")
def report_bundle(spark, d):
    """Five report tables, written apart, read as one bundle; all must carry one configuration hash."""
    f, root = D.failures(spark, d), S.scratch(spark, "bundle")
    for name, col in (("labels", "label"), ("groups", "label_group"), ("langs", "lang"), ("seeds", "seed"), ("blocks", "block_id")):
        S.stamped(f.groupBy(F.col(col).cast("string").alias("key")).agg(F.count("*").alias("n")), {"n_boot": 1000}).write.parquet(f"{root}/name={name}")
    x = spark.read.parquet(root)
    return x.groupBy("name").agg(F.count("*").alias("rows")).join(x.agg((F.count_distinct("config_hash") == 1).alias("one_config")))


@query("SRC-13", sql=f"""WITH {D.SQL_LABELLED}, a AS (SELECT lang, list_sort(list(DISTINCT gold)) AS labels, count(*) AS n, round(avg(gold), 6) AS tau FROM labelled GROUP BY 1), b AS (SELECT lang, block_id, count(*) AS n FROM labelled GROUP BY ALL)
SELECT a.lang, a.labels, a.tau, b.block_id, b.n AS n_block, a.n FROM a JOIN b USING (lang)""")
def json_source(spark, d):
    """Label sets, thresholds and block sizes, a JSON document for each language, written and read under a schema; broken documents would be counted as such."""
    x, path = D.labelled(spark, d), S.scratch(spark, "config")
    blocks = x.groupBy("lang", "block_id").agg(F.count("*").alias("n")).groupBy("lang").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("block_id", "n")))).alias("blocks"))
    head = x.groupBy("lang").agg(F.sort_array(F.collect_set("gold")).alias("labels"), F.round(F.avg("gold"), 6).alias("tau"), F.count("*").alias("n"))
    head.join(blocks, "lang").write.json(path)
    read = S.read_json(spark, path, "lang string, labels array<int>, tau double, n long, blocks map<string, long>")
    return read.select("lang", "labels", "tau", F.explode("blocks").alias("block_id", "n_block"), "n")


@query("SRC-14", sql="""WITH c AS (SELECT source, count(*) AS n, (avg(n_chars) / 10000)::DECIMAL(9, 4) AS lr, count(*) % 5 = 0 AS odd FROM documents GROUP BY 1)
SELECT source, CASE WHEN n % 2 = 0 THEN 7 ELSE (n % 9)::INT END AS epochs, lr::DOUBLE AS lr, 'base-' || source AS name, false AS frozen, CASE WHEN odd THEN ['beta'] ELSE [] END AS unknown FROM c""")
def run_config(spark, d):
    """A configuration text for each source over typed defaults, with an override for some; unknown keys are told."""
    path = S.scratch(spark, "yaml")
    x = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), (F.avg("n_chars") / 10000).cast("decimal(9,4)").alias("lr"))
    text = F.concat_ws("\n", F.lit("# a run"), F.concat(F.lit("epochs: "), F.col("n") % 9), F.concat(F.lit("lr: '"), "lr", F.lit("'")), F.concat(F.lit("name: base-"), "source", F.lit("  # its name")), F.when(F.col("n") % 5 == 0, "beta: 1"))
    x.select("source", "n", text.alias("text")).write.parquet(path)
    given = F.when(F.col("n") % 2 == 0, F.create_map(F.lit("epochs"), F.lit("7"))).otherwise(F.create_map().cast("map<string,string>"))
    config = S.typed_config(F.col("text"), {"epochs": 3, "lr": 0.1, "name": "x", "frozen": False}, given)
    return spark.read.parquet(path).select("source", config.alias("c")).select("source", "c.*")


# ---- audits


@query("AGG-27", sql="""WITH c AS (SELECT d.lang, d.text, count(*) AS n, count(DISTINCT l.quality) AS labels FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2)
SELECT lang, sum(n)::BIGINT - count(*) AS doubled, count(*) FILTER (labels > 1) AS conflicting, coalesce(list_sort(list(md5(text)) FILTER (labels > 1))[1:5], []) AS examples FROM c GROUP BY 1""")
def conflicting_labels(spark, d):
    """Texts that occur twice, those whose labels differ, and five of them."""
    x = table(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("t")).join(table(spark, d, "labels"), "doc_id")
    c = x.groupBy("lang", "t").agg(F.count("*").alias("n"), F.count_distinct("quality").alias("labels"))
    few = c.where("labels > 1").withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("t"))).where("r <= 5")  # five a language leave each task
    few = few.groupBy("lang").agg(F.array_sort(F.collect_list("t")).alias("examples"))
    counts = c.groupBy("lang").agg((F.sum("n") - F.count("*")).alias("doubled"), F.count_if(F.col("labels") > 1).alias("conflicting"))
    return counts.join(few, "lang", "left").select("lang", "doubled", "conflicting", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


_VOCAB = "v AS (SELECT DISTINCT d.lang, l.quality + 2 * l.toxic AS label FROM documents d JOIN labels l USING (doc_id) WHERE NOT (d.lang = 'es' AND l.quality + 2 * l.toxic = 2) AND NOT (d.lang <> 'de' AND l.quality + 2 * l.toxic = 3))"


@query("AGG-30", sql=f"""WITH {_VOCAB}, s AS (SELECT label, count(*) AS k FROM v GROUP BY 1), t AS (SELECT count(DISTINCT lang) AS langs FROM v)
SELECT lang, list_sort(list(v.label)) AS vocabulary, list_sort(coalesce(list(v.label) FILTER (k = 1), [])) AS only_in, (SELECT list_sort(list(label)) FROM s) AS all_labels,
(SELECT list_sort(coalesce(list(label) FILTER (k = langs), [])) FROM s, t) AS shared, (SELECT bool_and(k = langs) FROM s, t) AS identical FROM v JOIN s USING (label) GROUP BY 1""")
def label_vocabularies(spark, d):
    """Each language's labels, those that only it has, and over all: the union, the shared ones, whether all are the same."""
    code = (F.col("quality") + 2 * F.col("toxic")).alias("label")
    v = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").select("lang", code).distinct()
    v = v.where("NOT (lang = 'es' AND label = 2) AND NOT (lang <> 'de' AND label = 3)")
    own = v.groupBy("lang").agg(F.sort_array(F.collect_set("label")).alias("vocabulary"))
    every = own.agg(F.collect_list("vocabulary").alias("a"))  # one short array a language
    union = F.sort_array(F.array_distinct(F.flatten("a")))
    shared = F.filter(union, lambda x: F.forall("a", lambda y: F.array_contains(y, x)))
    every = every.select("a", union.alias("all_labels"), shared.alias("shared"))
    only = F.filter("vocabulary", lambda x: F.size(F.filter("a", lambda y: F.array_contains(y, x))) == 1)
    return own.join(F.broadcast(every)).select("lang", "vocabulary", only.alias("only_in"), "all_labels", "shared", (F.size("shared") == F.size("all_labels")).alias("identical"))


@query("AGG-31", sql=f"""WITH {D.SQL_SCORES}, r AS (SELECT *, (length(tgt_text) + 1)::DOUBLE / (length(src_text) + 1) AS ratio FROM scores), m AS (SELECT src_lang, tgt_lang, quantile_cont(ratio, 0.5) AS med FROM r GROUP BY 1, 2)
SELECT src_lang, tgt_lang, count(*) AS n, round(any_value(med), 6) AS median_ratio, sum((trim(tgt_text) <> '' AND ratio < 0.5 * med)::INT)::BIGINT AS truncated, sum((trim(tgt_text) = '')::INT)::BIGINT AS empty, sum((src_text = tgt_text)::INT)::BIGINT AS copied,
sum(contains(tgt_text, chr(65533))::INT)::BIGINT AS replaced FROM r JOIN m USING (src_lang, tgt_lang) GROUP BY 1, 2""")
def direction_integrity(spark, d):
    """Counters of damaged rows in every translation direction, against the direction's median length ratio."""
    x = D.measured_pairs(spark, d).where("src_lang IS NOT NULL AND tgt_lang IS NOT NULL")
    of = {"truncated": ~F.col("blank") & (F.col("ratio") < 0.5 * F.col("med")), "empty": F.col("blank"), "copied": F.col("copied"), "replaced": F.col("replaced")}
    return x.groupBy("src_lang", "tgt_lang").agg(F.count("*").alias("n"), r6(F.first("med"), "median_ratio"), *[F.sum(test.cast("long")).alias(name) for name, test in of.items()])


@query("AGG-32", sql=f"""WITH {SQL_CORPUS}, n AS (SELECT * FROM corpus WHERE origin = 'native'), m AS (SELECT DISTINCT lang, text FROM corpus WHERE origin = 'mt')
SELECT n.lang, count(*) AS rows, list_sort(coalesce(list(item_id) FILTER (m.text IS NOT NULL), [])) AS leaked, list_sort(coalesce(list(item_id) FILTER (contains(n.text, chr(65533))), [])) AS corrupt,
count(*) FILTER (nfc_normalize(n.text) <> n.text) AS not_nfc FROM n LEFT JOIN m ON m.lang = n.lang AND m.text = n.text GROUP BY 1""")
def native_checks(spark, d):
    """Ids of native rows whose text also stands among the translations and of corrupt ones, and how many rows aren't in normal form C."""
    from crossgauge.functions.text import is_nfc

    c = corpus(spark, d).withColumn("k", F.sha2("text", 256))
    m = c.where("origin = 'mt'").select("lang", "k").distinct().withColumn("there", F.lit(True))
    n = c.where("origin = 'native'").join(m, ["lang", "k"], "left")
    listed = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("item_id"))))
    tests = n.select("lang", "item_id", "there", F.contains("text", F.lit("�")).alias("corrupt"), is_nfc("text").alias("nfc"))
    return tests.groupBy("lang").agg(F.count("*").alias("rows"), listed(F.col("there")).alias("leaked"), listed(F.col("corrupt")).alias("corrupt"), F.count_if(~F.col("nfc")).alias("not_nfc"))


@query("AGG-45", sql=f"WITH {D.SQL_SCORES}, x AS (SELECT src_lang, tgt_lang, any_value(length(src_lang || tgt_lang) * 7) AS seconds, count(*) AS n FROM scores GROUP BY 1, 2) SELECT sum(seconds)::BIGINT AS seconds, sum(n)::BIGINT AS n, count(*) AS directions FROM x")
def smoke_summary(spark, d):
    """A value that each direction repeats on its rows counts once a direction."""
    x = D.scores(spark, d).withColumn("seconds", F.length(F.concat("src_lang", "tgt_lang")) * 7)
    x = x.groupBy("src_lang", "tgt_lang").agg(F.first("seconds").alias("seconds"), F.count("*").alias("n"))
    return x.agg(F.sum("seconds").alias("seconds"), F.sum("n").alias("n"), F.count("*").alias("directions"))


@query("AGG-55", sql=f"""WITH {SQL_CORPUS}, c AS (SELECT lang, label_id, count(*) AS n FROM corpus GROUP BY 1, 2)
SELECT lang, sum(n)::BIGINT AS rows, '{{' || string_agg('"' || label_id || '":' || n, ',' ORDER BY label_id) || '}}' AS labels FROM c GROUP BY 1""")
def audit_summary(spark, d):
    """One flat row a language; its label counts are a map, written as JSON."""
    c = corpus(spark, d).groupBy("lang", F.col("label_id").cast("string").alias("l")).agg(F.count("*").alias("n"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "n"))))
    return c.groupBy("lang").agg(F.sum("n").alias("rows"), F.to_json(counts).alias("labels"))


@query("AGG-41", sql=f"""WITH {D.SQL_SCORES}, vocab AS (SELECT unnest(words) AS w FROM (SELECT list_distinct(flatten(list(string_split(lower(text), ' ')))) AS words FROM benchmark)),
w AS (SELECT src_lang, unnest(list_filter(regexp_split_to_array(lower(src_text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')) AS w FROM scores),
s AS (SELECT src_lang, count(*) AS docs FROM scores GROUP BY 1), t AS (SELECT src_lang, count(*) AS n, count(*) FILTER (w NOT IN (SELECT w FROM vocab)) AS unk FROM w GROUP BY 1)
SELECT src_lang, docs, round(coalesce(n, 0)::DOUBLE / docs, 6) AS tokens, round(1000.0 * coalesce(unk, 0) / greatest(1, coalesce(n, 0)), 6) AS unk_per_1k FROM s LEFT JOIN t USING (src_lang)""")
def token_statistics(spark, d):
    """Tokens a text and unknown tokens per thousand, against the vocabulary of the test items."""
    vocab = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct().withColumn("known", F.lit(True))
    x = D.scores(spark, d)
    words = F.filter(F.split(F.lower("src_text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = x.select("src_lang", F.explode(words).alias("w")).groupBy("src_lang", "w").agg(F.count("*").alias("n"))  # before the join: one row a word
    t = n.join(vocab, "w", "left").groupBy("src_lang").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("unk"))
    s = x.groupBy("src_lang").agg(F.count("*").alias("docs")).join(t, "src_lang", "left").fillna(0, ["n", "unk"])
    return s.select("src_lang", "docs", r6(F.col("n") / F.col("docs"), "tokens"), r6(1000.0 * F.col("unk") / F.greatest(F.lit(1), "n"), "unk_per_1k"))
