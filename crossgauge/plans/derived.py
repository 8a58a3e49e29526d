"""Stand-ins for the domain's tables, derived from the test tables in the same way in Spark and in SQL.

A prediction log: three seeds per labelled document; a hash of (seed, document, arm) decides whether a prediction is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgauge.functions.keys import md5_bucket
from crossgauge.operators.quantiles import quantiles
from crossgauge.session import table
from crossgauge.sources.io import scratch

LANGS = ("de", "en", "es", "fr")
FAMILY = {"en": "A", "de": "A", "fr": "B", "es": "B"}
NATIVE_BLOCK = {"en": "E", "de": "D", "fr": "F"}
ENCODERS = ("base", "large")
SEEDS = (0, 1, 2)
WRONG_SRC, WRONG_TGT = 10, 35
#: Precedence of the modules, their labels, and the labels' groups.
PRECEDENCE = (
    ("gate", "translation_drift"),
    ("frag", "tokenizer_fragmentation"),
    ("morph", "morphological_masking"),
    ("saliency", "terminology_gap"),
    ("provenance", "provenance_specific"),
    ("xling", "cross_lingual_hard"),
    ("collapse", "class_collapse"),
    ("seed", "seed_unstable"),
)
UNATTRIBUTED = "unattributed"
LABEL_GROUP = {
    "translation_drift": "linguistic",
    "tokenizer_fragmentation": "linguistic",
    "morphological_masking": "linguistic",
    "terminology_gap": "linguistic",
    "provenance_specific": "data",
    "cross_lingual_hard": "data",
    "class_collapse": "model",
    "seed_unstable": "model",
    "unattributed": "unattributed",
}
#: How often, in percent, a module fires in the derived diagnostics.
FIRES = {"gate": 10, "frag": 15, "morph": 20, "saliency": 15, "provenance": 10, "xling": 10, "collapse": 5, "seed": 15}


def lang_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, FAMILY[x], NATIVE_BLOCK.get(x)) for x in LANGS], "lang string, family string, native_block string")


#: A language is native in a block of its own when it has this share of the documents.
NATIVE_SHARE = 0.11


def found_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language dimension that the documents show: lang, family, native_block (null for a rare language)."""
    n = table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    block = F.when(F.col("n") >= NATIVE_SHARE * F.col("total"), F.upper(F.substring("lang", 1, 1)))
    return n.crossJoin(F.broadcast(total)).select("lang", F.when(F.col("lang").isin("de", "en"), "A").otherwise("B").alias("family"), block.alias("native_block"))  # one row of total


def good_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, seed of the runs whose log reaches an accuracy of 0.65: the checkpoints that are there."""
    p = predictions(spark, sf_dir).groupBy("lang", "seed").agg(F.avg((F.col("pred_tgt") == F.col("gold")).cast("double")).alias("a"))
    return p.where("a >= 0.65").select("lang", "seed")


def label_dim(spark: SparkSession) -> DataFrame:
    rows = [(i, label, LABEL_GROUP[label]) for i, label in enumerate([x for _, x in PRECEDENCE] + [UNATTRIBUTED])]
    return spark.createDataFrame(rows, "ord int, label string, label_group string")


def classes(spark: SparkSession, k: int = 3) -> DataFrame:
    return spark.range(k).select(F.col("id").cast("int").alias("cls"))


def seeded(df: DataFrame, seeds=SEEDS) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang", F.col("source").alias("block_id"))
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").cast("int").alias("gold"), F.col("toxic").cast("int").alias("toxic"))
    return gold.join(docs, "item_id")


def flip(col: str, arm: str, wrong: int, *extra: str) -> Column:
    return F.when(md5_bucket(100, F.col("seed"), F.col("item_id"), F.lit(arm), *[F.col(e) for e in extra]) < wrong, 1 - F.col(col)).otherwise(F.col(col))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, lang, block_id, gold, toxic, seed, pred_src, pred_tgt."""
    return seeded(labelled(spark, sf_dir)).withColumns({"pred_src": flip("gold", "src", WRONG_SRC), "pred_tgt": flip("gold", "tgt", WRONG_TGT)})


def arm_log(spark: SparkSession, sf_dir: str, arm: str) -> DataFrame:
    """One arm as a log of its own: condition_id, item_id, lang, block_id, seed, gold, pred."""
    p = predictions(spark, sf_dir)
    return p.select(F.concat("lang", F.lit(f"_{arm}")).alias("condition_id"), "item_id", "lang", "block_id", "seed", "gold", F.col(f"pred_{arm}").alias("pred"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed (item, seed) rows with the modules that fired and the label that takes precedence."""
    p = predictions(spark, sf_dir).where("pred_src = gold AND pred_tgt <> gold")
    fired = [F.when(md5_bucket(100, F.col("seed"), F.col("item_id"), F.lit(m)) < FIRES[m], m) for m, _ in PRECEDENCE]
    p = p.withColumn("modules_fired", F.array_compact(F.array(*fired)))
    p = p.withColumn("labse_sim", md5_bucket(100, F.col("item_id"), F.lit("sim")) / 100.0)
    return p.withColumn("label", precedence_pick(F.col("modules_fired"))).withColumn("label_group", label_group(F.col("label")))


def precedence_pick(fired: Column) -> Column:
    """The label of the first module in the order of precedence that fired."""
    return F.coalesce(*[F.when(F.array_contains(fired, m), label) for m, label in PRECEDENCE], F.lit(UNATTRIBUTED))


def label_group(label: Column) -> Column:
    pairs = [x for k, v in LABEL_GROUP.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), label)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for pair similarities: each document with the next one, as a translation direction."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("src_lang"), F.col("source").alias("block_id"), F.col("text").alias("src_text"))
    n = table(spark, sf_dir, "documents").select((F.col("doc_id") - 1).alias("item_id"), F.col("lang").alias("tgt_lang"), F.col("text").alias("tgt_text"))
    return d.join(n, "item_id").withColumn("labse_sim", md5_bucket(1000, F.col("item_id"), F.lit("sim")) / 1000.0)


def measured_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_lang, tgt_lang, ratio, blank, copied, replaced of the rows of `scores`, with their direction's median ratio as med.

    Texts are measured where they are read, so no task gets a direction's texts; the directions are few and broadcast.
    """
    x = table(spark, sf_dir, "documents")
    facts = F.length("text").alias("n"), F.sha2("text", 256).alias("h"), (F.trim("text") == "").alias("blank"), F.contains("text", F.lit(REPLACED)).alias("replaced")
    s = x.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("src_lang"), *facts[:2])
    t = x.select((F.col("doc_id") - 1).alias("item_id"), F.col("lang").alias("tgt_lang"), *facts)
    ratio, copied = ((t["n"] + 1) / (s["n"] + 1)).alias("ratio"), ((s["n"] == t["n"]) & (s["h"] == t["h"])).alias("copied")
    path = scratch(spark, "pairs")
    s.join(t, "item_id").select("src_lang", "tgt_lang", ratio, "blank", copied, "replaced").write.parquet(path)
    rows = spark.read.parquet(path)
    med = quantiles(rows, ["src_lang", "tgt_lang"], "ratio", [0.5]).select(F.col("src_lang").alias("_s"), F.col("tgt_lang").alias("_t"), F.col("q")[0].alias("med"))
    return rows.join(F.broadcast(med), rows["src_lang"].eqNullSafe(med["_s"]) & rows["tgt_lang"].eqNullSafe(med["_t"]), "left").drop("_s", "_t")


#: The stand-in languages of `translated`: a numbering system's zero, a scale word, its English name and multiplier, a currency token.
SCALED = (("hin", 0x0966, "लाख", "lakh", 100_000, "रुपये"), ("ben", 0x09E6, "হাজার", "thousand", 1_000, "টাকা"), ("tel", 0x0C66, "కోటి", "crore", 10_000_000, "€"), ("mal", 0x0D66, "ദശലക്ഷം", "million", 1_000_000, "pound"))


def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for a translated table: doc_id, lang, number, l, r.

    l is a document's whole text with an amount in a script's digits, a scale word, a currency and a percentage behind
    it; r is what one of eight ways to translate or spoil that leaves. number: the amount as annotated.
    """
    x = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") * 37 + 12).alias("amount"), md5_bucket(8, F.col("doc_id"), F.lit("tr")).alias("k"), md5_bucket(4, F.col("doc_id"), F.lit("ln")).cast("int").alias("s"))
    of = lambda i: F.element_at(F.array(*[F.lit(v[i]) for v in SCALED]), F.col("s") + 1)
    grouped = F.format_number("amount", 0)
    native = F.coalesce(*[F.when(F.col("s") == j, F.translate(grouped, "0123456789", "".join(chr(v[1] + d) for d in range(10)))) for j, v in enumerate(SCALED)])
    x = x.select("doc_id", of(0).alias("lang"), "text", "k", F.col("amount").cast("string").alias("plain"), grouped.alias("grouped"), native.alias("native"), of(2).alias("scale"), of(3).alias("english"), (F.col("amount") * of(4)).cast("string").alias("whole"), of(5).alias("money"))
    number = F.when(F.col("k") == 5, "abc").when(F.col("k") == 6, F.concat("plain", F.lit("."))).when(F.col("k") == 7, F.concat("plain", F.lit(".5,"))).otherwise(F.col("native"))
    ways = (("grouped", "scale", "money", "50%"), ("native", "scale", "money", "50%"), ("grouped", "english", "money"), ("grouped", "<ID 3>"), ("whole", "money", "50%"), ("xx u09bc yy",), ("grouped", "grouped", "scale"), ("plain", REPLACED))
    r = F.coalesce(*[F.when(F.col("k") == j, F.concat_ws(" ", "text", *[F.col(c) if c in x.columns else F.lit(c) for c in way])) for j, way in enumerate(ways)])
    return x.select("doc_id", "lang", number.alias("number"), F.concat_ws(" ", "text", "native", "scale", "money", F.lit("50%")).alias("l"), r.alias("r"))


REPLACED = "\ufffd"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encoder, source, target, seed, gap: source accuracy less target accuracy for every ordered pair of languages."""
    p = seeded(labelled(spark, sf_dir)).withColumn("encoder", F.explode(F.array(*map(F.lit, ENCODERS))))
    p = p.withColumns({"src": flip("gold", "src", WRONG_SRC, "encoder"), "tgt": flip("gold", "tgt", WRONG_TGT, "encoder")})
    acc = p.groupBy("encoder", "seed", "lang").agg(F.avg((F.col("src") == F.col("gold")).cast("double")).alias("a_src"), F.avg((F.col("tgt") == F.col("gold")).cast("double")).alias("a_tgt"))
    s = acc.select("encoder", "seed", F.col("lang").alias("source"), F.col("a_src").alias("source_acc"))
    t = acc.select("encoder", "seed", F.col("lang").alias("target"), F.col("a_tgt").alias("target_acc"))
    return s.join(t, ["encoder", "seed"]).where("source <> target").withColumn("gap", F.col("source_acc") - F.col("target_acc"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells over the seeds: encoder, source, target, gap_mean, gap_std."""
    c = cells(spark, sf_dir).groupBy("encoder", "source", "target")
    return c.agg(F.avg("gap").alias("gap_mean"), F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("gap_std"))


# ---- the same in SQL


def b(modulus: int, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT % {modulus})"


def _flip(arm: str, wrong: int, *extra: str) -> str:
    return f"CASE WHEN {b(100, 'seed', 'item_id', repr(arm), *extra)} < {wrong} THEN 1 - gold ELSE gold END"


SQL_LABELLED = """labelled AS (SELECT l.doc_id AS item_id, d.lang, d.source AS block_id, l.quality::INT AS gold, l.toxic::INT AS toxic
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
SQL_PREDS = f"""{SQL_LABELLED}, seeds AS (SELECT unnest([0, 1, 2])::INT AS seed),
preds AS (SELECT item_id, lang, block_id, gold, toxic, seed, {_flip('src', WRONG_SRC)} AS pred_src, {_flip('tgt', WRONG_TGT)} AS pred_tgt FROM labelled, seeds)"""
_fired = ", ".join(f"CASE WHEN {b(100, 'seed', 'item_id', repr(m))} < {n} THEN '{m}' END" for m, n in FIRES.items())
_pick = " ".join(f"WHEN list_contains(modules_fired, '{m}') THEN '{x}'" for m, x in PRECEDENCE)
_group = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_GROUP.items())
SQL_FAILURES = f"""{SQL_PREDS}, fired AS (SELECT *, list_filter([{_fired}], lambda x: x IS NOT NULL) AS modules_fired, {b(100, 'item_id', "'sim'")} / 100.0 AS labse_sim
  FROM preds WHERE pred_src = gold AND pred_tgt <> gold),
picked AS (SELECT *, CASE {_pick} ELSE '{UNATTRIBUTED}' END AS label FROM fired),
fails AS (SELECT *, CASE label {_group} END AS label_group FROM picked)"""
SQL_SCORES = f"""scores AS (SELECT d.doc_id AS item_id, d.lang AS src_lang, d.source AS block_id, d.text AS src_text, n.lang AS tgt_lang, n.text AS tgt_text,
  {b(1000, 'd.doc_id', "'sim'")} / 1000.0 AS labse_sim FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1)"""
_list = lambda i: "[" + ", ".join(repr(v[i]) if isinstance(v[i], str) else str(v[i]) for v in SCALED) + "][s + 1]"
_native = " ".join(f"WHEN {j} THEN translate(grouped, '0123456789', '{''.join(chr(v[1] + d) for d in range(10))}')" for j, v in enumerate(SCALED))
SQL_TRANSLATED = f"""amounts AS (SELECT doc_id, coalesce(text, '') AS text, doc_id * 37 + 12 AS amount, {b(8, 'doc_id', "'tr'")} AS k, {b(4, 'doc_id', "'ln'")} AS s FROM documents),
parts AS (SELECT *, format('{{:,}}', amount) AS grouped, amount::VARCHAR AS plain, {_list(2)} AS scale, {_list(3)} AS english, (amount * {_list(4)})::VARCHAR AS whole, {_list(5)} AS money FROM amounts),
natives AS (SELECT *, CASE s {_native} END AS native FROM parts),
translated AS (SELECT doc_id, {_list(0)} AS lang, CASE k WHEN 5 THEN 'abc' WHEN 6 THEN plain || '.' WHEN 7 THEN plain || '.5,' ELSE native END AS number,
  concat_ws(' ', text, native, scale, money, '50%') AS l, CASE k WHEN 0 THEN concat_ws(' ', text, grouped, scale, money, '50%') WHEN 1 THEN concat_ws(' ', text, native, scale, money, '50%') WHEN 2 THEN concat_ws(' ', text, grouped, english, money)
  WHEN 3 THEN concat_ws(' ', text, grouped, '<ID 3>') WHEN 4 THEN concat_ws(' ', text, whole, money, '50%') WHEN 5 THEN concat_ws(' ', text, 'xx u09bc yy') WHEN 6 THEN concat_ws(' ', text, grouped, grouped, scale) ELSE concat_ws(' ', text, plain, '{REPLACED}') END AS r FROM natives)"""
SQL_CELLS = f"""{SQL_LABELLED}, seeds AS (SELECT unnest([0, 1, 2])::INT AS seed), encoders AS (SELECT unnest(['base', 'large']) AS encoder),
enc AS (SELECT *, {_flip('src', WRONG_SRC, 'encoder')} AS src, {_flip('tgt', WRONG_TGT, 'encoder')} AS tgt FROM labelled, seeds, encoders),
acc AS (SELECT encoder, seed, lang, avg((src = gold)::INT::DOUBLE) AS a_src, avg((tgt = gold)::INT::DOUBLE) AS a_tgt FROM enc GROUP BY ALL),
cells AS (SELECT s.encoder, s.seed, s.lang AS source, t.lang AS target, s.a_src AS source_acc, t.a_tgt AS target_acc, s.a_src - t.a_tgt AS gap
  FROM acc s JOIN acc t ON s.encoder = t.encoder AND s.seed = t.seed AND s.lang <> t.lang),
gaps AS (SELECT encoder, source, target, avg(gap) AS gap_mean, coalesce(stddev_samp(gap), 0.0) AS gap_std FROM cells GROUP BY ALL)"""
SQL_LANG = "lang_dim(lang, family, native_block) AS (VALUES ('de', 'A', 'D'), ('en', 'A', 'E'), ('es', 'B', NULL), ('fr', 'B', 'F'))"
SQL_FOUND_LANGS = f"""lang_dim AS (SELECT lang, CASE WHEN lang IN ('de', 'en') THEN 'A' ELSE 'B' END AS family, CASE WHEN count(*) >= {NATIVE_SHARE} * (SELECT count(*) FROM documents WHERE lang IS NOT NULL) THEN upper(substr(lang, 1, 1)) END AS native_block
  FROM documents WHERE lang IS NOT NULL GROUP BY 1)"""
SQL_GOOD_RUNS = "good_runs AS (SELECT lang, seed FROM preds GROUP BY 1, 2 HAVING avg((pred_tgt = gold)::INT::DOUBLE) >= 0.65)"
SQL_LABEL_DIM = "label_dim(ord, label, label_group) AS (VALUES " + ", ".join(f"({i}, '{x}', '{LABEL_GROUP[x]}')" for i, x in enumerate([x for _, x in PRECEDENCE] + [UNATTRIBUTED])) + ")"
