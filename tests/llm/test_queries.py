"""The registered queries themselves on the smallest tables, models against direct formulas, and the pipeline on messy input."""

import glob
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgauge.llm import language_id, quality_classifier
from crossgauge.llm.registry import ORACLE_SQL, QUERIES
from tests.conftest import SF
from tests.llm.test_operators import WORDS, prose
from tests.test_oracle import rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name, columns", [
    ("op2_quality_classifier", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    ("op6_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
])
def test_scored_queries(spark, name, columns):
    out = QUERIES[name](spark, SF)
    assert {f.name: f.dataType.simpleString() for f in out.schema} == columns
    got, texts = out.collect(), documents(spark)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if name.startswith("op2"):
            assert r["predicted"] == int(r["score"] >= 0.3)


def test_shards_of_the_query(spark):
    got, texts = QUERIES["op8_histogram_shard"](spark, SF).collect(), documents(spark)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(size) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(size.values()) / 40, max(r["size"] for r in got)
    assert max(abs(size[k] - mean) for k in range(40)) <= 0.004 * mean + largest


def test_pieces_of_the_query(spark):
    got = QUERIES["op5_best_fit_packing"](spark, SF).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for pieces in by_doc.values():
        pieces.sort()
        assert [p for p, *_ in pieces] == list(range(len(pieces)))
        assert [s for _, s, _ in pieces] == np.cumsum([0] + [n for *_, n in pieces])[:-1].tolist()
        assert all(n == 2048 for *_, n in pieces[1:])
    assert len(by_sequence) >= -(-sum(r["length"] for r in got) // 2048)


def test_packing_needs_as_few_sequences_as_possible():
    """Against an exhaustive search over all ways to pack a few items."""
    from functools import lru_cache

    from crossgauge.llm.packing import plan

    @lru_cache(maxsize=None)
    def fewest(items, bins):
        if not items:
            return len(bins)
        best = fewest(items[1:], tuple(sorted((*bins, 12 - items[0]))))
        for k, gap in enumerate(bins):
            if gap >= items[0] and gap not in bins[:k]:
                best = min(best, fewest(items[1:], tuple(sorted((*bins[:k], gap - items[0], *bins[k + 1 :])))))
        return best

    rng = np.random.default_rng(2)
    worse = 0
    for _ in range(60):
        items = sorted(rng.integers(1, 13, int(rng.integers(1, 9))).tolist(), reverse=True)
        made = {first + j for _, _, n, first, _ in plan(Counter(items), 12) for j in range(n)}
        assert len(made) >= fewest(tuple(items), ())
        worse += len(made) - fewest(tuple(items), ())
    assert worse <= 3  # a greedy plan: seldom one sequence more


def test_kernel_ridge_equals_the_direct_solution():
    """With every training text a landmark the model is kernel ridge regression; n-gram sets and the solution by plain Python."""
    texts = [prose(i, 12).encode() for i in range(6)] + [" ".join(w[::-1] for w in prose(i, 12).split()).encode() for i in range(6, 12)]
    labels = ["a"] * 6 + ["b"] * 6
    kernel = language_id.Kernel(texts, labels, landmarks=6, ridge=1e-2)

    def grams(t):
        t = t.lower()
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    def k(x, y):
        return len(grams(x) & grams(y)) / (len(grams(x)) * len(grams(y))) ** 0.5

    new = [prose(40, 9).encode(), " ".join(w[::-1] for w in prose(41, 9).split()).encode()]
    off = np.cumsum([0] + [len(t) for t in new])
    got = kernel.kernel(np.frombuffer(b"".join(new), np.uint8), off)
    want = np.array([[k(x, y) for y in texts] for x in new])
    sets = [len(grams(x)) for x in new]
    assert np.abs(got - want).max() < 0.02 and sets  # n-grams outside the landmarks are counted by hash slots
    gram = np.array([[k(x, y) for y in texts] for x in texts])
    value, vector = np.linalg.eigh(gram)
    keep = value > 1e-6 * value.max()
    phi = gram @ (vector[:, keep] / np.sqrt(value[keep]))
    y = np.array([[1.0 if x == lang else -1.0 for lang in "ab"] for x in labels])
    direct = want @ (vector[:, keep] / np.sqrt(value[keep])) @ np.linalg.solve(phi.T @ phi + 1e-2 * len(texts) * np.eye(int(keep.sum())), phi.T @ y)
    scores = kernel.scores(np.frombuffer(b"".join(new), np.uint8), off)
    assert np.abs(scores - direct).max() < 0.05 and scores.argmax(1).tolist() == direct.argmax(1).tolist() == [0, 1]


def test_sampled_languages_share_the_sample_evenly(spark):
    many = [(i, prose(i, 5), "en") for i in range(400)] + [(1000 + i, prose(2000 + i, 5), "de") for i in range(30)]
    many += [(3, prose(3, 5), "en")] * 50 + [(None, "no id", "en"), (9999, None, "en"), (9998, "", "fr"), (9997, "x" * 99, None)]
    got = language_id.training_sample(spark.createDataFrame(many, "doc_id long, text string, lang string").withColumn("k", F.lit(1)), sample=40)
    texts = {t: (i, lang) for i, t, lang in many}
    n = Counter(lang for _, lang in got)
    assert n["en"] == 20 and 15 <= n["de"] <= 20 and set(n) == {"en", "de"}
    assert len(set(got)) == len(got) and all(zlib.crc32(str(texts[t][0]).encode()) % 5 for t, _ in got)


def test_labelled_sample_rules(spark):
    docs = [(i, f"text {i}") for i in range(60)] + [(1, "text 1")] * 20 + [(2, "another"), (None, "no id"), (61, None), (62, "x" * 100)]
    labels = [(i, i % 2) for i in range(60)] + [(4, 1), (5, 0), (None, 1), (61, 1), (62, 1), (63, 1), (6, None), (7, 5)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string").withColumn("label", F.lit(9)), spark.createDataFrame(labels, "doc_id long, quality int")
    got = dict(quality_classifier.labelled_sample(d, y, longest=50))
    trained = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    assert got == {(b"another" if i == 2 else f"text {i}".encode()): 1 if i in (4, 5) else i % 2 for i in trained}
    assert len(quality_classifier.labelled_sample(d, y, sample=7)) == 7
    assert quality_classifier.labelled_sample(d.limit(0), y) == [] == quality_classifier.labelled_sample(d, y.limit(0))


def test_classifier_equals_its_formula(spark):
    """A document's score is the softmax of the mean of its features' shares; features counted by plain Python."""
    rng = np.random.default_rng(1)
    table, bias = rng.normal(size=1 << quality_classifier.BITS), 0.3
    texts = ["", None, "a", "one two two three", "  tab\tand\nline  ", "é" * 40, prose(1, 30), "two two two"]
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table, bias).collect()}
    for i, t in enumerate(texts):
        ids, share = quality_classifier._bag((t or "").encode())
        z = float(table[ids].astype(np.float32) @ share) + bias
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-5, t
    words = "one two two three".split()
    data = np.frombuffer(b"one two two three", np.uint8)
    found = [b for _, b in quality_classifier.features(data, np.array([0, len(data)]))]
    windows = sum(1 for n in (2, 3, 4) for k in range(len(data) - n + 1) if b" " not in bytes(data[k + 1 : k + n - 1]) and not (n == 2 and bytes(data[k : k + 2]) == b"  "))
    assert len(found[0]) == len(words) and len(found[1]) == 1 and sum(map(len, found[2:])) == windows


def test_pipeline_on_messy_input(spark):
    """Nulls, ties, repeated rows, empty texts, clashing columns; then an empty table."""
    import corpus_pipeline

    clean = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [(None, prose(1, 40), "en", "s", 1), (7000, None, "en", None, None), (7001, "", "en", "s", 0), (7002, " \n", None, "s", 2), (7003, "12 34", "de", "s", 5)]
    docs = clean.unionByName(spark.createDataFrame(odd, clean.schema)).unionByName(clean.limit(10))
    docs = docs.withColumns({"_key": F.lit(1), "key": F.lit("k"), "shard": F.lit(2), "_spans": F.lit(3), "score": F.lit(0.5)})
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/messy-{name}"
        after.write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
        left = now.collect()
        assert len(left) > 20 and all(r["_key"] == 1 and r["key"] == "k" for r in left), name
        assert not {7000, 7001, 7002, 7003} & {r["doc_id"] for r in left}
    assert len({(r["doc_id"], r["text"]) for r in left}) == len(left)  # repeated rows went with the near duplicates
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == len({r["doc_id"] for r in left})
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0


def test_very_long_text(spark):
    """One text of 12 MB among short ones, through the operators that read whole texts."""
    from crossgauge.llm import decontaminate, line_quality, ngram_jaccard, suffix_dedup, token_files

    rng = np.random.default_rng(4)
    long_ = " ".join(f"{w}{n}" for w, n in zip(rng.choice(WORDS, 1_200_000), rng.integers(0, 10**4, 1_200_000), strict=True)) + "."
    item = prose(60, 30)
    rows_ = [(1, long_ + " " + item), (2, long_ + " " + item + " end"), (3, prose(3)), (4, prose(3))]
    docs = spark.createDataFrame(rows_, "doc_id long, text string").withColumn("lang", F.lit("en"))
    same = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(docs).collect()}
    assert same == {1: 1, 2: 1, 3: 3, 4: 3}
    gone = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in suffix_dedup.dedup_spans(docs).collect()}
    assert gone == {1: 0, 2: 4, 3: 0, 4: 0}
    hits = decontaminate.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in hits) == [(1, 9), (2, 9)]
    ids = token_files.read_token_files(token_files.write_token_files(docs)).collect()
    assert sorted(r["doc_id"] for r in ids) == [1, 2, 3, 4]
    judged = {r["doc_id"]: r["n_words"] for r in line_quality.line_first_clean(docs.where("doc_id <> 2")).collect()}
    assert judged == {1: 1_200_030, 3: 80, 4: 80}


def test_very_long_text_in_scoring_packing_and_sharding(spark):
    """One text of 6 MB through the operators that score, scan, pack and shard; its result is that of its rule."""
    from crossgauge.llm import histogram_shard, license_scan, online_packing, packing, token_alignment

    rng = np.random.default_rng(5)
    long_ = " ".join(f"{w}{n}" for w, n in zip(rng.choice(WORDS, 600_000), rng.integers(0, 10**4, 600_000), strict=True))
    notice = license_scan.NOTICES[0][2]
    rows_ = [(1, long_ + "\n" + notice + "\n", "en"), (2, prose(3), "en"), (3, " ".join(w[::-1] for w in prose(4).split()), "de"), (4, None, None)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    table, bias = quality_classifier.train([prose(i, 20).encode() for i in range(4)] + [b"zz " * 20] * 4, [1] * 4 + [0] * 4)
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, table, bias).collect()}
    assert len(scores) == 4 and scores[1] > max(scores[3], scores[4])
    kernel = language_id.Kernel([prose(i, 12).encode() for i in range(6)] + [" ".join(w[::-1] for w in prose(i, 12).split()).encode() for i in range(6)], ["en"] * 6 + ["de"] * 6, landmarks=4, ridge=1e-2)
    langs = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, kernel).collect()}
    assert langs == {1: "en", 2: "en", 3: "de", 4: "und"}
    hits = license_scan.license_scan(docs, license_scan.known_digests(spark)).collect()
    assert {(r["doc_id"], r["license_id"], r["scope"]) for r in hits} >= {(1, license_scan.NOTICES[0][0], "line")}
    for found, most in ((packing.pack_documents(docs), 2048), (online_packing.online_pack(docs), 4096)):
        found = found.collect()
        assert max(r["length"] for r in found) == most and {r["doc_id"] for r in found} == {1, 2, 3, 4}
    assert sum(r["length"] for r in found if r["doc_id"] == 1) == next(r["doc_tokens"] for r in found if r["doc_id"] == 1)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    shards = histogram_shard.histogram_shard(docs, F.xxhash64("text"), F.col("doc_id"), size, shards=3).collect()
    assert len(shards) == 4 and len({r["shard"] for r in shards if r["doc_id"] != 1} & {r["shard"] for r in shards if r["doc_id"] == 1}) <= 1
    links = {r["doc_id"]: r["n_groups"] for r in token_alignment.link_statistics(docs).collect()}
    assert links[1] > 600_000 and links[4] == 0
