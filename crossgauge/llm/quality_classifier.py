"""Supervised text quality: hashed word and character n-gram vectors, averaged per document, softmax output, trained by SGD in numpy.

Features of a text are its words, its pairs of one word twice (one bucket for all of them), and all its 2- to 4-byte windows without inner white space, each hashed to one of
2**BITS vectors. After training, a bucket's share of the logit is one number (its vector times the output weights),
so a document's score is the softmax of the mean over its features: one table lookup per feature.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgauge.llm.common import _SPACE, chunks, documents, held_out, prefix_hash, span_hash, string_bytes, word_spans

BITS = 18
DIM = 12
WINDOWS = (2, 3, 4)
#: Bucket of the word pair "the same word again", whatever the word.
AGAIN = 0
EPOCHS = 5
RATE = 0.5
#: Bounds of the fitted sample: labelled texts and their longest size in bytes.
SAMPLE = 4000
LONGEST = 1 << 16
THRESHOLD = 0.3


def features(data: np.ndarray, off: np.ndarray):
    """(document, bucket) arrays, one pair for each kind of feature; sorted by document within a kind."""
    shift = np.uint64(64 - BITS)
    if not len(data):
        return
    doc_of = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    space = _SPACE[data]
    plain = np.where(space, np.uint8(32), data)
    sums = prefix_hash(plain)
    doc, start, end = word_spans(data, off)
    word = span_hash(sums, start, end)
    yield doc, (word >> shift).astype(np.int64)
    if len(word) > 1:
        again = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        yield doc[1:][again], np.full(int(again.sum()), AGAIN)
    for n in WINDOWS:
        if len(data) < n:
            return
        m = len(data) - n + 1
        ok = doc_of[:m] == doc_of[n - 1 :]
        for k in range(1, n - 1):
            ok &= ~space[k : k + m]
        if n == 2:
            ok &= ~(space[:m] & space[1:])
        start = np.flatnonzero(ok)
        yield doc_of[start], (span_hash(sums, start, start + n) >> shift).astype(np.int64)


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    found = [b for _, b in features(data, np.array([0, len(data)]))]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    ids, n = np.unique(np.concatenate(found), return_counts=True)
    return ids, (n / n.sum()).astype(np.float32)


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """(logit share of every bucket, bias) of class 1 against class 0."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    bags = [_bag(t) for t in texts]
    steps, total = 0, max(1, epochs * len(bags))
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            lr = rate * (1 - steps / total)
            steps += 1
            rows = vectors[ids]
            hidden = share @ rows
            logit = out @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= lr * np.outer(p, hidden)
            bias -= np.float32(lr) * p
            vectors[ids] = rows - (lr * len(ids) ** 0.5 * share)[:, None] * back
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> list[tuple[bytes, int]]:
    """At most `sample` (text, label) rows that aren't held out, chosen by a hash of the id; labels are cut first, so the join is small.

    An id with both labels counts as 1; of rows with one id the one with the least text counts; null ids, null texts and
    texts beyond `longest` bytes are left out.
    """
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.coalesce(~held_out(), F.lit(False)))
    share = min(1.0, 1.5 * sample / max(1, marked.count())) * (1 << 30)
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    few = marked.withColumn("o", order).where(F.col("o") < math.ceil(share)).groupBy("doc_id", "o").agg(F.max("label").alias("label")).orderBy("o", "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= longest)
    rows = texts.join(F.broadcast(few), "doc_id").groupBy("o", "doc_id", "label").agg(F.min("text").alias("text"))  # at most `sample` ids
    return [(r["text"].encode(), r["label"]) for r in rows.orderBy("o", "doc_id").toLocalIterator()]


def score(docs: DataFrame, table: np.ndarray, bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; empty and null texts get the bias alone. Texts are read whole.

    Null ids stay null and aren't held out; repeated rows each give a row; equal texts get equal scores; other columns are
    not read; an empty table gives no row.
    """
    model = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))  # 2**BITS numbers

    def run(batches):
        import pyarrow as pa

        weights = model.value
        for batch in batches:
            for i, j in chunks(batch.column(2), 1 << 20):
                part = batch.slice(i, j - i)
                data, off = string_bytes(part.column(2))
                total, n = np.zeros(len(part)), np.zeros(len(part))
                for doc, bucket in features(data, off):
                    total += np.bincount(doc, weights[bucket], len(part))
                    n += np.bincount(doc, minlength=len(part))
                value = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -30, 30)))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by a model trained on a bounded sample of labelled ones that aren't held out."""
    docs = documents(spark, sf_dir)
    rows = labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, *train([t for t, _ in rows], [y for _, y in rows]))
