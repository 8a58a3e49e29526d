"""Model boundary: protocols as Arrow-batched UDFs with deterministic stand-ins, so that everything around a model can be tested."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType


#: Characters of the texts that the embedder splits into words at once: a worker's memory doesn't depend on a batch's size.
SLICE = 1 << 20


def _slices(texts: list[str], size: int) -> Iterator[list[str]]:
    """The texts in order, as runs of at most `size` characters or one text."""
    part, n = [], 0
    for t in texts:
        if part and n + len(t) > size:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part


def hash_embedder(dim: int = 16):
    """text -> unit vector from its words' hashes; loads nothing, the same everywhere. Swap the body for a real model.

    A slice's distinct words are hashed once, and all its texts are summed up at once.
    """

    def vectors(texts: list[str]):
        import numpy as np

        words = [t.split() for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        code, names = pd.factorize(np.array([x for w in words for x in w], object))
        h = np.array([hashlib.md5(w.encode()).digest()[:2] for w in names], "S2").view(np.uint8).reshape(-1, 2) if len(names) else np.zeros((0, 2), np.uint8)
        v = np.zeros((len(texts), dim))
        np.add.at(v, (row, h[code, 0] % dim), np.where(h[code, 1] & 1, 1.0, -1.0))
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(n > 0, n, 1)).astype("float32")

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:  # a real model is loaded before the loop, once for each worker
            yield pd.Series([v for part in _slices(batch.fillna("").tolist(), SLICE) for v in vectors(part)], dtype=object)

    return embed


def hash_scorer(classes: int = 2):
    """key -> class probabilities from a hash."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(key):
            raw = [1 + b for b in hashlib.md5(str(key).encode()).digest()[:classes]]
            return [x / sum(raw) for x in raw]

        for batch in batches:
            yield batch.map(one)

    return score


def reconcile_flags(flags, text):
    """Flags with empty_output if and only if the text is blank; null flags count as none."""
    own = F.coalesce(flags, F.array().cast("array<string>"))
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.when(~blank, F.array_remove(own, "empty_output")).when(F.array_contains(own, "empty_output"), own).otherwise(F.array_append(own, F.lit("empty_output")))


def translate_distinct(df: DataFrame, text: str, out: str, translate: Callable[[list[str]], list[str]], batch: int = 32, done: DataFrame | None = None) -> DataFrame:
    """Translate every distinct text once, in batches that are halved when the translator fails; a single text that fails is null and flagged.

    done: a checkpoint with the columns text and out; its texts are taken from it (`resumed`). Distinct texts go through
    mapInPandas and are joined back by their hash.
    """

    def halving(texts: list[str]) -> list[str | None]:
        try:
            return list(translate(texts))
        except Exception:
            if len(texts) == 1:
                return [None]
            mid = len(texts) // 2
            return halving(texts[:mid]) + halving(texts[mid:])

    def run(frames):
        for pdf in frames:
            texts = pdf["t"].tolist()
            made: list = []
            for i in range(0, len(texts), batch):
                made += halving(texts[i : i + batch])
            yield pd.DataFrame({"k": pdf["k"], "made": made})

    keyed = df.withColumn("_k", F.sha2(text, 256))
    distinct = keyed.where(F.col(text).isNotNull()).groupBy(F.col("_k").alias("k")).agg(F.first(text).alias("t"))
    if done is None:
        old = None
    else:
        old = done.select(F.sha2(text, 256).alias("k"), F.col(out).alias("made")).dropDuplicates(["k"])
        distinct = distinct.join(old.select("k"), "k", "left_anti")
    every = distinct.mapInPandas(run, "k string, made string").withColumn("resumed", F.lit(False))
    if old is not None:
        every = every.unionByName(old.withColumn("resumed", F.lit(True)))
    joined = keyed.join(every, keyed._k == every.k, "left").withColumn("resumed", F.coalesce("resumed", F.lit(False)))
    return joined.withColumn(out, F.col("made")).withColumn(f"{out}_flags", reconcile_flags(F.lit(None).cast("array<string>"), F.col("made"))).drop("_k", "k", "made")


def pad(tokens, length: int, filler: int = 0):
    """Token ids cut or filled to a length."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(filler), length)), 1, length)
