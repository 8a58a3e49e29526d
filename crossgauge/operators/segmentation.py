"""Unsupervised morph segmentation by minimum description length, with rules behind it.

A lexicon of morphs is learned in rounds over the table of distinct words: every word is cut in the cheapest way that the
lexicon allows (Viterbi), and Spark adds the morphs' uses up. A use costs what its share of all uses tells, and its part of
the bits that spell the morph once, so a rare morph gets dearer until its words are cut in another way and it goes.
A language's lexicon has at most `size` morphs, which bounds what is broadcast.
Words of a language without a lexicon are cut by suffix rules, or not at all; every row tells by which rung.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.sources.io import scratch

#: Most morphs of a language, characters of the longest one, and bits that a character costs in the lexicon.
SIZE, LONGEST, BITS = 50_000, 12, 5.0
#: Bits of a character that no morph covers.
UNKNOWN = 25.0


@dataclass
class Lexicon:
    costs: dict[str, dict[str, float]]  # language -> morph -> bits
    lengths: list[float] = field(default_factory=list)  # description length after each round, in bits


def cheapest(word: str, costs: dict[str, float]) -> tuple[list[str], float]:
    """The cut of a word into morphs that costs least, and its bits; ties go to the longer last morph."""
    best, back = [0.0] + [math.inf] * len(word), [0] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        for begin in range(max(0, end - LONGEST), end):
            part = word[begin:end]
            bits = costs.get(part)
            if bits is None:
                if end - begin > 1:
                    continue
                bits = UNKNOWN
            if best[begin] + bits < best[end]:
                best[end], back[end] = best[begin] + bits, begin
    parts, end = [], len(word)
    while end:
        parts.append(word[back[end] : end])
        end = back[end]
    return parts[::-1], best[-1]


def _usage(rows: Iterator[tuple[str, list[str]]]):
    """Record batch lang, morph, n of the parts."""
    from collections import Counter

    import pyarrow as pa

    n: Counter = Counter()
    for lang, parts in rows:
        n.update((lang, p) for p in parts)
    names = list(n)
    return pa.record_batch([pa.array([a for a, _ in names], pa.string()), pa.array([b for _, b in names], pa.string()), pa.array([n[x] for x in names], pa.int64())], names=["lang", "morph", "n"])


def _edges(word: str) -> list[str]:
    """Heads, tails and characters of a word: what a first lexicon is made of."""
    ends = range(1, min(len(word), LONGEST + 1))
    return [*{*(word[:k] for k in ends), *(word[-k:] for k in ends), *([word] if len(word) <= LONGEST else [])}, *(c for c in word)]


def learn(words: DataFrame, size: int = SIZE, rounds: int = 8, bits: float = BITS) -> Lexicon:
    """A lexicon of every language of words (lang, word); repeated words count once, null and empty ones not at all."""
    spark, path = words.sparkSession, scratch(words.sparkSession, "words")
    words.select("lang", "word").where("lang IS NOT NULL AND word <> ''").distinct().write.parquet(path)
    words = spark.read.parquet(path)

    def counted(df: DataFrame, parts) -> DataFrame:
        def run(batches):
            for b in batches:
                yield _usage((lang, parts(lang, w)) for lang, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

        return df.mapInArrow(run, "lang string, morph string, n long").groupBy("lang", "morph").agg(F.sum("n").alias("n"))

    def kept(found: DataFrame) -> dict[str, dict[str, int]]:
        """The `size` morphs of each language that save most; characters always stay."""
        first = F.row_number().over(W.partitionBy("lang").orderBy(F.desc(F.col("n") * (F.length("morph") - 1)), F.desc("n"), "morph"))
        out: dict[str, dict[str, int]] = {}
        for r in found.withColumn("r", first).where((F.col("r") <= size) | (F.length("morph") == 1)).select("lang", "morph", "n").toLocalIterator():
            out.setdefault(r["lang"], {})[r["morph"]] = r["n"]
        return out

    def costs_of(counts):
        return {lang: {m: math.log2(sum(own.values()) / n) + (len(m) + 1) * bits / n for m, n in own.items()} for lang, own in counts.items()}

    lexicon = Lexicon(costs_of(kept(counted(words, lambda _, w: _edges(w)).where("n > 1 OR length(morph) = 1"))))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(lexicon.costs)
        counts = kept(counted(words, lambda lang, w: cheapest(w, shared.value[lang])[0]))
        new = Lexicon(costs_of(counts), lexicon.lengths)
        lexicon.lengths.append(sum(n * new.costs[lang][m] for lang, own in counts.items() for m, n in own.items()))
        same = all(new.costs.get(k, {}).keys() == v.keys() for k, v in lexicon.costs.items())
        lexicon = new
        if same:
            break
    return lexicon


def segment(df: DataFrame, lexicon: Lexicon, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """df (lang, word and others) with stem, suffix and rung: learned, suffix_rules or unavailable.

    stem is the first morph, suffix the rest; by rules the longest suffix that leaves a stem goes. A null word has null results.
    """
    shared = df.sparkSession.sparkContext.broadcast((lexicon.costs, {k: sorted(v, key=len, reverse=True) for k, v in rules.items()}))
    at = [df.columns.index(c) for c in ("lang", "word")]

    def cut(lang, word):
        costs, rules = shared.value
        if word is None:
            return None, None, None
        if lang in costs:
            parts = cheapest(word, costs[lang])[0]
            return "".join(parts[:1]), "".join(parts[1:]), "learned"
        if lang in rules:
            suffix = next((s for s in rules[lang] if word.endswith(s) and len(word) > len(s)), "")
            return word[: len(word) - len(suffix)], suffix, "suffix_rules"
        return word, "", "unavailable"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [cut(lang, w) for lang, w in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.record_batch([*b.columns, *(pa.array(c, pa.string()) for c in cols)], names=[*b.schema.names, "stem", "suffix", "rung"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", stem string, suffix string, rung string")
