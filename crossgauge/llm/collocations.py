"""Phrase collocations by pattern growth: contiguous word sequences grow to the right from their frequent prefixes, depth first.

Words are counted first. An occurrence of a frequent pair of frequent words is projected: a pointer to the pair and up to
three words behind it, as far as every two neighbours form a frequent pair. Equal projections are added up, and dealt to
tasks by their words in order, so that a prefix's projections lie together and a prefix of a third of all rows is spread
over several tasks by the words behind it. A task holds projections sorted in memory, block by block; a prefix is a range of
pointers, which splits into the ranges of its extensions; ranges under the threshold are not entered. What a range at
a block's edge lacks is added up afterwards.

Words are told apart by 64-bit hashes of language and word. Filters of frequent words and pairs have a fixed size; what
they let through wrongly is counted and falls out.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.llm.common import _LOWER, chunks, documents, freed_shuffles, mix64, prefix_hash, small_batches, span_hash, stash, string_bytes

LEAST = 100
LONGEST = 5
TOP = 2000
#: Bits of a filter of hashes: 16 MB in a worker, whatever the corpus. At a corpus that fills it more is shipped and counted.
FILTER_BITS = 27
#: Projections that a task sorts and searches at once.
BLOCK = 1 << 18
#: Bytes of text that a task takes at once.
CHUNK = 2 << 20
NO_LANGUAGE = "und"

_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\v\f\r"]] = True
_BLANK[[*b" \t"]] = True


def _filter(keys: DataFrame, col: str, bits: int) -> np.ndarray:
    """A bit for the first `bits` bits of every key, gathered word by word: at most 2**(bits - 6) rows reach the driver."""
    slot = F.shiftrightunsigned(F.col(col), 64 - bits)
    bit = F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({col}, {64 - bits}) & 63 AS int))"))
    with freed_shuffles(keys.sparkSession):
        words = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(bit.alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def _in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys >> np.uint64(58 - (len(table).bit_length() - 1))
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * np.uint64(0x9E3779B97F4A7C15) + right)


class Words:
    """Words of the texts of a batch: hash with the language, bytes, and whether the next word follows in the same piece of the same text."""

    def __init__(self, langs, texts):
        self.data, off = string_bytes(texts)
        self.data = _LOWER[self.data]
        n = len(off) - 1
        self.names = sorted({NO_LANGUAGE if x is None else x for x in langs})
        lang = np.array([self.names.index(NO_LANGUAGE if x is None else x) for x in langs], np.int64)
        seed = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.names], np.uint64)
        stop = _BREAK[self.data]
        inside = ~(stop | _BLANK[self.data])
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < len(self.data))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        doc = np.repeat(np.arange(n), np.diff(np.searchsorted(self.start, off)))
        self.lang = lang[doc]
        plain = span_hash(prefix_hash(self.data), self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        self.hash = np.maximum(mix64(plain ^ seed[self.lang]), np.uint64(1)) if len(plain) else plain
        piece = np.cumsum(stop, dtype=np.int32)[self.start] if len(self.start) else np.zeros(0, np.int32)
        self.joined = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])

    def strings(self, at: np.ndarray):
        """The words at these places as an Arrow column."""
        import pyarrow as pa

        size = self.end[at] - self.start[at]
        stop = np.cumsum(size)
        raw = self.data[np.repeat(self.start[at] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate(([0], stop)).astype(np.int32)), pa.py_buffer(raw))


def _batches(batches):
    for batch in batches:
        for i, j in chunks(batch.column(1), CHUNK):
            yield Words(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i))


def word_counts(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """A written table lang, h, word, n of the words seen `least` times in their language, and of every language's words together (h and word null)."""

    def run(batches):
        import pyarrow as pa

        for x in _batches(batches):
            h, first, n = np.unique(x.hash, return_index=True, return_counts=True)
            names = pa.array(x.names, pa.string())
            yield pa.record_batch([names.take(pa.array(x.lang[first])), pa.array(h.view(np.int64)), x.strings(first), pa.array(n)], names=["lang", "h", "word", "n"])
            total = np.bincount(x.lang, minlength=len(x.names))
            none = pa.nulls(len(names))
            yield pa.record_batch([names, none.cast(pa.int64()), none.cast(pa.string()), pa.array(total)], names=["lang", "h", "word", "n"])

    counts = texts.mapInArrow(run, "lang string, h long, word string, n long").groupBy("lang", "h", "word").agg(F.sum("n").alias("n"))
    return stash(counts.where(f"n >= {least} OR h IS NULL"), "words")


def grow(columns: list[np.ndarray], times: np.ndarray, least: int):
    """(words, count) of every prefix of two words or more in sorted projections, if its count is `least` or it touches the block's edge, where more may follow.

    columns: the first, second .. word of each projection, 0 where it has ended; rows sorted by them. A prefix is the
    range of its pointers, extended to the right depth first.
    """
    m = len(times)
    total = np.concatenate(([0], np.cumsum(times)))

    def extend(prefix: tuple[int, ...], low: int, high: int):
        depth = len(prefix)
        col = columns[depth][low:high]
        begin = np.concatenate(([0], np.flatnonzero(col[1:] != col[:-1]) + 1)) + low
        end = np.append(begin[1:], high)
        n = total[end] - total[begin]
        use = ((n >= least) | (begin == 0) | (end == m)) & (columns[depth][begin] != 0)
        for word, a, b, c in zip(columns[depth][begin[use]].tolist(), begin[use].tolist(), end[use].tolist(), n[use].tolist(), strict=True):
            found = (*prefix, word)
            if depth:
                yield found, c
            if depth + 1 < len(columns):
                yield from extend(found, a, b)

    if m:
        yield from extend((), 0, m)


def phrase_counts(texts: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, bits: int = FILTER_BITS) -> DataFrame:
    """A written table gram (array of word hashes), n of the phrases of 2 to `longest` words seen `least` times."""
    spark = texts.sparkSession
    frequent = spark.sparkContext.broadcast(_filter(words.where("h IS NOT NULL"), "h", bits))
    cols = [f"h{k}" for k in range(longest)]

    def pairs(batches):
        import pyarrow as pa

        for x in _batches(batches):
            known = _in(frequent.value, x.hash)
            at = np.flatnonzero(x.joined & known[:-1] & known[1:])
            key, n = np.unique(_pair(x.hash[at], x.hash[at + 1]), return_counts=True)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n)], names=["p", "n"])

    seen = texts.mapInArrow(pairs, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).where(f"n >= {least}")
    together = spark.sparkContext.broadcast(_filter(seen, "p", bits))

    def projections(batches):
        import pyarrow as pa

        for x in _batches(batches):
            if len(x.hash) < 2:
                continue
            known = _in(frequent.value, x.hash)
            near = np.flatnonzero(x.joined & known[:-1] & known[1:])
            near = near[_in(together.value, _pair(x.hash[near], x.hash[near + 1]))]
            follows = np.zeros(len(x.hash) + longest, bool)
            follows[near] = True
            table = np.zeros((longest, len(near)), np.uint64)
            table[0] = x.hash[near]
            on = np.ones(len(near), bool)
            hashes = np.concatenate((x.hash, np.zeros(longest, np.uint64)))
            for k in range(1, longest):
                on &= follows[near + k - 1]
                table[k, on] = hashes[near[on] + k]
            order = np.lexsort(table[::-1])
            table = table[:, order]
            new = np.concatenate(([True], (table[:, 1:] != table[:, :-1]).any(axis=0))) if len(order) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            yield pa.record_batch([*(pa.array(c[begin].view(np.int64)) for c in table), pa.array(np.diff(np.append(begin, len(order))))], names=[*cols, "n"])

    shipped = texts.mapInArrow(projections, ", ".join(f"{c} long" for c in cols) + ", n long")
    added = stash(shipped.groupBy(*cols).agg(F.sum("n").alias("n")), "projections")

    def grown(batches):
        import pyarrow as pa

        def search(parts):
            table = [np.concatenate([p[k] for p in parts]) for k in range(longest + 1)]
            found = list(grow(table[:longest], table[longest], least))
            lists = pa.array([g for g, _ in found], pa.list_(pa.int64()))
            return pa.record_batch([lists, pa.array([c for _, c in found], pa.int64())], names=["gram", "n"])

        held, rows = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows >= block:
                yield search(held)
                held, rows = [], 0
        if held:
            yield search(held)

    dealt = added.repartitionByRange(*cols).sortWithinPartitions(*cols)
    counts = dealt.mapInArrow(grown, "gram array<long>, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return stash(counts.where(f"n >= {least}"), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `longest` words by their weakest cut.

    A phrase with a longer one around it that is as frequent is dropped. Null texts are empty, a null language is `und`;
    ids play no part; repeated rows count as often as they are there; ties go by count, then by the phrase's bytes; other
    columns are not read; an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("lang", "text")
    words = word_counts(texts, least)
    grams = phrase_counts(texts, words, least, longest, block)
    size = F.size("gram")
    inner = grams.where(size > 2).select(F.explode(F.array(F.slice("gram", 1, size - 1), F.expr("slice(gram, 2, size(gram) - 1)"))).alias("gram"), "n").distinct()
    closed = grams.join(inner, ["gram", "n"], "left_anti")  # what lies inside a longer phrase lies inside one that is a word longer
    known = grams.union(words.where("h IS NOT NULL").select(F.array("h"), "n"))
    cuts = closed.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("gram", F.col("n").alias("a"), "k", F.expr("slice(gram, 1, k)").alias("left"), F.expr("slice(gram, k + 1, size(gram) - k)").alias("right"))
    cuts = cuts.join(known.toDF("left", "l"), "left").join(known.toDF("right", "r"), "right")
    first = words.where("h IS NOT NULL").select(F.col("h").alias("first"), "lang")
    total = words.where("h IS NULL").select("lang", F.col("n").alias("total"))
    cuts = cuts.withColumn("first", F.col("gram")[0]).join(first, "first").join(total, "lang")
    wide = {c: f"cast({c} AS decimal(38,0))" for c in ("a", "total", "l", "r")}
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000 AS decimal(38,0)) * {wide['a']} * {wide['total']}) div ({wide['l']} * {wide['r']})"))
    scored = cuts.groupBy("lang", "gram", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = [F.desc("score"), F.desc("a")]
    scored = scored.select("lang", "gram", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"))
    best = scored.withColumn("at", F.rank().over(W.partitionBy("lang").orderBy(*order))).where(F.col("at") <= top).drop("at")
    spelt = best.select("lang", "gram", F.posexplode("gram").alias("pos", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    spelt = spelt.groupBy("lang", "gram").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])).alias("phrase"))
    ranked = best.join(spelt, ["lang", "gram"]).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all documents, language by language."""
    return collocations(documents(spark, sf_dir))


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces
), total AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM split GROUP BY lang
), grams AS (
  SELECT lang, ws[i : i + m - 1] AS g
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM split, range(1, {LONGEST + 1}) AS t(m))
), f AS (
  SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= {LEAST}
), inner_ AS (
  SELECT lang, g[:-2] AS g, a FROM f WHERE len(g) > 2 UNION SELECT lang, g[2:] AS g, a FROM f WHERE len(g) > 2
), closed AS (
  SELECT * FROM f WHERE len(g) > 1 AND (lang, g, a) NOT IN (SELECT (lang, g, a) FROM inner_)
), cuts AS (
  SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM closed
), scored AS (
  SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:] JOIN total t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM weakest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}
"""
