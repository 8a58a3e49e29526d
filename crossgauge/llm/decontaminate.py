"""Benchmark decontamination: a BM25 inverted index of test items, queried with every training passage by block-max WAND.

Items (longer ones in segments) are sorted by the score they need and cut into blocks of ITEMS. A passage meets a block
only through a pivot term: one of an item's heaviest terms, without all of which the item can't reach its score. Such a
block is bounded by the sum of its largest impacts for the passage's terms, and skipped if that is below the least
score that the block asks for; only in the blocks that are left are postings read. Items at or above their own
threshold are verified: half of the word 5-grams of the item's question and of the 3-grams of its answer must
occur in the passage, or, as one edit breaks most n-grams of a short part, a part of under SHORT words must occur with
at most a quarter of its words edited (one at least).
Passages are windows of 2 * STEP words every STEP words, so a segment (at most STEP words) lies whole in one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgauge.llm.common import chunks, documents, fresh, mix64, row_key, stash, string_bytes, without, words

STEP = 64
#: Segments in a block of the index.
ITEMS = 32
K1, B = 1.2, 0.75
#: Of a segment's own BM25 score, how much a passage must reach.
SHARE = 0.7
#: Word n-grams compared in verification, of questions and of answers, and the share of each that must be found: one edit
#: in an answer of ten words still leaves half of its 3-grams.
QUESTION_GRAM, ANSWER_GRAM = 5, 3
FOUND = 0.5
#: Parts of fewer words are also taken as found by edit distance.
SHORT = 25
#: The index is broadcast; test items beyond this many bytes of text are taken in blocks of that size.
INDEX_BYTES = 8 << 20


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words (of all words, if fewer)."""
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1 if n else 0, np.uint64)
    for k in range(n):
        out = mix64(out + h[k : k + len(out)])
    return out


def _edits(part: np.ndarray, own: np.ndarray) -> int:
    """The fewest word insertions, deletions and substitutions between the part and any stretch of own."""
    step = np.arange(len(own) + 1)
    row = np.zeros(len(own) + 1, np.int64)
    for i, w in enumerate(part.tolist()):
        new = np.minimum(np.concatenate(([i + 1], row[:-1] + (own != np.uint64(w)))), row + 1)
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def _segments(texts, step: int) -> list[tuple[int, np.ndarray]]:
    """(which text, word hashes) of the segments of texts: near equal parts of at most `step` words."""
    import pyarrow as pa

    out = []
    for k, text in enumerate(texts):
        h = words(*string_bytes(pa.array([text], pa.string())))[0]
        n = max(1, -(-len(h) // step))
        cut = [len(h) * j // n for j in range(n + 1)]
        out += [(k, h[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]
    return out


class Statistics:
    """What BM25 asks of the whole test set: terms, in how many segments each occurs, how many segments there are, their mean length."""

    def __init__(self, terms: np.ndarray, df: np.ndarray, n: int, mean: float):
        self.terms, self.df, self.n, self.mean = terms, df, n, mean

    @classmethod
    def of(cls, segments: list[np.ndarray]) -> Statistics:
        terms, df = np.unique(np.concatenate([np.unique(h) for h in segments] or [np.zeros(0, np.uint64)]), return_counts=True)
        return cls(terms, df, len(segments), float(np.mean([len(h) for h in segments])) if segments else 1.0)

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[np.searchsorted(self.terms, terms)]
        return np.log(1 + (self.n - df + 0.5) / (df + 0.5))


def _expand(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of every place in the ranges."""
    n = stop - start
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + start[owner]


class Index:
    """items: (id, text). statistics: of the test set that the items are a part of; their own if none are given."""

    def __init__(self, items: list[tuple[int, str]], step: int = STEP, statistics: Statistics | None = None):
        segments = _segments([t for _, t in items], step)
        statistics = statistics or Statistics.of([h for _, h in segments])
        self.step = step
        self.terms = np.unique(np.concatenate([h for _, h in segments])) if segments else np.zeros(0, np.uint64)
        idf = statistics.idf(self.terms)
        found = []
        for _, h in segments:
            t, n = np.unique(np.searchsorted(self.terms, h), return_counts=True)
            found.append((t, idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(h) / statistics.mean))))
        need = np.array([SHARE * x.sum() for _, x in found])
        order = np.argsort(need, kind="stable").tolist()
        self.need = need[order]
        self.item = [items[segments[i][0]][0] for i in order]
        self.n_blocks = -(-len(order) // ITEMS)
        self.least = self.need[::ITEMS]
        # postings by (term, block, place); an entry is the postings of one term in one block
        term = np.concatenate([found[i][0] for i in order] or [np.zeros(0, np.int64)])
        impact = np.concatenate([found[i][1] for i in order] or [np.zeros(0)])
        place = np.repeat(np.arange(len(order)), [len(found[i][0]) for i in order])
        pivot = np.concatenate([self._pivots(found[i][1]) for i in order] or [np.zeros(0, bool)])
        by = np.lexsort((place, term))
        key = term[by] * max(1, self.n_blocks) + place[by] // ITEMS
        self.post_place, self.post_impact = place[by], impact[by]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.entry, self.entry_at = key[begin], np.append(begin, len(key))
        self.entry_max = np.maximum.reduceat(self.post_impact, begin) if len(key) else np.zeros(0)
        pivots = np.unique(key[pivot[by]])
        self.pivot_block = pivots % max(1, self.n_blocks)
        self.pivot_at = np.searchsorted(pivots // max(1, self.n_blocks), np.arange(len(self.terms) + 1))
        half = [max(1, (2 * len(segments[i][1]) + 2) // 3) for i in order]  # the question: the first two thirds
        self.question_hash = [segments[i][1][:q] for i, q in zip(order, half, strict=True)]
        self.answer_hash = [segments[i][1][q:] for i, q in zip(order, half, strict=True)]
        self.question = [_grams(h, QUESTION_GRAM) for h in self.question_hash]
        self.answer = [_grams(h, ANSWER_GRAM) for h in self.answer_hash]
        slots = 1 << max(10, int(np.ceil(np.log2(max(1, len(self.terms))))) + 3)
        self.shift = np.uint64(64 - int(np.log2(slots)))
        self.filter = np.zeros(slots, bool)
        self.filter[(self.terms >> self.shift).astype(np.int64)] = True

    @staticmethod
    def _pivots(impact: np.ndarray) -> np.ndarray:
        """The heaviest terms, as few as leave the others together below what is needed."""
        order = np.argsort(-impact, kind="stable")
        left = impact.sum() - np.cumsum(impact[order])
        out = np.zeros(len(impact), bool)
        out[order[: int(np.argmax(left < SHARE * impact.sum() * (1 - 1e-9))) + 1]] = True
        return out

    def search(self, h: np.ndarray, doc: np.ndarray):
        """(document, item, score, question found, answer found) of every verified hit among the words' passages."""
        at = np.flatnonzero(self.filter[(h >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.terms):
            return
        t = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        known = self.terms[t] == h[at]
        at, t = at[known], t[known]
        if not len(at):
            return
        first = np.searchsorted(doc, np.arange(doc[-1] + 1))
        cell = (at - first[doc[at]]) // self.step  # the word's place in its text, in steps
        n_cells = np.zeros(len(first), np.int64)
        np.maximum.at(n_cells, doc[at], cell + 1)
        base = np.cumsum(n_cells) - n_cells
        cell = base[doc[at]] + cell
        # passage p covers cells p and p+1 of its text; the first also stands for texts of one cell
        pair = np.concatenate((cell, cell[cell > base[doc[at]]] - 1))
        term = np.concatenate((t, t[cell > base[doc[at]]]))
        key = np.sort(pair * len(self.terms) + term)
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        passage, term = key // len(self.terms), key % len(self.terms)
        begin = np.flatnonzero(np.concatenate(([True], np.diff(passage) > 0)))
        owner = np.searchsorted(base + n_cells, passage[begin], side="right")
        for r, place, score in self._above(term, begin):
            d = int(owner[r])
            p = int(passage[begin[r]] - base[d])
            stop = first[d + 1] if d + 1 < len(first) else len(h)
            own = h[first[d] + p * self.step : min(stop, first[d] + (p + 2) * self.step)]
            q = self._found(self.question[place], self.question_hash[place], QUESTION_GRAM, own)
            a = self._found(self.answer[place], self.answer_hash[place], ANSWER_GRAM, own)
            if q >= FOUND and a >= FOUND:
                yield d, self.item[place], score, float(q), float(a)

    def _above(self, term: np.ndarray, begin: np.ndarray):
        """(passage, place, score) of all items at or above their threshold. Passages are the runs of terms that begin at `begin`."""
        stop = np.append(begin[1:], len(term))
        passage = np.repeat(np.arange(len(begin)), stop - begin)
        which, at = _expand(self.pivot_at[term], self.pivot_at[term + 1])
        met = np.unique(passage[which] * self.n_blocks + self.pivot_block[at])  # (passage, block) by a pivot term
        row, block = met // self.n_blocks, met % self.n_blocks
        pair, at = _expand(begin[row], stop[row])
        key = term[at] * self.n_blocks + block[pair]
        entry = np.minimum(np.searchsorted(self.entry, key), max(0, len(self.entry) - 1))
        there = self.entry[entry] == key
        pair, entry = pair[there], entry[there]
        bound = np.bincount(pair, self.entry_max[entry], len(met))
        live = bound >= self.least[block] * (1 - 1e-9)
        use = live[pair]
        pair, entry = pair[use], entry[use]
        which, at = _expand(self.entry_at[entry], self.entry_at[entry + 1])
        found, inverse = np.unique(row[pair[which]] * len(self.need) + self.post_place[at], return_inverse=True)
        score = np.bincount(inverse, self.post_impact[at], len(found))
        place = found % max(1, len(self.need))
        hit = score >= self.need[place] - 1e-9
        yield from zip((found // max(1, len(self.need)))[hit].tolist(), place[hit].tolist(), score[hit].tolist(), strict=True)

    @staticmethod
    def _found(grams: np.ndarray, part: np.ndarray, gram: int, own: np.ndarray) -> float:
        n = len(part)
        if not n:
            return 1.0
        share = float(np.isin(grams, _grams(own, min(gram, n))).mean())
        if share < FOUND and n < SHORT:
            edits = _edits(part, own)
            if edits < n and edits <= max(1, n // 4):
                return 1 - edits / n
        return share


def _term_counts(items: DataFrame, step: int) -> DataFrame:
    """term, df over the segments of all items; the null term counts the segments, `size` their words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j in chunks(batch.column(0)):
                own = [h for _, h in _segments(batch.column(0).slice(i, j - i).to_pylist(), step)]
                found = Statistics.of(own)
                size = [0] * len(found.terms) + [sum(map(len, own))]
                yield pa.record_batch([pa.array([*found.terms.view(np.int64).tolist(), None], pa.int64()), pa.array([*found.df.tolist(), len(own)], pa.int64()), pa.array(size, pa.int64())], names=["term", "df", "size"])

    return items.select("text").mapInArrow(run, "term long, df long, size long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size"))


def _statistics(counts: DataFrame, part: DataFrame, step: int) -> Statistics:
    """The whole test set's statistics for the terms of one part of it."""
    whole = counts.where("term is null").first()
    rows = counts.join(_term_counts(part, step).select("term"), "term").select("term", "df").collect()  # at most a block's words
    term = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(term)
    n = whole["df"] if whole else 0
    return Statistics(term[order], np.array([r[1] for r in rows], np.int64)[order], n, whole["size"] / n if n else 1.0)


def contaminated(docs: DataFrame, items: DataFrame, step: int = STEP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_found, answer_found: one row per document and test item that it holds.

    Null or empty texts and items give nothing; a repeated document gives its own rows once per doc_id. Test sets
    larger than index_bytes are searched in blocks, each broadcast by itself, over the same documents, with the scores
    and thresholds of the whole test set.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // index_bytes))
    counts = None if blocks == 1 else stash(_term_counts(items, step), "terms")
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted((r[0] is None, r[0] or 0, r[0], r[1]) for r in part.collect())
        whole = None if counts is None else _statistics(counts, part, step)
        index = spark.sparkContext.broadcast(Index([r[2:] for r in rows], step, whole))

        def run(batches, index=index):
            import pyarrow as pa

            for batch in batches:
                ids = batch.column(0).to_pylist()
                found: list[tuple] = []
                for i, j in chunks(batch.column(1)):
                    h, doc, _, _ = words(*string_bytes(batch.column(1).slice(i, j - i)))
                    if len(h):
                        found += [(ids[i + d], *rest) for d, *rest in index.value.search(h, doc)]
                cols = list(zip(*found, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "question_found", "answer_found"])

        hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).mapInArrow(run, "doc_id long, item_id long, score double, question_found double, answer_found double")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question_found", "answer_found")])


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs' rows, all columns, that hold no test item. Null and empty texts stay, repeated rows share their fate, ids may be null."""
    key = fresh(docs, "_key")
    hits = contaminated(docs.select(row_key().alias("doc_id"), "text"), items).select(F.col("doc_id").alias(key)).distinct()
    return without(docs.withColumn(key, row_key()), stash(hits, "hits", docs.count()), key).select(*docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
