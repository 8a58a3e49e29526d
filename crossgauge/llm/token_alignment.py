"""Alignment of two tokenizers' tokens over the bytes of a text, with corpus-wide counts of the linked id pairs.

Each byte of a text has an owner, a token's index, in either tokenization: np.repeat of the indices over the tokens'
lengths. Where the pair of owners changes an overlap of two tokens begins; where both change at once both tokenizations
have a cut, which divides the text into groups. The two tokens that end at a cut are linked.

Texts are encoded once. Documents are kept as a written table of their distinct pairs, packed; pairs are counted by Spark,
and the counts come back to the documents by a look-up while there are at most LOOKUP_PAIRS pairs (two vocabularies of
at most 65536 ids bound them, not the corpus), by a join beyond that.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgauge.llm.common import chunks, documents, stash, stash_map, string_bytes
from crossgauge.llm.segments import ByteLevel, Pieces, Segments, segments

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Distinct pairs whose counts a worker looks up in memory, 17 bytes each.
LOOKUP_PAIRS = 1 << 21
#: Pairs that a task gathers before it adds equal ones up.
GATHERED = 1 << 21

_DOCUMENT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


class Tokens:
    """An encoder with its tokens' bytes as arrays."""

    def __init__(self, encoder: Segments):
        self.encoder, self.size = encoder, len(encoder.bytes)
        self.lengths = np.fromiter(map(len, encoder.bytes), np.int32, self.size)
        self.begin = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.flat = np.frombuffer(b"".join(encoder.bytes), np.uint8)

    def joined(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        stop = np.cumsum(lengths, dtype=np.int64)
        return self.flat[np.repeat(self.begin[ids] - (stop - lengths), lengths) + np.arange(int(stop[-1]) if len(stop) else 0)]


@lru_cache(maxsize=2)
def tokens(kind: type, name: str) -> Tokens:
    return Tokens(segments(kind, name))


@lru_cache(maxsize=1)
def _digits(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. size - 1 one after another, where each number's begin, and how many."""
    text = [str(i) for i in range(size)]
    n = np.fromiter(map(len, text), np.int64, size)
    return np.frombuffer("".join(text).encode() + b"0", np.uint8), np.cumsum(n) - n, n


def owners(lengths: np.ndarray) -> np.ndarray:
    """Of every byte the index of the token that holds it."""
    return np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def align(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping token pairs (two index arrays) and the pairs that end together (two more), both in byte order; the lengths' sums are equal."""
    a, b = owners(a_lengths), owners(b_lengths)
    new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
    full = np.full(min(len(a), 1), True)
    begins = np.flatnonzero(np.concatenate((full, new_a | new_b)))
    ends = np.flatnonzero(np.concatenate((new_a & new_b, full)))
    return a[begins], b[begins], a[ends], b[ends]


class Aligned:
    """The texts of an Arrow column in both tokenizations: ids a and b with counts n_a and n_b, and, over all texts' tokens, overlaps and links."""

    def __init__(self, column, a: Tokens, b: Tokens):
        data, off = string_bytes(column)
        n, full = len(off) - 1, off[1:] > off[:-1]
        blank = np.concatenate(([0], np.cumsum(full)))
        off = off + blank
        text = np.full(int(off[-1]), 32, np.uint8)
        inside = np.ones(len(text), bool)
        inside[off[:-1][full]] = False
        text[inside] = data
        keep, sides = full, []
        for side in (a, b):
            ids, count = side.encoder.batch(text, off)
            lengths, doc = side.lengths[ids], np.repeat(np.arange(n), count)
            keep = keep & (np.bincount(doc, lengths, n).astype(np.int64) == np.diff(off))
            sides.append((side, ids, count, lengths, doc))
        for side, ids, _, lengths, doc in sides:  # whether the tokens' bytes are the text's
            use, size = keep[doc], np.where(keep, np.diff(off), 0)
            own = text if keep.all() else text[np.repeat(keep, np.diff(off))]
            wrong = np.flatnonzero(side.joined(ids[use], lengths[use]) != own)
            if len(wrong):
                keep = keep.copy()
                keep[np.searchsorted(np.cumsum(size), wrong, side="right")] = False
        (self.a, self.n_a, a_lengths), (self.b, self.n_b, b_lengths) = ((ids[keep[doc]], np.where(keep, count, 0), lengths[keep[doc]]) for _, ids, count, lengths, doc in sides)
        self.n, self.keep = n, keep
        self.over_a, self.over_b, self.link_a, self.link_b = align(a_lengths, b_lengths)
        self.link_doc = np.repeat(np.arange(n), self.n_a)[self.link_a]
        self.n_links = np.bincount(self.link_doc, minlength=n)

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts' groups `a1,a2|b1;a3|b2` one after another, each text's with a final `;`, and where they end."""
        ends_a, ends_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        ends_a[self.link_a] = True
        ends_b[self.link_b] = True
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        in_a, in_b = np.bincount(group_a, minlength=len(self.link_a)), np.bincount(group_b, minlength=len(self.link_a))
        ids, sign = np.zeros(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        at_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(in_a)[group_b]
        ids[at_a], ids[at_b] = self.a, self.b
        sign[at_a[ends_a]], sign[at_b[ends_b]] = ord("|"), ord(";")
        flat, begin, n = _digits(1 << 16 if len(ids) == 0 or ids.max() < 1 << 16 else int(ids.max()) + 1)
        stop = np.cumsum(n[ids] + 1)
        out = flat[np.repeat(begin[ids] - (stop - n[ids] - 1), n[ids] + 1) + np.arange(int(stop[-1]) if len(stop) else 0)]
        out[stop - 1] = sign
        return out, np.concatenate(([0], stop))[np.cumsum(self.n_a + self.n_b)]


def _encoders(a: str, b: str) -> tuple[Tokens, Tokens]:
    return tokens(ByteLevel, a), tokens(Pieces, b)


def aligned_documents(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """doc_id, a_ids, b_ids, overlaps and links of every document; overlaps and links are pairs of token indices, in byte order.

    Null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have empty lists.
    """

    def run(batches):
        import pyarrow as pa

        a, b = _encoders(tokenizer_a, tokenizer_b)
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                x = Aligned(batch.column(1).slice(i, j - i), a, b)
                base_a, base_b = np.cumsum(x.n_a) - x.n_a, np.cumsum(x.n_b) - x.n_b
                over_doc = np.repeat(np.arange(x.n), x.n_a)[x.over_a]

                def lists(values, count):
                    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), values)

                def pairs(p, q, doc):
                    values = pa.StructArray.from_arrays([pa.array(p - base_a[doc], pa.int32()), pa.array(q - base_b[doc], pa.int32())], names=["a", "b"])
                    return lists(values, np.bincount(doc, minlength=x.n))

                cols = [batch.column(0).slice(i, j - i), lists(pa.array(x.a.astype(np.int32)), x.n_a), lists(pa.array(x.b.astype(np.int32)), x.n_b), pairs(x.over_a, x.over_b, over_doc), pairs(x.link_a, x.link_b, x.link_doc)]
                yield pa.record_batch(cols, names=["doc_id", "a_ids", "b_ids", "overlaps", "links"])

    pair = "array<struct<a: int, b: int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, a_ids array<int>, b_ids array<int>, overlaps {pair}, links {pair}")


def _numbers(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed numbers of a binary column one after another, and the rows' n+1 offsets in them."""
    import pyarrow as pa

    data, off = string_bytes(column.cast(pa.large_binary()).view(pa.large_string()))
    return np.frombuffer(data, kind), off // np.dtype(kind).itemsize


def _added(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, where, np.concatenate(times))
    return key, total


def link_statistics(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, lookup_pairs: int = LOOKUP_PAIRS) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link's count is how often its id pair is linked in the whole corpus; it is best if no pair of the same b id has a
    higher one. Null and empty texts and texts that aren't given back byte for byte have zeros and ''; null ids stay null;
    repeated rows count as often as they are there; ties are all best; other columns are not read; an empty table gives no row.
    """
    spark = docs.sparkSession
    a_size, b_size = (x.size for x in _encoders(tokenizer_a, tokenizer_b))
    product = a_size * b_size
    kind = "<u4" if product <= 1 << 32 else "<u8"

    def encoded(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        a, b = _encoders(tokenizer_a, tokenizer_b)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                x = Aligned(batch.column(1).slice(i, j - i), a, b)
                pair = x.link_doc.astype(np.uint64) * np.uint64(product) + x.a[x.link_a].astype(np.uint64) * np.uint64(b_size) + x.b[x.link_b].astype(np.uint64)
                pair, times = np.unique(pair, return_counts=True)
                stop = np.searchsorted(pair, np.arange(1, x.n + 1, dtype=np.uint64) * np.uint64(product)).tolist()
                pair, times = (pair % np.uint64(product)).astype(kind), times.astype("<u4")
                text, ends = x.strings()
                begins = np.concatenate(([0], ends[:-1]))
                sha = [hashlib.sha256(text[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(begins.tolist(), ends.tolist(), strict=True)]
                packed = [pa.array([v[p:q].tobytes() for p, q in zip([0, *stop], stop, strict=False)], pa.binary()) for v in (pair, times)]
                counts = [pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, x.n_links, x.n_links)]
                yield pa.record_batch([pa.array(row + np.arange(x.n)), batch.column(0).slice(i, j - i), *counts, pa.array(sha, pa.string()), *packed], names=[c.split()[0] for c in _DOCUMENT.split(", ")])
                row += x.n

    def counted(batches):
        import pyarrow as pa

        pairs, times, held = [], [], 0

        def flush():
            key, total = _added(pairs, times)
            return pa.record_batch([pa.array(key.astype(np.int64)), pa.array(total)], names=["pair", "n"])

        for batch in batches:
            p, t = _numbers(batch.column(0), kind)[0], _numbers(batch.column(1), "<u4")[0]
            pairs.append(p)
            times.append(t.astype(np.int64))
            held += len(p)
            if held >= GATHERED:
                if (key := _added(pairs, times))[0].size * 2 > GATHERED:
                    yield flush()
                    pairs, times, held = [], [], 0
                else:
                    pairs, times, held = [key[0]], [key[1]], len(key[0])
        if pairs:
            yield flush()

    kept = stash_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encoded, _DOCUMENT, "aligned")
    counts = stash(kept.select("pairs", "times").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.col("pair") % b_size
    best = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    table = counts.withColumn("b", b_id).join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    named = kept.drop("pairs", "times", "row")
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() <= lookup_pairs:
        known = table.toArrow()
        key, n, top = (known.column(k).to_numpy() for k in range(3))
        by = np.argsort(key)
        shared = spark.sparkContext.broadcast((key[by].astype(kind), n[by], top[by]))

        def looked_up(batches):
            import pyarrow as pa

            key, n, top = shared.value
            for batch in batches:
                (pairs, off), times = _numbers(batch.column(0), kind), _numbers(batch.column(1), "<u4")[0].astype(np.int64)
                at = np.searchsorted(key, pairs)
                sums = [np.concatenate(([0], np.cumsum(times * (v[at] if len(v) else 0), dtype=np.int64))) for v in (n, top)]
                yield pa.record_batch([*batch.columns[2:], *(pa.array(s[off[1:]] - s[off[:-1]]) for s in sums)], names=[*batch.schema.names[2:], "count_sum", "n_best"])

        schema = ", ".join(f"{c} {t}" for c, t in named.dtypes) + ", count_sum long, n_best long"
        return kept.select("pairs", "times", *named.columns).mapInArrow(looked_up, schema).select(*order)

    def opened(batches):
        import pyarrow as pa

        for batch in batches:
            (pairs, off), times = _numbers(batch.column(1), kind), _numbers(batch.column(2), "<u4")[0]
            rows = np.repeat(batch.column(0).to_numpy(), np.diff(off))
            yield pa.record_batch([pa.array(rows), pa.array(pairs.astype(np.int64)), pa.array(times.astype(np.int64))], names=["row", "pair", "t"])

    links = kept.select("row", "pairs", "times").mapInArrow(opened, "row long, pair long, t long").join(table, "pair")
    sums = links.groupBy("row").agg(F.sum(F.col("t") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"))
    return kept.drop("pairs", "times").join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("count_sum", "n_best")}).select(*order)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between byte-level BPE (A) and sentencepiece BPE (B) tokens of all documents."""
    return link_statistics(documents(spark, sf_dir))
