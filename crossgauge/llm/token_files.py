"""Token files in Re-Pair form: per shard the frequent id pairs become nonterminals, again and again; documents stay addressable.

A shard's blob, little-endian: magic "RPR2", then u32 counts of documents, rules and symbols, the first nonterminal, and
how many documents have no id (they come first), then doc ids (i64), ids per document (u32), symbols per document
(u32), ids per rule (u32), and the rules' pairs and the symbols, packed with as many bits as the largest symbol needs.
No rule spans two documents, so a document is read by
expanding its own symbols only. Shards are rows of a Parquet table in the shared folder, made of the files of tasks
that ended well: a lost or repeated task leaves no half-written shard in it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.llm.common import documents, stash_map
from crossgauge.llm.tokens import TOKENIZER, encoder

END_ID = 0
SHARD_IDS = 1 << 20
#: A job that only encodes can keep a larger table of words in its workers: 2**22 slots of 14 bytes.
SLOT_BITS = 22
#: Pairs replaced between two counts of all pairs; rounds go on until no pair is seen FEWEST times in the shard, where a rule stops paying.
PAIRS_A_ROUND = 8192
FEWEST = 8
#: Uses at which a rule makes up for its own pair and length.
PAYS = 5
_SLOTS = 1 << 18
MAGIC = b"RPR2"


def _slots(key: np.ndarray) -> np.ndarray:
    if key.dtype == np.uint32:
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int64)
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def _frequent(key: np.ndarray, slot: np.ndarray, most: int) -> np.ndarray:
    """At most `most` of the pairs seen FEWEST times or more, the most frequent ones, exactly counted; hashed counts only rule out slots that can't hold one."""
    if len(key) > _SLOTS // 4:
        heavy = np.bincount(slot, minlength=_SLOTS)
        key = key[(heavy >= max(FEWEST, int(np.partition(heavy, -2 * most)[-2 * most])))[slot]]
    found, n = np.unique(key, return_counts=True)
    use = (n >= FEWEST) & (found != np.iinfo(key.dtype).max)
    found, n = found[use], n[use]
    return np.sort(found[np.lexsort((found, -n))[:most]])


def compress(ids: np.ndarray, lengths: np.ndarray, first: int, pairs: int = PAIRS_A_ROUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols per document, rules): rule r, named first + r, stands for the two symbols rules[r].

    When no pair is frequent, rules that don't pay are written out; pairs that this makes frequent are replaced in turn,
    and what nothing uses then goes.
    """
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    seq, last, rules = replaced(ids, last, np.zeros((0, 2), np.int64), first, pairs)
    seq, last, rules = replaced(*pruned(seq, last, rules, first, PAYS), first, pairs)
    seq, last, rules = pruned(seq, last, rules, first, 1)
    ends = np.flatnonzero(last) + 1
    return seq, np.diff(np.concatenate(([0], ends))), rules.astype(np.uint32)


def replaced(seq: np.ndarray, last: np.ndarray, rules: np.ndarray, first: int, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, the documents' last symbols and rules after rounds of replacing frequent pairs, until there are none.

    Once a round changes little, the next ones count only the pairs beside the new symbols, where alone pairs become more
    frequent; when that finds nothing more, all pairs are counted again.
    """
    kind, bits = (np.uint32, 16) if first + len(rules) < (1 << 16) - 1 else (np.uint64, 32)  # a pair is one number: both symbols' bits; all ones is no pair
    seq, known = seq.astype(kind), (rules[:, 0].astype(kind) << kind(bits)) | rules[:, 1].astype(kind)
    names = np.argsort(known)  # the rules' pairs, sorted, and their numbers
    known = known[names]
    near: np.ndarray | None = None  # places of the pairs to count; None: all
    while len(seq) > 1:
        if near is None:
            key = (seq[:-1] << kind(bits)) | seq[1:]
            key[last[:-1]] = np.iinfo(kind).max
        else:
            key = (seq[near] << kind(bits)) | seq[near + 1]
            key[last[near]] = np.iinfo(kind).max
        slot = _slots(key)
        top = _frequent(key, slot, pairs)
        if not len(top):
            if near is None:
                break
            near = None
            continue
        there = known[np.minimum(np.searchsorted(known, top), len(known) - 1)] == top if len(known) else np.zeros(len(top), bool)
        new = top[~there]  # a pair that overlaps kept back keeps its rule
        if bits == 16 and first + len(known) + len(new) >= (1 << 16) - 1:  # symbols outgrow 16 bits: count again with more
            known = (known.astype(np.uint64) >> np.uint64(16) << np.uint64(32)) | (known.astype(np.uint64) & np.uint64(0xFFFF))
            kind, bits, seq = np.uint64, 32, seq.astype(np.uint64)
            continue
        known = np.concatenate((known, new))
        names = np.concatenate((names, len(names) + np.arange(len(new))))
        order = np.argsort(known)
        known, names = known[order], names[order]
        name = names[np.searchsorted(known, top)]
        table = np.full(_SLOTS, -1, np.int64)
        table[_slots(top)] = np.arange(len(top))  # of two pairs in a slot one waits for the next round
        at = table[slot]
        hit = np.flatnonzero(at >= 0)
        hit = hit[top[at[hit]] == key[hit]]
        at = at[hit]
        where = hit if near is None else near[hit]
        # of hits that overlap, every other one counts, from the left of each run
        run = np.concatenate(([True], np.diff(where) > 1))
        begin = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
        use = (np.arange(len(where)) - begin) % 2 == 0
        where, at = where[use], at[use]
        seq[where] = (first + name[at]).astype(kind)
        last[where] = last[where + 1]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq, last = seq[keep], last[keep]
        made = where - np.arange(len(where))  # where the new symbols are now
        near = None
        if 8 * len(made) < len(seq):
            beside = np.zeros(len(seq), bool)
            beside[made] = True
            beside[np.maximum(made - 1, 0)] = True
            near = np.flatnonzero(beside[:-1])
    rules = np.zeros((len(known), 2), np.int64)
    rules[names] = np.stack([known >> kind(bits), known & kind((1 << bits) - 1)], 1)
    return seq.astype(np.int64), last, rules


def pruned(seq: np.ndarray, last: np.ndarray, rules: np.ndarray, first: int, pays: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same without rules that have under `pays` uses, none in a rule: they are written out, and go.

    All pairs of a round come from one count, so a pair that another one broke up may end with few uses or none.
    """
    n, live = len(rules), np.ones(len(rules), bool)
    while n:
        in_rules = np.bincount(rules[live].ravel(), minlength=first + n)[first:]
        in_seq = np.bincount(seq, minlength=first + n)[first:]
        gone = live & (in_rules == 0) & (in_seq < pays)
        if not gone.any():
            break
        live &= ~gone
        at = np.flatnonzero(seq >= first)
        at = at[gone[seq[at] - first]]
        if len(at):
            count = np.ones(len(seq), np.int64)
            count[at] = 2
            left = at + np.arange(len(at))
            pair = rules[seq[at] - first]
            ended = last[at]
            seq, last = np.repeat(seq, count), np.repeat(last, count)
            seq[left], seq[left + 1] = pair.T
            last[left], last[left + 1] = False, ended
    name = np.concatenate((np.arange(first), first + np.cumsum(live) - 1))
    return name[seq], last, name[rules[live]]


def _pack(values: np.ndarray, bits: int) -> bytes:
    """Numbers below 2**32 as so many bits each, lowest first, one after another."""
    each = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(each).tobytes()


def _unpack(blob: np.ndarray, begin: int, n: int, bits: int) -> np.ndarray:
    """n numbers from the begin-th on, of the bytes of _pack."""
    low, high = begin * bits // 8, -(-(begin + n) * bits // 8)
    each = np.zeros((n, 32), np.uint8)
    each[:, :bits] = np.unpackbits(blob[low:high])[begin * bits - 8 * low :][: n * bits].reshape(n, bits)
    return np.packbits(each, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)


def encode_shard(doc_ids, ids: np.ndarray, lengths: np.ndarray, first: int, pairs: int = PAIRS_A_ROUND) -> bytes:
    """doc_ids: ascending, None first."""
    seq, per_doc, rules = compress(ids, lengths, first, pairs)
    size = np.ones(first + len(rules), np.uint32)
    for r, (a, b) in enumerate(rules.tolist()):
        size[first + r] = size[a] + size[b]
    bits = (first + len(rules) - 1).bit_length()
    unnamed = sum(x is None for x in doc_ids)
    return b"".join((
        MAGIC, struct.pack("<5I", len(lengths), len(rules), len(seq), first, unnamed), np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
        lengths.astype("<u4").tobytes(), per_doc.astype("<u4").tobytes(), size[first:].astype("<u4").tobytes(), _pack(rules.ravel(), bits), _pack(seq.astype(np.uint32), bits),
    ))


class Shard:
    """A shard's blob, decoded as a whole or one document at a time."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token shard")
        docs, rules, self.n_symbols, self.first, unnamed = struct.unpack_from("<5I", blob, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        ids = take("<i8", docs).tolist()
        self.doc_ids = [None] * unnamed + ids[unnamed:]
        self.lengths, self.per_doc = take("<u4", docs).astype(np.int64), take("<u4", docs).astype(np.int64)
        self.begin = np.cumsum(self.per_doc) - self.per_doc
        self.sizes = take("<u4", rules).astype(np.int64)
        self.bits = (self.first + rules - 1).bit_length()
        self.rules = _unpack(take("u1", -(-2 * rules * self.bits // 8)), 0, 2 * rules, self.bits).reshape(-1, 2)
        self.packed = take("u1", -(-self.n_symbols * self.bits // 8))

    def symbols(self, begin: int = 0, n: int | None = None) -> np.ndarray:
        return _unpack(self.packed, begin, self.n_symbols - begin if n is None else n, self.bits)

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for: all rules in them are opened once a round, at places that the expansion lengths give."""
        total = np.ones(len(seq), np.int64)
        rule = seq >= self.first
        total[rule] = self.sizes[seq[rule] - self.first]
        out = np.zeros(int(total.sum()), "<u4")
        place = np.cumsum(total) - total
        while True:
            out[place[~rule]] = seq[~rule]
            if not rule.any():
                return out
            seq, place = seq[rule] - self.first, place[rule]
            left, right = self.rules[seq].T
            step = np.ones(len(left), np.int64)
            deep = left >= self.first
            step[deep] = self.sizes[left[deep] - self.first]
            seq, place = np.concatenate((left, right)), np.concatenate((place, place + step))
            rule = seq >= self.first

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, from its own symbols only."""
        return self.expand(self.symbols(int(self.begin[k]), int(self.per_doc[k])))


def write_token_files(docs: DataFrame, tokenizer: str = TOKENIZER, shard_ids: int = SHARD_IDS, pairs: int = PAIRS_A_ROUND) -> DataFrame:
    """Encode every text, append the end id, write shards in ascending doc_id order; returns the table of shards.

    Null text counts as empty; documents without an id come first. A shard holds at least one document and is closed once it has shard_ids ids.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, n_shard = encoder(tokenizer, SLOT_BITS), TaskContext.get().partitionId(), 0
        first = enc.tokenizer.get_vocab_size()
        kept: tuple[list, list] = ([], [])
        total = 0

        def shut():
            nonlocal n_shard, total, kept
            lengths = np.array([len(x) for x in kept[1]], np.int64)
            blob = encode_shard(kept[0], np.concatenate(kept[1]), lengths, first, pairs)
            out = pa.record_batch([pa.array([part], pa.int32()), pa.array([n_shard], pa.int32()), pa.array([int(lengths.sum())]), pa.array([blob], pa.binary())], names=["part", "shard", "n_ids", "blob"])
            n_shard, total, kept = n_shard + 1, 0, ([], [])
            return out

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, ids in enc.batches(batch.column(1)):
                kept[0].append(doc_ids[row])
                kept[1].append(np.append(ids, np.array([END_ID], enc.dtype)))
                total += len(kept[1][-1])
                if total >= shard_ids:
                    yield shut()
        if kept[0]:
            yield shut()

    key = F.xxhash64("text").alias("h")  # rows with one id, or none, part by their texts
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return stash_map(ordered, run, "part int, shard int, n_ids long, blob binary", "token-shards")


def read_token_files(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, shard, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = Shard(blob)
                ids, ends = s.expand(s.symbols()), np.cumsum(s.lengths)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), s.lengths.tolist(), strict=True)]
                where = [pa.array(np.full(len(ends), x, np.int32)) for x in (part, shard)]
                yield pa.record_batch([*where, pa.array(s.doc_ids, pa.int64()), pa.array(ends - s.lengths), pa.array(s.lengths), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    within = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("shard_base")).join(parts, "part")
    rows = shards.select("part", "shard", "blob").mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    start = (F.col("part_base") + F.col("shard_base") + F.col("at")).alias("start")
    return rows.join(bases, ["part", "shard"]).select("doc_id", start, "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    return read_token_files(write_token_files(documents(spark, sf_dir)))
