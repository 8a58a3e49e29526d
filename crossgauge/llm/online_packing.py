"""Bounded-space online packing: a fixed number of open windows in every partition, best fit, leftovers merged in a tree.

A document's ids go where the least room is left over. When no open window holds them the fullest one is emitted: the
head of the document fills its gap, unless the gap is under `least_cut` ids, which are padded then. What stays open at a
partition's end travels with its ids, a bounded amount for each partition, to tasks of about a million ids that pack it
in the same way, until one task is left. That one cuts freely: its last ids go into sequences that need no padding,
their lengths powers of two.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgauge.llm.common import chunks, documents, stash_map, string_bytes
from crossgauge.llm.segments import Folded, segments

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 2
#: Windows that a task keeps open.
WINDOWS = 32
#: A shorter gap of a window that is emitted is padded, not filled with a scrap of a document.
LEAST_CUT = 16
#: Leftover ids that one task merges.
IDS_A_TASK = 1 << 22

_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


@dataclass
class Packer:
    """put() pieces, then flush(): sequences gather in `done`, at most `windows` stay open."""

    capacity: int = CAPACITY
    windows: int = WINDOWS
    least_cut: int = LEAST_CUT
    done: list[list[Piece]] = field(default_factory=list)
    gaps: list[tuple[int, int]] = field(default_factory=list)  # (room, number) of every open window, ascending
    held: dict[int, list[Piece]] = field(default_factory=dict)
    made: int = 0

    def _place(self, at: int, piece: Piece) -> None:
        """Into the at-th of the open windows."""
        room, number = self.gaps.pop(at)
        self.held[number].append(piece)
        if room == len(piece.ids):
            self.done.append(self.held.pop(number))
        else:
            insort(self.gaps, (room - len(piece.ids), number))

    def put(self, piece: Piece) -> None:
        while len(piece.ids) >= self.capacity:
            head, piece = piece.split(self.capacity)
            self.done.append([head])
        while len(piece.ids):
            at = bisect_left(self.gaps, (len(piece.ids), -1))
            if at < len(self.gaps):
                return self._place(at, Piece(piece.doc_id, piece.start, piece.ids.copy(), piece.doc_tokens))
            if len(self.gaps) == self.windows:  # none holds it: the fullest one is emitted
                room = self.gaps[0][0]
                if room >= self.least_cut:
                    head, piece = piece.split(room)
                    self._place(0, head)
                else:
                    self.done.append(self.held.pop(self.gaps.pop(0)[1]))
            else:
                self.held[self.made] = []
                insort(self.gaps, (self.capacity, self.made))
                self.made += 1

    def left(self) -> list[list[Piece]]:
        """The open windows, fullest first; the packer is empty then."""
        out = [self.held[number] for _, number in self.gaps]
        self.gaps, self.held = [], {}
        return out

    def flush(self) -> None:
        """Merge the open windows: the emptiest fill the others' gaps, the last ids go into powers of two."""
        open_ = self.left()
        while len(open_) > 1:
            first = open_.pop(0)
            room = self.capacity - sum(len(p.ids) for p in first)
            while room and open_:
                piece = open_[-1].pop()
                if len(piece.ids) > room:
                    piece, rest = piece.split(room)
                    open_[-1].append(rest)
                first.append(piece)
                room -= len(piece.ids)
                if not open_[-1]:
                    open_.pop()
            if room:
                open_.append(first)
                break
            self.done.append(first)
        for pieces in open_:
            total = sum(len(p.ids) for p in pieces)
            for bit in reversed(range(total.bit_length())):
                room, sequence = (1 << bit) & total, []
                while room:
                    piece = pieces.pop(0)
                    if len(piece.ids) > room:
                        piece, rest = piece.split(room)
                        pieces.insert(0, rest)
                    sequence.append(piece)
                    room -= len(piece.ids)
                if sequence:
                    self.done.append(sequence)


def _rows(sequences: list[list[Piece]], base: int, dtype, keep_ids: bool):
    """Record batch of the pieces; ids go along only with those of open windows."""
    import pyarrow as pa

    out: tuple[list, ...] = tuple([] for _ in range(8))
    for k, sequence in enumerate(sequences):
        at = 0
        for p in sequence:
            raw = p.ids.astype("<u4").tobytes()
            for col, x in zip(out, (p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, base + k, at, p.ids.astype(dtype).tobytes() if keep_ids else None), strict=True):
                col.append(x)
            at += len(p.ids)
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[*(c.split()[0] for c in _COLUMNS.split(", ")), "ids"])


def _number(round_: int, part: int) -> int:
    """The first sequence number of a task: 5 bits of round, 28 of task, 30 for its sequences."""
    return round_ << 58 | part << 30


def online_pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, windows: int = WINDOWS, least_cut: int = LEAST_CUT, end_id: int = END_ID, ids_a_task: int = IDS_A_TASK) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the end id. Null and empty texts are the end id alone; a null id stays null; repeated rows
    are documents of their own; other columns are not read; an empty table gives no row. Which document stands where
    depends on how the rows are dealt to tasks, so equal input may be packed differently.
    """

    def first(batches):
        from pyspark import TaskContext

        enc, packer, base = segments(Folded, tokenizer), Packer(capacity, windows, least_cut), _number(0, TaskContext.get().partitionId())
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, j in chunks(batch.column(1)):
                ids, count = enc.batch(*string_bytes(batch.column(1).slice(i, j - i)))
                stop = np.cumsum(count)
                for k, b, n in zip(range(i, j), (stop - count).tolist(), count.tolist(), strict=True):
                    packer.put(Piece(doc_ids[k], 0, np.append(ids[b : b + n], enc.dtype.type(end_id)), n + 1))
            yield _rows(packer.done, base, enc.dtype, False)
            base, packer.done = base + len(packer.done), []
        yield _rows(packer.left(), base, enc.dtype, True)

    def merge(round_: int, last: bool):
        def run(batches):
            from pyspark import TaskContext

            packer, base, dtype = Packer(capacity, windows, least_cut), _number(round_, TaskContext.get().partitionId()), segments(Folded, tokenizer).dtype
            pieces = [Piece(d, s, np.frombuffer(ids, dtype), n) for b in batches for d, s, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            for p in sorted(pieces, key=lambda p: -len(p.ids)):
                packer.put(p)
            if last:
                packer.flush()
            yield _rows(packer.done, base, dtype, False)
            if not last:
                yield _rows(packer.left(), base + len(packer.done), dtype, True)

        return run

    ids_a_task = max(ids_a_task, 4 * windows * capacity)  # each round leaves a quarter at most
    schema = f"{_COLUMNS}, ids binary"
    rounds = [stash_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), first, schema, "packed")]
    last = False
    while not last:
        left = rounds[-1].where("ids IS NOT NULL")
        total = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        tasks = max(1, -(-total // ids_a_task))
        last = tasks == 1
        deal = left.select("doc_id", "start", "doc_tokens", "ids", F.xxhash64("sequence_id").alias("w")).repartition(tasks, "w").drop("w") if not last else left.select("doc_id", "start", "doc_tokens", "ids").coalesce(1)
        rounds.append(stash_map(deal, merge(len(rounds), last), schema, "packed"))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    return out.where("ids IS NULL").drop("ids")


def op11_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return online_pack(documents(spark, sf_dir))
