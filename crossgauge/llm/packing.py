"""Best-fit packing into fixed-length training sequences, planned on the histogram of lengths.

Items longer than a third of the capacity are matched greedily, at most two to a sequence; shorter ones go, longest
first, into the tightest gap that holds them. All items of one length are alike, so the plan needs only how many
there are of each length (at most `capacity` numbers): it is exact best fit, yet its cost does not depend on the
corpus. The plan is a list of runs (length, ranks, sequences, offset); pieces then find their place by rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.llm.common import documents, fresh, stash_map
from crossgauge.llm.tokens import TOKENIZER, encoder

CAPACITY = 2048
END_ID = 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset): rank r of the length goes to sequence first + r - first rank."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, how many)]
    order: list[int] = []
    made = 0

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], count, sequence, offset))
        used[length] += count
        left[length] -= count

    def bins(gap: int, first: int, count: int) -> None:
        if count and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, count))

    def opened(count: int) -> int:
        nonlocal made
        made += count
        return made - count

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect_left(large, capacity - a + 1) - 1
            while at >= 0 and (not left[large[at]] or (large[at] == a and left[a] < 2)):
                at -= 1
            if at < 0:
                n = left[a]
                first = opened(n)
                put(a, n, first, 0)
                bins(capacity - a, first, n)
                break
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            first = opened(n)
            put(a, n, first, 0)
            put(b, n, first, a)
            bins(capacity - a - b, first, n)
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at == len(order):
                n = -(-left[s] // (capacity // s))
                bins(capacity, opened(n), n)
                at = bisect_left(order, s)
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // s
            full = min(n, left[s] // each)
            for j in range(each if full else 0):
                put(s, full, first, capacity - gap + j * s)
            bins(gap - each * s, first, full)
            rest = left[s] if full < n else 0
            for j in range(min(rest, each - 1)):
                put(s, 1, first + full, capacity - gap + j * s)
            if full < n:
                taken = min(rest, each - 1)
                bins(gap - taken * s, first + full, 1)
                bins(gap, first + full + 1, n - full - 1)
    return runs


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """A written table of doc_id, piece, start, length, ids_crc32, row: each document's ids and the end id; only longer ones are cut, the first piece takes the rest.

    Null text counts as empty: one piece that is the end id. Null ids stay null, repeated rows are documents of their own,
    other columns are not read, an empty table gives no row. row: a number that no other piece has.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, made = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            doc_ids = batch.column(0).to_pylist()
            for row, ids in enc.batches(batch.column(1)):
                doc_id, ids = doc_ids[row], np.append(ids, np.array([END_ID], enc.dtype)).astype("<u4")
                start, n, k = 0, len(ids) % capacity or capacity, 0
                while start < len(ids):
                    for col, x in zip(out, (doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())), strict=True):
                        col.append(x)
                    start, n, k = start + n, capacity, k + 1
            cols = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.record_batch([*cols, pa.array(made + np.arange(len(out[0])))], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])
            made += len(out[0])

    return stash_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long", "pieces")


def best_fit_pack(items: DataFrame, length: str = "length", row: str | None = None, capacity: int = CAPACITY, rows_per_bucket: int = 200_000) -> DataFrame:
    """items with sequence_id and offset; lengths are 1 to capacity. Items are read three times: pass a stored table.

    row: a column that tells rows apart, by which they are dealt; without one, equal rows meet in one bucket. Equal rows
    are items of their own. Columns may have any names but sequence_id and offset.
    """
    counts = {r[0]: r[1] for r in items.groupBy(length).count().collect()}  # at most `capacity` rows
    runs = sorted(plan(counts, capacity))
    cols = [np.array(c, np.int64) for c in zip(*runs, strict=True)] or [np.zeros(0, np.int64)] * 5
    keys = (cols[0] << 44) + cols[1]

    # ranks: rows are numbered inside (length, bucket); a bucket's base is the running count of the buckets before it
    buckets = max(8, sum(counts.values()) // rows_per_bucket)
    own = [row] if row else items.columns
    bucket, n, base_, rank_ = (fresh(items, f"_{x}") for x in ("bucket", "n", "base", "rank"))
    dealt = items.withColumn(bucket, F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int"))
    base = dealt.groupBy(length, bucket).agg(F.count("*").alias(n))
    base = base.withColumn(base_, F.coalesce(F.sum(n).over(W.partitionBy(length).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(W.partitionBy(length, bucket).orderBy(*own)) - 1
    ranked = dealt.withColumn(rank_, rank).join(base.select(length, bucket, base_), [length, bucket])

    def place(batches):
        import pyarrow as pa

        for b in batches:
            n, r = (b.column(i).to_numpy() for i in range(2))
            at = np.searchsorted(keys, (n << 44) + r, side="right") - 1
            yield pa.record_batch([*b.columns[2:], pa.array(cols[3][at] + r - cols[1][at]), pa.array(cols[4][at])], names=[*b.schema.names[2:], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", sequence_id long, offset long"
    placed = ranked.select(F.col(length).cast("long").alias(n), (F.col(base_) + F.col(rank_)).cast("long").alias(rank_), *[F.col(f"`{c}`") for c in items.columns])
    return placed.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return best_fit_pack(pieces(docs, tokenizer, capacity), row="row", capacity=capacity).drop("row")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 ids as best fit needs."""
    return pack_documents(documents(spark, sf_dir))
