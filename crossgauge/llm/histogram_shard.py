"""Sharding by histogram sort: splitters come from exact byte counts, refined until they meet a tolerance; then one exchange.

The key is (hash of the text, hash of the id): equal texts stand together and are parted only where a splitter
must fall inside a group. Each round counts exact bytes and rows below finer probes, only inside the cells that
hold a splitter; what reaches the driver is at most 256 sums for each splitter, whatever the input's size.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.llm.common import BROADCAST_IDS, documents, fresh, stash

#: Hex digits of the key added per round; the key has 32: 16 of the group's hash, then 16 of the row's.
STEP = 2
LONGEST = 32
BEYOND = "g"  # sorts after every key
#: Rows of a shard that are numbered together; one row of the broadcast table of offsets stands for so many.
ROWS_A_CELL = 100_000


def _after(cell: str) -> str:
    """The first prefix beyond a cell."""
    up = f"{int(cell, 16) + 1:0{len(cell)}x}"
    return BEYOND if len(up) > len(cell) else up


def splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[str]:
    """shards-1 key prefixes: a row's shard is the number of prefixes that are not above its key.

    A splitter is settled when the bytes below it are within tolerance * (total / shards) of the aim,
    or when its cell holds a single row.
    """
    total = keyed.agg(F.sum("_size")).first()[0] or 0
    slack = tolerance * total / shards
    aims = {k: total * k / shards for k in range(1, shards)}
    done: dict[int, str] = {}
    open_: dict[int, tuple[str, int]] = {k: ("", 0) for k in aims}  # splitter -> its cell, exact bytes below the cell
    for width in range(STEP, LONGEST + 1, STEP):
        if not open_:
            break
        rows = keyed.select("_size", F.substring("_key", 1, width).alias("cell"))
        if width > STEP:  # only cells that hold a splitter: at most shards-1 of them
            rows = rows.where(F.substring("cell", 1, width - STEP).isin(*{c for c, _ in open_.values()}))
        counted: dict[str, list] = {}
        for r in rows.groupBy("cell").agg(F.sum("_size").alias("b"), F.count("*").alias("n")).orderBy("cell").collect():
            counted.setdefault(r["cell"][:-STEP], []).append(r)
        for k, (cell, below) in list(open_.items()):
            inside = counted.get(cell, [])
            if not inside:  # an empty table
                done[k] = BEYOND
                del open_[k]
                continue
            for r in inside:
                if below + r["b"] > aims[k] or r is inside[-1]:
                    break
                below += r["b"]
            low, high = aims[k] - below, below + r["b"] - aims[k]
            if min(low, high) <= slack or r["n"] == 1 or width == LONGEST:
                done[k] = r["cell"] if low <= high else _after(r["cell"])
                del open_[k]
            else:
                open_[k] = (r["cell"], below)
    return [done[k] for k in sorted(done)]


def histogram_shard(df: DataFrame, group: Column, row: Column, size: Column, shards: int = 40, tolerance: float = 0.002, rows_a_cell: int = ROWS_A_CELL) -> DataFrame:
    """df's rows with shard (int, sizes near equal) and slot (long, gapless from 0 in each shard); df's own columns of these names give way.

    group: rows that should stand together; row: tells rows apart; size: bytes (null: 0). df is read several times: pass a
    stored table. Equal (group, row) pairs may part, nulls are values like others. An empty table gives an empty frame.
    """
    h1, h2, width, key, cell, n, base, rank = (fresh(df, f"_{x}") for x in ("h1", "h2", "size", "key", "cell", "n", "base", "rank"))
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    keyed = df.withColumns({h1: F.xxhash64(group), h2: F.xxhash64(row, group, F.lit(7)), width: F.coalesce(size, F.lit(0)).cast("long")})
    keyed = keyed.withColumn(key, F.concat(hexed(F.col(h1)), hexed(F.col(h2))))
    cuts = splitters(keyed.select(F.col(width).alias("_size"), F.col(key).alias("_key")), shards, tolerance)
    reached = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(key) >= c)) if cuts else F.lit(0)
    # slots: rows are numbered inside cells of a shard, dealt by the row's own hash so that a hot group falls into many; one table has the cells' offsets
    cells = max(1, -(-df.count() // (shards * rows_a_cell)))
    dealt = keyed.drop("shard", "slot").withColumns({"shard": reached.cast("int"), cell: F.pmod(F.col(h2), F.lit(cells)).cast("int")})
    offsets = dealt.groupBy("shard", cell).agg(F.count("*").alias(n))
    offsets = offsets.withColumn(base, F.coalesce(F.sum(n).over(W.partitionBy("shard").orderBy(cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = dealt.withColumn(rank, F.row_number().over(W.partitionBy("shard", cell).orderBy(key)) - 1)
    offsets = offsets.select("shard", cell, base)
    out = placed.join(F.broadcast(offsets) if shards * cells <= BROADCAST_IDS else offsets, ["shard", cell])  # at most shards * cells rows
    return out.select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", (F.col(base) + F.col(rank)).cast("long").alias("slot"))


def op8_histogram_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: shard sizes near equal. Null text: size 16, crc of nothing."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    docs = stash(docs, "shard-keys")
    out = histogram_shard(docs, F.col("text_key"), F.col("doc_id"), F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
