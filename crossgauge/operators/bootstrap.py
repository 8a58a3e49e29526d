"""Bootstrap intervals and verdicts.

A metric that depends on counts only - a confusion table, the sizes of clusters - is resampled on those counts: rows of a
cell are alike, so a draw is a multinomial over the cells. `resampled` splits it without touching a row: a draw's n points
lie in [0, 2**32); how many of the m points of an interval fall into its left half is binomial, and halving goes on along
the path of every cell's boundary. A binomial of m points is a sum over m's binary digits, each looked up in the exact
integer distribution of 2**k fair coins by a hash of draw and interval. Any engine can repeat it; a draw costs some
32 * log2(n) look-ups for each cell, whatever n is. `count_bootstrap` takes numpy's multinomial.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType


MASK = (1 << 32) - 1
#: Odd multipliers of a 32-bit mixer; with them no product leaves a signed 64-bit number.
MIX, STEP, DIGIT = 0x45D9F3B, 0x9E3779B, 0x1B873593
#: Halvings of the points' range, and draws that a task makes at once.
LEVELS, DRAWS = 32, 250


def mixed(x):
    """Two rounds of xor-shift and multiply of a numpy array, modulo 2**32."""
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MIX) & MASK
    return x ^ (x >> 16)


@lru_cache(maxsize=None)
def fair_coins(k: int) -> tuple[int, tuple[int, ...]]:
    """(first, table) of 2**k fair coins: with u below 2**32, heads are first + how many entries are at most u.

    Entry j is floor(2**32 * P(heads <= first + j)), from exact ratios of neighbouring probabilities; 10 deviations on
    either side hold all that 32 bits can tell.
    """
    n = 1 << k
    low, high = max(0, n // 2 - 5 * int(n**0.5) - 5), min(n, n // 2 + 5 * int(n**0.5) + 5)
    with localcontext() as c:
        c.prec = 60
        weight, total, weights = Decimal(1), Decimal(0), []
        for i in range(low, high + 1):
            weights.append(weight)
            total += weight
            weight = weight * (n - i) / (i + 1)
        at, table = Decimal(0), []
        for w in weights:
            at += w
            table.append(int(at / total * (1 << 32)))
    first = sum(x == 0 for x in table)
    return low + first, tuple(x for x in table if 0 < x < 1 << 32)


def heads(m, x):
    """How many of m points (numpy array) fall into the left half; x: the hash of draw and interval."""
    import numpy as np

    out = np.zeros_like(m)
    for k in range(int(m.max()).bit_length() if m.size else 0):
        use = np.flatnonzero((m >> k) & 1)
        first, table = fair_coins(k)
        out[use] += first + np.searchsorted(np.array(table, np.int64), mixed((x[use] + (k + 1) * DIGIT) & MASK), side="right")
    return out


def multinomial(counts: list[int], draws):
    """A row for each draw (numpy array of numbers from 0): how many of sum(counts) rows, drawn with replacement, fall into each cell."""
    import numpy as np

    upto = np.cumsum(np.array(counts, np.int64))
    total = int(upto[-1])
    bound = np.array([(int(u) << LEVELS) // total for u in upto[:-1]], np.int64)
    shape = (len(draws), len(bound))
    h = np.broadcast_to(mixed(draws + 1)[:, None], shape).ravel()
    bound = np.broadcast_to(bound, shape).ravel()
    m, below, node = np.full(h.size, total), np.zeros(h.size, np.int64), np.ones(h.size, np.int64)
    live = np.arange(h.size)
    for level in range(LEVELS):
        live = live[m[live] > 0]
        if not len(live):
            break
        x = heads(m[live], mixed((h[live] + node[live] * STEP) & MASK))
        right = (bound[live] >> (LEVELS - 1 - level)) & 1
        below[live] += right * x
        m[live] = np.where(right == 1, m[live] - x, x)
        node[live] = 2 * node[live] + right
    edges = np.concatenate((np.zeros((len(draws), 1), np.int64), below.reshape(shape), np.full((len(draws), 1), total)), axis=1)
    return np.diff(edges, axis=1)


def resampled(cells: DataFrame, keys: list[str], cell: list[str], n: str, n_boot: int) -> DataFrame:
    """keys, b, cell columns, m: how many of a key's rows draw b (0 to n_boot - 1) takes from each of its cells.

    cells: (keys, cell, n), a key's cells in one row of memory; n of a key below 2**31. Cells with n = 0 draw nothing;
    null keys and cells are values. Columns of one cell stay together, so paired metrics stay paired.
    """
    held = cells.where(F.col(n) > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cell, F.col(n).cast("long").alias(n)))).alias("_c"))
    jobs = held.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long"), F.lit(DRAWS).cast("long"))))
    jobs = jobs.repartition(cells.sparkSession.sparkContext.defaultParallelism, *keys, "_from")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists, begins = batch.column("_c"), batch.column("_from").to_pylist()
            for row, begin in enumerate(begins):
                b = np.arange(begin, min(begin + DRAWS, n_boot))
                drawn = multinomial(lists[row].values.field(n).to_pylist(), b)
                same = batch.take(pa.array(np.full(len(b), row)))
                at = pa.array(np.arange(len(b) + 1) * drawn.shape[1], pa.int32())
                yield pa.record_batch([*(same.column(k) for k in keys), same.column("_c"), pa.array(b), pa.ListArray.from_arrays(at, pa.array(drawn.ravel()))], names=[*keys, "_c", "b", "_m"])

    kinds = StructType([*[held.schema[k] for k in keys], held.schema["_c"]]).add("b", LongType()).add("_m", ArrayType(LongType()))
    drawn = jobs.mapInArrow(run, kinds)
    rows = drawn.select(*keys, "b", "_m", F.posexplode("_c").alias("_k", "_cell"))
    return rows.select(*keys, "b", *[F.col(f"_cell.{c}").alias(c) for c in cell], F.get("_m", F.col("_k")).alias("m"))


def interval(draws: DataFrame, keys: list[str], value: str, ci: float = 0.95) -> DataFrame:
    lo = (1 - ci) / 2
    q = draws.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(lo), F.lit(1 - lo))).alias("q"))
    return q.select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def count_bootstrap(counts: DataFrame, keys: list[str], cell: str, n: str, share_of: str, n_boot: int, seed: int = 0, ci: float = 0.95) -> DataFrame:
    """Interval of one cell's share when the counted items are resampled; one small pandas group per key."""
    out = StructType([*[counts.schema[k] for k in keys], StructField("share", DoubleType()), StructField("low", DoubleType()), StructField("high", DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(cell)
        total = int(pdf[n].sum())
        drawn = np.random.default_rng(seed).multinomial(total, pdf[n] / total, n_boot)
        share = drawn[:, (pdf[cell] == share_of).to_numpy()].sum(1) / total
        lo, hi = np.quantile(share, [(1 - ci) / 2, (1 + ci) / 2])
        return pd.DataFrame([[*pdf[keys].iloc[0], float(pdf.loc[pdf[cell] == share_of, n].sum() / total), float(lo), float(hi)]], columns=out.names)

    return counts.groupBy(*keys).applyInPandas(run, out)


def separated(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Touching intervals overlap."""
    return (a_high < b_low) | (b_high < a_low)


def verdict(df: DataFrame, keys: list[str], sep: str, diff: str, axis: str) -> DataFrame:
    """within noise, <axis>s disagree, held, or one <axis> only, over a measure's replicates."""
    s = F.col(sep)
    v = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(s).alias("_s"), F.count_distinct(F.when(s, F.col(diff) > 0)).alias("_signs"))
    text = F.when(F.col("_s") == 0, "within noise").when(F.col("_signs") > 1, f"{axis}s disagree").when(F.col("_s") == F.col("_n"), "held").otherwise(f"one {axis} only")
    return v.withColumn("verdict", text).drop("_n", "_s", "_signs")


def exceeds_noise(delta: Column, std_a: Column, std_b: Column) -> Column:
    return F.abs(delta) > F.hypot(std_a, std_b)
