"""Joins, aggregations, windows, sets and samples as DataFrame -> DataFrame operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_languages(frames: dict[str, DataFrame], on: str = "item_id") -> DataFrame:
    """Inner join of one frame per language; other columns get the language as a suffix."""
    renamed = [f.select(on, *[F.col(c).alias(f"{c}_{k}") for c in f.columns if c != on]) for k, f in sorted(frames.items())]
    return reduce(lambda a, b: a.join(b, on, "inner"), renamed)


def completeness(df: DataFrame, needed: list[str]) -> DataFrame:
    """How many rows there are, and how many have a null or an empty string in a needed column."""
    lacks = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in needed])
    return df.agg(F.count("*").alias("joined"), F.count_if(lacks).alias("incomplete"))


def in_all(df: DataFrame, key: str, group: str, n: int) -> DataFrame:
    """Keys that occur in n groups."""
    return df.groupBy(key).agg(F.count_distinct(group).alias("_n")).where(F.col("_n") == n).select(key)


def presence(df: DataFrame, key: str, group: str, n: int, sample: int = 5) -> DataFrame:
    """Per group: its keys, how many are in all n groups, and up to `sample` of those that aren't."""
    marked = df.select(key, group).distinct().join(in_all(df, key, group, n).withColumn("_all", F.lit(True)), key, "left")
    ranked = marked.withColumn("_rank", F.when(F.col("_all").isNull(), F.row_number().over(W.partitionBy(group, "_all").orderBy(key))))
    few = F.array_sort(F.collect_list(F.when(F.col("_rank") <= sample, F.col(key))))
    return ranked.groupBy(group).agg(F.count("*").alias("n_keys"), F.count("_all").alias("n_shared"), few.alias("not_shared"))


def join_source_target(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source and target logs on (item, seed); the gold label must agree, see gold_conflicts."""
    s = source.select("item_id", "seed", "gold", F.col("pred").alias("pred_src"), F.col("condition_id").alias("src_condition_id"))
    t = target.select("item_id", "seed", F.col("gold").alias("gold_tgt"), F.col("pred").alias("pred_tgt"), F.col("condition_id").alias("tgt_condition_id"), "lang", "block_id")
    return s.join(t, ["item_id", "seed"], "inner")


def gold_conflicts(joined: DataFrame) -> DataFrame:
    return joined.where("gold <> gold_tgt")


def mismatch() -> Column:
    return (F.col("pred_src") == F.col("gold")) & (F.col("pred_tgt") != F.col("gold"))


def both_correct() -> Column:
    return (F.col("pred_src") == F.col("gold")) & (F.col("pred_tgt") == F.col("gold"))


#: Vectors of either side that one task holds, and rows of their similarity matrix at a time.
VECTOR_BLOCK, TILE = 20_000, 1024


def nearest(left: DataFrame, right: DataFrame, block: int = VECTOR_BLOCK) -> DataFrame:
    """side, id, other, sim: each left row's nearest right row (side l) and each right row's nearest left row (side r).

    Frames have (id, v), v of unit length; ties go to the smaller id; null vectors are left out. Both sides are dealt
    into blocks, and every pair of blocks is one task's matrix product. Only best rows leave a task: no pair is emitted,
    and no vector passes through the driver. neighbours.search does without most pairs of blocks.
    """
    import numpy as np

    left, right = (x.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL") for x in (left, right))
    n_left, n_right = (max(1, -(-x.count() // block)) for x in (left, right))

    def dealt(x: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        x = x.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int"))
        return x.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).groupBy("_l", "_r")

    def vectors(table):
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        v = np.stack(table.column("v").combine_chunks().to_numpy(zero_copy_only=False)) if len(ids) else np.zeros((0, 0))
        return ids[order], v[order]

    def best(a, b):
        import pyarrow as pa

        (ids, x), (others, y) = vectors(a), vectors(b)
        if not len(ids) or not len(others):
            return pa.table({"side": pa.array([], pa.string()), "id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        of_left, sim_left = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        of_right, sim_right = np.zeros(len(others), np.int64), np.full(len(others), -np.inf)
        for i in range(0, len(ids), TILE):
            sim = x[i : i + TILE] @ y.T
            top = sim.argmax(1)
            of_left[i : i + TILE], sim_left[i : i + TILE] = others[top], sim[np.arange(len(sim)), top]
            at = sim.argmax(0)
            value = sim[at, np.arange(len(others))]
            better = value > sim_right  # rows come by id: an equal one later has the larger id
            of_right, sim_right = np.where(better, ids[i + at], of_right), np.where(better, value, sim_right)
        sides = pa.array(["l"] * len(ids) + ["r"] * len(others))
        return pa.table({"side": sides, "id": np.concatenate((ids, others)), "other": np.concatenate((of_left, of_right)), "sim": np.concatenate((sim_left, sim_right))})

    pairs = dealt(left, "_l", n_left, "_r", n_right).cogroup(dealt(right, "_r", n_right, "_l", n_left))
    found = pairs.applyInArrow(best, "side string, id long, other long, sim double")
    return found.groupBy("side", "id").agg(F.min_by("other", F.struct(-F.col("sim"), F.col("other"))).alias("other"), F.max("sim").alias("sim"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones whose key is not among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def confusion(df: DataFrame, keys: list[str], gold: str, pred: str) -> DataFrame:
    return df.groupBy(*keys, gold, pred).agg(F.count("*").alias("n"))


def classification(df: DataFrame, keys: list[str], gold: str, pred: str, k: int) -> DataFrame:
    """accuracy and macro_f1 per key over the fixed classes 0..k-1; a class that never occurs counts as 0.

    One shuffle: the confusion counts (at most k*k rows a group) are summed class by class with conditional sums.
    """
    right = F.sum(F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0))
    return confusion(df, keys, gold, pred).groupBy(*keys).agg((right / F.sum("n")).alias("accuracy"), weighted_macro_f1(pred, "n", k, gold).alias("macro_f1"), F.sum("n").alias("n"))


def weighted_macro_f1(pred: str, n: str, classes: int, gold: str = "gold") -> Column:
    """Macro-F1 over a fixed label set as an aggregate of (gold, pred) cells with counts; an absent class counts 0."""

    def one(k: int) -> Column:
        real, hit = F.col(gold) == k, F.col(pred) == k
        both = F.sum(F.when(real & hit, 2 * F.col(n)).otherwise(0))
        either = F.sum(F.when(real, F.col(n)).otherwise(0) + F.when(hit, F.col(n)).otherwise(0))
        return F.coalesce(F.try_divide(both.cast("double"), either.cast("double")), F.lit(0.0))

    return reduce(lambda a, b: a + b, [one(k) for k in range(classes)]) / classes


def mean_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over the rows of a key; 0 for a single row."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))


def shares(df: DataFrame, keys: list[str], label: str, labels: DataFrame) -> DataFrame:
    """Share of every label of `labels` in every key's rows; labels that don't occur have share 0."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    total = df.groupBy(*keys).agg(F.count("*").alias("total"))
    every = total.crossJoin(F.broadcast(labels.select(label)))  # the label list is fixed
    return every.join(counts, [*keys, label], "left").select(*keys, label, F.coalesce("n", F.lit(0)).alias("n"), "total", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def average_rank(value: str, by: list[str], descending: bool = False) -> Column:
    """Rank with ties averaged."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    return F.rank().over(W.partitionBy(*by).orderBy(order)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2.0


def first_per(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of every key in an order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def disambiguate(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """Repeated keys get #1, #2, ... in the order; others stay as they are."""
    w = W.partitionBy(key)
    return df.withColumn(key, F.when(F.count("*").over(w) > 1, F.concat(key, F.lit("#"), F.row_number().over(w.orderBy(*order)).cast("string"))).otherwise(F.col(key)))


def hash_sample(df: DataFrame, keys: list[str], item: str, n: int, seed: int) -> DataFrame:
    """n rows of every key, chosen and ordered by a hash of seed and item: the same on any cluster."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")))
    if not keys:  # a top-n: only n rows meet in one task
        df = df.orderBy(order, item).limit(n)
    return df.withColumn("pick", F.row_number().over(W.partitionBy(*keys).orderBy(order, item))).where(F.col("pick") <= n)


def stratified_split(df: DataFrame, stratum: str, item: str, seed: int, dev: float, test: float) -> DataFrame:
    """split in train, dev, test, by hash order inside every stratum; disjoint and exhaustive."""
    w = W.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string"))), item)
    at = (F.row_number().over(w) - 1) / F.count("*").over(W.partitionBy(stratum))
    return df.withColumn("split", F.when(at < test, "test").when(at < round(test + dev, 12), "dev").otherwise("train"))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Row-normalised cross-tabulation over the given column values."""
    total = F.count("*")
    return df.groupBy(row).agg(*[(F.count_if(F.col(col) == v) / total).alias(f"{v}") for v in values])
