"""Condition matrices and run plans over a language dimension (lang, family, native_block)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _split(block: Column, lang: Column) -> Column:
    return F.concat(block, F.lit("/"), lang)


def matrix(langs: DataFrame) -> DataFrame:
    """kind, name, quadrant, train, eval (array): transfer, transfer_mt and translationese conditions.

    A transfer condition is evaluated on the target's native block, or on the first other block if it has none.
    The language list is a dimension of a few rows, so its product with itself is one too.
    """
    dim = F.broadcast(langs)
    s = langs.where("native_block IS NOT NULL").select(F.col("lang").alias("source"), F.col("family").alias("fs"), F.col("native_block").alias("block"))
    t = langs.select(F.col("lang").alias("target"), F.col("family").alias("ft"), F.col("native_block").alias("tb"))
    others = s.select(F.col("block").alias("b1")).join(F.broadcast(s.select(F.col("block").alias("b2"))), F.col("b1") != F.col("b2")).groupBy("b1").agg(F.min("b2").alias("other"))
    pairs = s.join(F.broadcast(t), F.col("source") != F.col("target")).join(F.broadcast(others), F.col("block") == F.col("b1"), "left")
    quadrant = F.concat("fs", F.lit("->"), "ft").alias("quadrant")
    train = _split(F.col("block"), F.col("source")).alias("train")
    name = F.concat("block", F.lit("_to_"), "target")
    transfer = pairs.select(F.lit("transfer").alias("kind"), name.alias("name"), quadrant, train, F.array(_split(F.coalesce("tb", "other"), F.col("target"))).alias("eval"))
    mt = pairs.select(F.lit("transfer_mt").alias("kind"), F.concat(name, F.lit("_mt")).alias("name"), quadrant, train, F.array(_split(F.col("block"), F.col("target"))).alias("eval"))
    blocks = s.select(F.col("block").alias("b"))
    within = dim.where("native_block IS NOT NULL").crossJoin(F.broadcast(blocks)).groupBy("lang", "family", "native_block").agg(F.array_sort(F.collect_set(_split(F.col("b"), F.col("lang")))).alias("eval"))
    within = within.select(F.lit("translationese").alias("kind"), F.concat(F.lit("within_"), "lang").alias("name"), F.concat("family", F.lit("->"), "family").alias("quadrant"), _split(F.col("native_block"), F.col("lang")).alias("train"), "eval")
    return transfer.unionByName(mt).unionByName(within)


def plan(conditions: DataFrame, seeds: tuple[int, ...], registry: DataFrame) -> DataFrame:
    """Every condition and seed with status runnable or blocked; blocked ones stay in the plan. registry: (model_lang, seed)."""
    every = conditions.withColumns({"seed": F.explode(F.array(*map(F.lit, seeds))), "model_lang": F.get(F.split("train", "/"), 1)})
    return every.join(registry.withColumn("_there", F.lit(True)), ["model_lang", "seed"], "left").withColumn("status", F.when(F.col("_there"), "runnable").otherwise("blocked")).drop("_there")


def config_differences(configs: DataFrame, key: str, a: str, b: str, fields: list[str]) -> DataFrame:
    """field, a, b of the fields in which two configurations differ."""
    long = reduce(lambda x, y: x.union(y), [configs.select(key, F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    wide = long.groupBy("field").agg(F.max(F.when(F.col(key) == a, F.col("v"))).alias("a"), F.max(F.when(F.col(key) == b, F.col("v"))).alias("b"))
    return wide.where(~F.col("a").eqNullSafe(F.col("b")))


def sibling_differences(runs: DataFrame, siblings: DataFrame, on: str, fields: list[str], key: str = "run") -> DataFrame:
    """key, on, field, own, sibling of the fields in which a run's configuration differs from its sibling's; nulls are values."""
    fields_of = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields]))
    own = runs.select(key, on, fields_of.alias("f")).select(key, on, "f.field", F.col("f.v").alias("own"))
    other = siblings.select(on, fields_of.alias("f")).select(on, "f.field", F.col("f.v").alias("sibling"))
    return own.join(other, [on, "field"]).where(~F.col("own").eqNullSafe(F.col("sibling"))).select(key, on, "field", "own", "sibling")


def retention(registry: DataFrame, reported: DataFrame, current: DataFrame) -> DataFrame:
    """keep or orphan for every registered run, with the reason. Frames carry run_hash."""
    r = registry.join(reported.select("run_hash", F.lit(True).alias("_r")).distinct(), "run_hash", "left").join(current.select("run_hash", F.lit(True).alias("_c")).distinct(), "run_hash", "left")
    return r.withColumn("verdict", F.when(F.col("_r"), "keep: reported").when(F.col("_c"), "keep: current config").otherwise("orphan")).drop("_r", "_c")
