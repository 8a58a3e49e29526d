"""Merkle manifests of keyed tables: digests of rows, leaves, splits and the whole, checked along the branches that changed.

A row's place in its split's tree is the hash of its key, so a change touches one path and trees of equal depth are
comparable whatever the files. A leaf has some ROWS_A_LEAF rows; every node above has at most 16 children.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgauge.sources.io import scratch

ROWS_A_LEAF = 256


def row_text(columns: list[str]) -> Column:
    """A row as one string that no other row has: every value behind its length, null as `-`."""
    return F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns])


def row_digests(df: DataFrame, split: str, key: list[str], depth: int) -> DataFrame:
    """split, leaf, key (array of strings), digest of every row."""
    name = F.sha2(row_text(key), 256)
    return df.select(F.col(split).cast("string").alias("split"), F.substring(name, 1, depth).alias("leaf"), name.alias("key"), F.sha2(row_text(df.columns), 256).alias("digest"))


def _joined(order: list[str]) -> Column:
    parts = F.sort_array(F.collect_list(F.struct(*order)))
    return F.sha2(F.array_join(F.transform(parts, lambda x: x["digest"]), ""), 256)


def tree(rows: DataFrame, depth: int) -> DataFrame:
    """split, level, node, rows, digest: leaves at level `depth`, a split's root at level 0, the whole (split null) at -1."""
    level = rows.groupBy("split", F.col("leaf").alias("node")).agg(F.count("*").alias("rows"), _joined(["key", "digest"]).alias("digest"))
    out = level.withColumn("level", F.lit(depth))
    for d in reversed(range(depth)):
        level = level.withColumn("up", F.substring("node", 1, d)).groupBy("split", F.col("up").alias("_up")).agg(F.sum("rows").alias("rows"), _joined(["node", "digest"]).alias("digest")).withColumnRenamed("_up", "node")
        out = out.unionByName(level.withColumn("level", F.lit(d)))
    whole = level.groupBy().agg(F.sum("rows").alias("rows"), _joined(["split", "digest"]).alias("digest"))  # a row for each split
    whole = whole.where("rows IS NOT NULL").select(F.lit(None).cast("string").alias("split"), F.lit("").alias("node"), "rows", "digest", F.lit(-1).alias("level"))
    return out.unionByName(whole).select("split", "level", "node", "rows", "digest")


@dataclass
class Manifest:
    """A frozen table's digests, as tables in a folder."""

    path: str
    split: str
    key: list[str]
    depth: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/nodes")


def freeze(df: DataFrame, path: str, split: str, key: list[str], rows_a_leaf: int = ROWS_A_LEAF) -> Manifest:
    """Write the digests of df; a path that is there is refused."""
    spark, depth = df.sparkSession, 0
    most = df.groupBy(split).count().agg(F.max("count")).first()[0] or 0
    while most > rows_a_leaf * 16**depth:
        depth += 1
    row_digests(df, split, key, depth).write.parquet(f"{path}/rows")
    tree(spark.read.parquet(f"{path}/rows"), depth).write.parquet(f"{path}/nodes")
    return Manifest(path, split, key, depth)


def changed_leaves(expected: DataFrame, actual: DataFrame, depth: int) -> DataFrame:
    """split, node of the leaves that differ. Level by level only the children of differing nodes are compared."""
    differing = None
    for d in range(depth + 1):
        sides = []
        for x, name in ((expected, "e"), (actual, "a")):
            x = x.where(F.col("level") == d).select("split", "node", F.col("digest").alias(name))
            if differing is not None:
                x = x.withColumn("up", F.substring("node", 1, d - 1)).join(differing.withColumnRenamed("node", "up"), ["split", "up"], "left_semi").drop("up")
            sides.append(x)
        differing = sides[0].join(sides[1], ["split", "node"], "full").where(~F.col("e").eqNullSafe(F.col("a"))).select("split", "node")
    return differing


def verify(manifest: Manifest, df: DataFrame) -> DataFrame:
    """split, key, status (changed, missing or unexpected) of the rows of df that aren't as frozen; equal trees are told by their roots.

    Repeated keys are compared as sets of digests.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "digests")
    row_digests(df, manifest.split, manifest.key, manifest.depth).write.parquet(f"{path}/rows")
    now = spark.read.parquet(f"{path}/rows")
    tree(now, manifest.depth).write.parquet(f"{path}/nodes")
    leaves = changed_leaves(manifest.nodes(spark), spark.read.parquet(f"{path}/nodes"), manifest.depth).withColumnRenamed("node", "leaf")
    sides = [x.join(leaves, ["split", "leaf"], "left_semi").groupBy("split", "key").agg(F.sort_array(F.collect_set("digest")).alias(n)) for x, n in ((manifest.rows(spark), "e"), (now, "a"))]
    status = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("a") != F.col("e"), "changed")
    return sides[0].join(sides[1], ["split", "key"], "full").withColumn("status", status).where("status IS NOT NULL").select("split", "key", "status")


def provenance(sources: DataFrame, manifest: DataFrame, name: str = "file", digest: str = "digest") -> DataFrame:
    """name, status of every source file against a manifest (name, digest): as frozen, changed or not listed; what only the manifest has is missing."""
    joined = sources.select(name, F.col(digest).alias("_now")).join(manifest.select(name, F.col(digest).alias("_then")), name, "full")
    status = F.when(F.col("_now").isNull(), "missing").when(F.col("_then").isNull(), "not listed").when(F.col("_now") == F.col("_then"), "as frozen").otherwise("changed")
    return joined.select(name, status.alias("status"))
