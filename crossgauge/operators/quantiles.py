"""Exact quantiles of groups of any size by refining histograms.

A quantile lies between two order statistics. The cell that holds one is cut into bins, each with its count, least and
greatest value; the bin that the rank falls into is the next cell, until its values are all equal. A pass moves one row for
each bin, whatever the group's size, and no task holds a group's values or its distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.sources.io import scratch

BINS = 1024
#: Groups up to this size are left to Spark's own exact percentile, whose buffer they fit.
SMALL = 1 << 20




def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], name: str = "q", small: int = SMALL, bins: int = BINS) -> DataFrame:
    """keys, `name` (array of doubles, one for each probability, interpolated linearly between order statistics).

    Nulls and NaN are left out, a group without values gives no row, null keys are a group. df is read once for every
    pass if a group is larger than `small`: pass a stored table.
    """
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    spark = df.sparkSession

    def written(x: DataFrame) -> DataFrame:
        path = scratch(spark, "quantiles")
        x.write.parquet(path)
        return spark.read.schema(x.schema).parquet(path)

    if (data.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= small:
        return data.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, probs))).alias(name))
    sizes = written(data.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    at = [(F.col("_n") - 1) * F.lit(p) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at])))
    targets = sizes.select(*keys, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.explode(ranks).alias("_r"))
    found = None
    while True:
        targets = written(targets)
        settled = targets.where("_lo = _hi").select(*keys, "_r", F.col("_lo").alias("_x"))
        found = settled if found is None else found.union(settled)
        open_ = targets.where("_lo < _hi")
        if open_.isEmpty():
            break
        cells = open_.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_lo", "_hi", "_below").distinct()
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & data[k].eqNullSafe(cells[f"_k{i}"])
        inside = data.join(cells, on & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bin_ = F.least(F.lit(bins - 1), F.floor(share * bins))
        cell = [*[f"_k{i}" for i in range(len(keys))], "_lo", "_hi", "_below"]
        counts = inside.groupBy(*cell, bin_.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = F.col("_below") + F.sum("_c").over(W.partitionBy(*cell).orderBy("_bin"))  # at most `bins` rows
        counts = counts.withColumn("_upto", upto).withColumnsRenamed({"_lo": "_clo", "_hi": "_chi", "_below": "_cbelow"})
        on = (F.col("_lo") == F.col("_clo")) & (F.col("_hi") == F.col("_chi")) & (F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c"))
        for i, k in enumerate(keys):
            on = on & open_[k].eqNullSafe(counts[f"_k{i}"])
        targets = open_.join(counts, on).select(*keys, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_upto") - F.col("_c")).alias("_below"), "_r")
    found = found.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & sizes[k].eqNullSafe(found[f"_k{i}"])

    def one(x: Column) -> Column:
        low, high = (F.max(F.when(F.col("_r") == f(x), F.col("_x"))) for f in (F.floor, F.ceil))
        part = F.max(x - F.floor(x))
        return low + (high - low) * part

    return sizes.join(found, on).groupBy(*keys).agg(F.array(*[one(x) for x in at]).alias(name))
