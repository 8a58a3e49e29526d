"""Places in one global order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.sources.io import scratch


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in the order of the columns; equal rows follow one another in any order.

    Ranges of rows are sorted apart and written; a range's rows count on from the ranges before it. Only one count a
    range meets in a task.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "numbered")
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.withColumns({"_range": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    rows = spark.read.parquet(path)
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    return rows.join(ranges, "_range").withColumn(name, F.col("_before") + F.col("_i") + 1).select(*df.columns, name)
