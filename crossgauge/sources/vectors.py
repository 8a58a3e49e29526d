"""A store of vectors keyed by the content of their texts: versions are appended, and only texts that no version has are embedded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = "key string, v array<float>, version int"


def content_key(text: Column, model: str = "") -> Column:
    """What a vector depends on: the text and the model's name; null counts as empty."""
    return F.sha2(F.concat(F.lit(model), F.lit("\n"), F.coalesce(text, F.lit(""))), 256)


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, v, version; a store that isn't there yet is empty."""
    try:
        return spark.read.schema(STORE).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORE)


def keyed(df: DataFrame, text: str, model: str = "") -> DataFrame:
    """key, text of the distinct texts of a table."""
    return df.select(content_key(F.col(text), model).alias("key"), F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["key"])


def missing(df: DataFrame, text: str, path: str, model: str = "") -> DataFrame:
    """key, text of the distinct texts that the store doesn't have; keys are compared, no vector is read."""
    return keyed(df, text, model).join(read(df.sparkSession, path).select("key"), "key", "left_anti")


def update(df: DataFrame, text: str, path: str, embed: Callable[[Column], Column], model: str = "") -> int:
    """Embed what is missing and append it as the next version; returns how many texts that were. A failed run leaves no version."""
    spark = df.sparkSession
    new = missing(df, text, path, model)
    if new.isEmpty():
        return 0
    last = read(spark, path).agg(F.max("version")).first()[0]
    folder = f"{path}/version={0 if last is None else last + 1}"  # one that no rows were committed to may be there from a failed run
    new.select("key", embed(F.col("text")).cast("array<float>").alias("v")).write.mode("overwrite").parquet(folder)
    return spark.read.schema("key string").parquet(folder).count()


def lookup(df: DataFrame, text: str, path: str, model: str = "") -> DataFrame:
    """df with the vector of each row's text as `v`, null where the store has none."""
    store = read(df.sparkSession, path).select(F.col("key").alias("_key"), "v")
    return df.withColumn("_key", content_key(F.col(text), model)).join(store, "_key", "left").drop("_key")


def stale(df: DataFrame, text: str, path: str, model: str = "") -> DataFrame:
    """key, version of the vectors that no text of df uses."""
    return read(df.sparkSession, path).select("key", "version").join(keyed(df, text, model).select("key"), "key", "left_anti")
