"""Session factory and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "crossgauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; on a cluster the master comes from spark-submit."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    builder = SparkSession.builder.appName(name).config(map={**settings, **conf})
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers started from another folder import the package; a cluster without shared folders needs --py-files instead."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def health(spark: SparkSession) -> dict[str, str]:
    """Versions and settings a run depends on."""
    import sys

    import pyarrow

    return {"python": sys.version.split()[0], "arrow": pyarrow.__version__, "spark": spark.version, "time_zone": spark.conf.get("spark.sql.session.timeZone"), "adaptive": spark.conf.get("spark.sql.adaptive.enabled")}


def worker_versions(batches):
    """Rows of a key -> the key, how many rows of it a worker read, and that worker's versions; for mapInArrow."""
    import sys
    from collections import Counter

    import pyarrow as pa

    n: Counter = Counter()
    for b in batches:
        n.update(b.column(0).to_pylist())
    same = [sys.version.split()[0]] * len(n), [pa.__version__] * len(n)
    yield pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), *(pa.array(x, pa.string()) for x in same)], names=["lang", "n", "python", "arrow"])
