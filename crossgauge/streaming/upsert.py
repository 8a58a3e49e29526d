"""Beyond the reference: the prediction-log upsert as a streaming sink, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crossgauge.sources.io import upsert_table


def upsert_stream(stream: DataFrame, path: str, keys: list[str], by: list[str], checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces its keys in a partitioned table; replaying a batch gives the same table."""

    def put(batch: DataFrame, _: int) -> None:
        latest = batch.dropDuplicates(keys)
        if not latest.isEmpty():
            upsert_table(latest, path, keys, *by)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
