"""Bucketed sums on a stream: the streaming form of ``time_bucket_agg``.

Only the aggregation half of ``time_bucket_agg`` has a streaming meaning:
rows are assigned to tumbling event-time windows and summed per group, with
a watermark bounding how late a row may arrive and how long window state is
kept. Empty buckets (the spine join of the batch operator) have no streaming
form: a bucket with no rows never produces an output row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.checks import as_list
from tessera.session import prepare_session


def stream_bucket_sums(events: DataFrame, ts: str, width: str = "1 hour", by=(),
                       value: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Per (group, tumbling window of ``width``): row count and sum of ``value``.
    Works on batch and streaming frames alike; on a stream, use output mode
    ``append`` (a window is emitted once the watermark passes its end)."""
    by = as_list(by)
    prepare_session(events.sparkSession)
    ntz = isinstance(events.schema[ts].dataType, T.TimestampNTZType)
    # watermarks need a zoned TIMESTAMP; the session time zone is UTC, so the
    # cast keeps the wall-clock value and is undone on the output bucket
    src = events.withColumn(ts, F.col(ts).cast("timestamp")) if ntz else events
    src = src.withWatermark(ts, watermark) if src.isStreaming else src
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.sum(value).alias("total"))
    g = src.groupBy(*by, F.window(F.col(ts), width).alias("w")).agg(*aggs)
    bucket = F.col("w.start").cast("timestamp_ntz") if ntz else F.col("w.start")
    return g.select(*by, bucket.alias("bucket"), *[a for a in ("n", "total") if a in g.columns])
