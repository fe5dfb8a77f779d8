"""Run a streaming result.

A mapping whose store is `stream` (see sources.registry) is read with readStream. Scans,
filters, projections, unions and joins with static stars then stream as they are, and a
stream joins another one on its key. Groups and sorts follow Structured Streaming's rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append") -> StreamingQuery:
    """Write all input that is there now to a sink, exactly once over restarts, and wait for it."""
    if not df.isStreaming:
        raise ValueError("the result is not a stream; write it with df.write")
    query = df.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
