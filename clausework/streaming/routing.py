"""The routing chain over a stream: row-local gates, duplicates dropped within a watermark, three tables a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import segment


def routed_stream(stream: DataFrame, *, time: str, text: str, delay: str = "10 minutes") -> DataFrame:
    """stream (with an event time) routed; a text seen again within the delay is dropped."""
    return segment.routed(stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([text]), text)


def write_routes(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends each batch, partitioned by route."""
    return stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").partitionBy("route").parquet(path)).option("checkpointLocation", checkpoint)
