"""Incremental ingestion with Structured Streaming."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

LISTING = "path string, size_bytes bigint, sha1 string, md5 string"


def follow(spark: SparkSession, source: str, store, snapshot: dict, checkpoint: str) -> StreamingQuery:
    """Adds each new Parquet file of listings below source to a snapshot.

    A path that comes again replaces the earlier record.  A batch that is run twice after a failure writes
    the same records again, so the snapshot reads alike.
    """

    def put(batch: DataFrame, _: int) -> None:
        store.write(snapshot, batch)

    stream = spark.readStream.schema(LISTING).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
