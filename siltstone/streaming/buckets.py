"""Bucket aggregates over a stream (an extension: same result as the batch tables)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import freq_seconds
from ..functions.nulls import flag, zsum

#: States lie in RocksDB on the executors' disks, and its memory is bounded for all states of an executor.
STATES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def bucket_stream(stream: DataFrame, freq: str, columns: Sequence[str], late: str = "1 day") -> DataFrame:
    """Rows, active share, means and extremes by device and bucket; rows later than the watermark are dropped."""
    stream = stream.withColumn("_t", F.col("timedate").cast("timestamp")).withWatermark("_t", late)
    n = F.count("*")
    values = [x for c in columns for x in ((zsum(F.col(c)) / n).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    window = F.window("_t", f"{freq_seconds(freq)} seconds")
    out = stream.where(F.col("deviceId").isNotNull()).groupBy("deviceId", window.alias("_w")).agg(n.alias("n_rows"), (F.sum(flag(F.col("x1") > 0)) / n).alias("active_ratio"), *values)
    return out.select("deviceId", F.col("_w.start").cast("timestamp_ntz").alias("date"), *(c for c in out.columns if c not in ("deviceId", "_w")))


def written(rows: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """The complete result of a stream over what its source holds now; tasks write it to ``out``, no row passes the driver."""
    spark = rows.sparkSession

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    before = {k: spark.conf.get(k, None) for k in STATES}
    try:  # a query copies the session's settings when it starts
        for k, v in STATES.items():
            spark.conf.set(k, v)
        query = rows.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)
