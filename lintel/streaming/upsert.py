"""Structured Streaming forms of the keyed state (ST1, ST2).

ST1: a file stream of metric updates is merged into a keyed store
(``sources.store``) with ``foreachBatch``. A micro-batch writes its own rows
as a generation; generations are merged as they grow, so the bytes written
follow the batches and not the table. The batch number is part of the
commit: a batch that is replayed after a crash, before or after its commit,
gives the same table. Checkpoint and store live in the shared folder named
by ``spark.checkpoint.dir``.

ST2: tumbling-window debt/issue counts with an event-time watermark; rows
whose window the watermark has passed are dropped by Spark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.session import scratch_path
from lintel.sources.store import KeyedStore


def stream_upsert(spark: SparkSession, source_dir: str, schema, key: list[str], order: list[str],
                  work: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """ST1: run the stream over what is there (availableNow) and return the state."""
    work = work or scratch_path(spark, f"stream-upsert-{uuid.uuid4().hex[:8]}")
    store = KeyedStore(spark, f"{work}/state", schema, key, order)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def merge(batch: DataFrame, batch_id: int) -> None:
        store.merge(batch, batch=batch_id)

    q = (reader.parquet(source_dir).writeStream.foreachBatch(merge)
         .option("checkpointLocation", f"{work}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return store.current()


def stream_window_counts(spark: SparkSession, source_dir: str, schema, ts: str, group: list[str],
                         value: str, window: str = "1 hour", watermark: str = "1 hour",
                         work: str | None = None) -> DataFrame:
    """ST2: per tumbling window and group: rows and value sum, with watermark.

    Runs over the files that are there (availableNow) and may be called again
    with the same ``work`` when more have come: counts and watermark go on
    from the checkpoint, and rows of windows that the watermark has passed
    are dropped.

    ``timestamp_ntz`` columns are cast to ``timestamp`` first (watermarks
    need a zoned timestamp). Update mode: each micro-batch appends the
    windows it changed, tagged with its batch id, to a Parquet table in the
    shared folder; the answer is the newest version of every window. A
    replayed batch rewrites identical rows, so the answer is unchanged.
    """
    work = work or scratch_path(spark, f"stream-window-{uuid.uuid4().hex[:8]}")
    src = spark.readStream.schema(schema).parquet(source_dir)
    src = src.withColumn("__ts", F.col(ts).cast("timestamp"))
    agg = (src.withWatermark("__ts", watermark)
           .groupBy(F.window("__ts", window).alias("w"), *group)
           .agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("value_sum")))
    out = f"{work}/out"

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), *group, "events", "value_sum")
         .writeStream.foreachBatch(sink).outputMode("update")
         .option("checkpointLocation", f"{work}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out)
    keys = ["window_start", "window_end", *group]
    return res.groupBy(*keys).agg(
        F.max_by(F.struct("events", "value_sum"), "batch_id").alias("r")).select(*keys, "r.*")
