"""Structured Streaming: windowed event counts with a watermark, and latest status by foreachBatch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import shared_folder


def windowed(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and totals by tumbling window and type; rows later than the watermark are dropped in append mode."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = s.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n_events", F.round("total", 4).alias("total"))


def windowed_once(spark: SparkSession, path: str) -> DataFrame:
    """Run the windowed counts over all files of ``path`` as one stream and return the result table.

    Each batch writes the windows it changed to the shared folder (update mode: state older than
    the watermark is dropped); a window's row of its last batch counts. Nothing is held in the driver.
    """
    target = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    glob = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a path may be one file as well as a folder
    changed = windowed(spark.readStream.schema(schema).parquet(glob))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/rows/batch={batch_id}")

    q = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(T.StructType([*changed.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{target}/rows")
    last = F.max_by(F.struct("n_events", "total"), "batch")
    return rows.groupBy("window_start", "event_type").agg(last.alias("x")).select("window_start", "event_type", "x.*")


def keep_latest(stream: DataFrame, target: str, checkpoint: str, key: str = "fingerprint", order: str = "reported_at"):
    """Each batch's latest row a key is appended to ``target``; readers take the latest row a key (see ``latest``). Replays are harmless."""

    def write(batch: DataFrame, batch_id: int) -> None:
        top = batch.groupBy(key).agg(F.max(F.struct(order, *[c for c in batch.columns if c not in (key, order)])).alias("s")).select(key, "s.*")
        top.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str = "fingerprint", order: str = "reported_at") -> DataFrame:
    t = spark.read.parquet(target).drop("batch")
    return t.groupBy(key).agg(F.max(F.struct(order, *[c for c in t.columns if c not in (key, order)])).alias("s")).select(key, "s.*")
