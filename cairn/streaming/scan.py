"""The scan as a stream of files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the driver and all executors share; a temporary one only where the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="cairn-stream-")
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def run_available(stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there, with its log and its output in the shared folder, and reads the output.

    The file sink's log makes each micro-batch appear once, also when a batch
    is run again after a failure.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by event time; rows later than the watermark are left out and state older than it is dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")
