"""Structured Streaming front ends: a watched folder of responses, and the latest annotation of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions import text as T


def watch_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the whole texts that arrive in a folder."""
    return spark.readStream.format("text").option("wholetext", True).load(folder).select(T.file_key(F.col("_metadata.file_path")).alias("key"), F.col("value").alias("text"))


def parsed_estimates(stream: DataFrame) -> DataFrame:
    """Effect, standard error and observations of each arriving text."""
    x = F.col("text")
    return stream.select("key", T.parsed_effect(x).alias("effect_size"), T.parsed_se(x).alias("standard_error"), T.parsed_observations(x).alias("n_observations"))


def event_windows(stream: DataFrame, at: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by type in tumbling windows; rows later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def keep_latest(stream: DataFrame, key: str, at: str, target: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's latest row for each key; readers take the latest over batches (upsert_annotations)."""

    def write(batch: DataFrame, n: int) -> None:
        best = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), at).alias("r")).select("r.*")
        best.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
