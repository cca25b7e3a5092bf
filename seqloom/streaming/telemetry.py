"""Windowed summaries of telemetry samples and incremental embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_samples(spark: SparkSession, path: str, schema: T.StructType | str, streaming: bool = False) -> DataFrame:
    """JSONL samples, as a batch or as an append-only stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(path)


def windowed_summary(samples: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and maximum per window and key; the same for batch and stream.

    The watermark bounds the state to the windows still open.
    """
    if samples.isStreaming:
        samples = samples.withWatermark(ts, late)
    out = samples.groupBy(F.window(ts, width).alias("w"), by).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value")
    )
    return out.select(F.col("w.start").alias("window_start"), by, "n_samples", "mean_value", "max_value")


def embed_new(stream: DataFrame, store: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame], key: str = "sequence") -> StreamingQuery:
    """Embeds sequences not yet in the Parquet store, batch by batch.

    Each batch is written to its own folder by number, so a repeated batch
    overwrites what it wrote before and no key is stored twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(key).where(F.col(key).isNotNull()).distinct()
        try:
            known = spark.read.parquet(store).where(F.col("batch") != number).select(key)
            new = new.join(known, key, "left_anti")
        except Exception as e:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        embed(new).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
