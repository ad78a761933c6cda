"""Streaming forms: appending submaps as they arrive, a cache of computed rows, windowed measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def follow(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append(stream: DataFrame, folder: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None):
    """Add each batch to a Parquet folder, once however often it is tried: a batch writes a folder of its own number."""

    def write(batch: DataFrame, number: int) -> None:
        rows = change(batch) if change else batch
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_uncached(stream: DataFrame, cache: str, checkpoint: str, keys: list[str], compute: Callable[[DataFrame], DataFrame], name: str = "stream"):
    """Compute only rows whose keys the cache (Parquet folder) lacks, and add them to it; streams that share a cache need names of their own."""

    def write(batch: DataFrame, number: int) -> None:
        new, spark, own = batch.dropDuplicates(keys), batch.sparkSession, f"{name}-{number}"
        path = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.option("basePath", cache).parquet(cache).where(F.col("part") != own).select(*keys)
            new = new.join(known, keys, "left_anti")
        compute(new).write.mode("overwrite").parquet(f"{cache}/part={own}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_levels(stream: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """start, key, n, mean, rms in tumbling windows; rows later than ``late`` are left out."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    v = F.col(value)
    return rows.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms")).select(F.col("w.start").alias("start"), key, "n", "mean", "rms")
