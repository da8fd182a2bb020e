"""Means by time window over streams, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import new_path

new_folder = new_path


def window_means(rows: DataFrame, time: str, keys: list[str], value: str, *, width: str = "1 day", lateness: str | None = None) -> DataFrame:
    """(keys, start, n, mean) by tumbling windows; works on streams and on stored tables alike.

    On a stream with `lateness`, state older than the watermark is dropped, and rows that come later than that are too;
    without it no row is too late, and state grows with the number of windows. Times
    without a zone are read as UTC, whatever the session's zone, and their windows start at times without one.
    """
    zoneless = dict(rows.dtypes)[time] == "timestamp_ntz"
    if zoneless:
        rows = rows.withColumn(time, F.from_utc_timestamp(F.col(time).cast("timestamp"), F.current_timezone()))
    if rows.isStreaming and lateness:
        rows = rows.withWatermark(time, lateness)
    grouped = rows.groupBy(*keys, F.window(time, width).alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    start = F.to_utc_timestamp("w.start", F.current_timezone()).cast("timestamp_ntz") if zoneless else F.col("w.start")
    return grouped.select(*keys, start.alias("start"), "n", "mean")


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of Parquet files; a path of a single file is taken as a pattern, as streams want folders."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path[:-1] + f"[{path[-1]}]")


def run_to_end(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Run an aggregation over all that is there, and return its last row for each key.

    Every batch's changed rows are written to a folder of its number, so a repeated batch replaces itself.
    """
    spark, schema = stream.sparkSession, stream.schema
    folder = folder or new_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
    changed = spark.read.parquet(f"{folder}/rows")
    others = [c for c in stream.columns if c not in keys]
    last = changed.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(*keys, "last.*").select(*stream.columns)
